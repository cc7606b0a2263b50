"""Language identification of code-switched text with a linear-chain conditional random field.

Method: every word is a position of a chain and every language a state. A word's features are its prefixes, suffixes, byte
three-grams at all of its places, itself, and whether the lexicon of a language (words that the training rows of that language use more than others) holds it; transitions
between neighbouring words are learned as well. Forward-backward gives each word's probability of each language; a text's language is the one
with the most expected words, and its share is the score.

Trained on the texts of ``PER_LANGUAGE`` ids of each language, those with the smallest hashes among the distinct ids of that language
(all of them where there are fewer), however rare or frequent the language is, by gradient steps on the likelihood; chains of two languages are joined from the training chains, so that switches are learned. Chains have at most ``CHAIN`` words;
a longer text is several chains, all of which count.

Only ASCII bytes other than letters part words, so a run without spaces (Chinese, Japanese, Thai) is one word with one vote; all of it counts.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with letters but no trained language it is ``und`` too;
ties go to the language that comes first by code point; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.llm.common import map_batches
from plcatlas.llm.words import hash_slices, mix, slices, words_of

PER_LANGUAGE = 120
SALTS = 64
CHAIN = 64
BUCKETS = 1 << 16
BLOCK = 1 << 20
LEXICON = 2000
CELLS = 2_000_000
# Bytes of text that are judged at a time; the arrays over their words take some forty times as much.
SLICE_BYTES = 1 << 20
UNKNOWN = "und"
# What hash_slices mixes into a slice of three bytes with seed 30.
GRAM_SEED = np.uint64(33 * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
# Bytes between words: all of ASCII but letters.
APART = np.zeros(256, dtype=bool)
APART[:128] = True
APART[65:91] = APART[97:123] = False


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters (0xC3 0x80 to 0xC3 0x9E in UTF-8)."""
    data = data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    data[after & (data >= 0x80) & (data <= 0x9E)] += 32
    return data


class Tokens:
    """Words of a column, the distinct ones among them, and the chain and place of each word."""

    def __init__(self, column):
        self.words = words_of(column, apart=APART)
        self.words.data = fold_case(self.words.data)
        hashes = self.words.hashes()
        self.kinds, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.starts, self.ends = self.words.starts[first], self.words.ends[first]
        place = np.arange(len(self.words)) - self.words.first[self.words.doc]
        self.place = place % CHAIN
        self.chain = np.cumsum(self.place == 0) - 1
        self.chains = int(self.chain[-1]) + 1 if len(self.chain) else 0

    def features(self) -> np.ndarray:
        """Buckets of the features of each distinct word; unused places point to the last, empty bucket."""
        data, s, e = self.words.data, self.starts, self.ends
        size = e - s
        columns = [self.kinds]
        for n in (1, 2, 3):
            columns.append(np.where(size >= n, hash_slices(data, s, np.minimum(s + n, e), 10 + n), 0))
        for n in (1, 2, 3, 4):
            columns.append(np.where(size >= n, hash_slices(data, np.maximum(e - n, s), e, 20 + n), 0))
        found = np.stack(columns, axis=1)
        return np.where(found == 0, BUCKETS, (found >> np.uint64(48)).astype(np.int64)).astype(np.int32)

    def grams(self):
        """Distinct words and buckets of their three-grams, at all places of a word, in blocks of at most ``BLOCK``; words ascend."""
        until = np.cumsum(np.maximum(self.ends - self.starts - 2, 0))
        total = int(until[-1]) if len(until) else 0
        for at in range(0, total, BLOCK):
            place = np.arange(at, min(at + BLOCK, total))
            word = np.searchsorted(until, place, side="right")
            start = self.ends[word] - 2 - (until[word] - place)
            three = sum(self.words.data[start + k].astype(np.uint64) << np.uint64(8 * k) for k in range(3))
            yield word, (mix(three ^ GRAM_SEED) >> np.uint64(48)).astype(np.int32)

    def has_letter(self, texts) -> np.ndarray:
        counts = self.words.counts() > 0
        data, offsets = self.words.data, self.words.offsets
        plain = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        unsure = counts & (plain[offsets[1:]] == plain[offsets[:-1]])
        for row in np.flatnonzero(unsure):
            counts[row] = any(c.isalpha() for c in texts[int(row)].as_py())
        return counts


@dataclasses.dataclass
class Tagger:
    """Weights by feature bucket and language, lexicon membership weights, and transition scores."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    member: np.ndarray
    lexicon_weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray

    def emissions(self, tokens: Tokens, features: np.ndarray | None = None, grams=None) -> np.ndarray:
        out = np.zeros((len(tokens.kinds), len(self.languages)))
        for column in (tokens.features() if features is None else features).T:
            out += self.weights[column]
        for word, bucket in tokens.grams() if grams is None else grams:
            low, high = word[0], word[-1] + 1
            for k in range(len(self.languages)):
                out[low:high, k] += np.bincount(word - low, self.weights[bucket, k], minlength=high - low)
        return out + self.membership(tokens.kinds) @ self.lexicon_weights

    def membership(self, kinds: np.ndarray) -> np.ndarray:
        found = np.zeros((len(kinds), len(self.languages)))
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, kinds), len(self.lexicon) - 1)
            hit = self.lexicon[at] == kinds
            found[hit] = self.member[at[hit]]
        return found


def forward_backward(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each state at each place, expected transitions, and the log-likelihood's normaliser of each chain.

    ``scores`` is (chains, places, states); ``real`` marks the places in use, which come first in their chain.
    """
    chains, places, states = scores.shape
    top = scores.max(axis=2, keepdims=True)
    gain = np.exp(scores - top)
    step, start = np.exp(moves), np.exp(begin)
    ahead, scale = np.zeros_like(gain), np.ones((chains, places))
    ahead[:, 0] = start * gain[:, 0]
    for t in range(places):
        if t:
            ahead[:, t] = np.where(real[:, t, None], (ahead[:, t - 1] @ step) * gain[:, t], ahead[:, t - 1])
        scale[:, t] = ahead[:, t].sum(axis=1)
        ahead[:, t] /= scale[:, t, None]
    back = np.ones((chains, states))
    post, moved = np.empty_like(gain), np.zeros((states, states))
    for t in range(places - 1, -1, -1):
        post[:, t] = ahead[:, t] * back
        post[:, t] /= post[:, t].sum(axis=1, keepdims=True)
        if t:
            pull = gain[:, t] * back
            use = real[:, t]
            joint = ahead[use, t - 1][:, :, None] * step * pull[use][:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            prior = pull @ step.T
            back = np.where(use[:, None], prior / prior.sum(axis=1, keepdims=True), back)
    return post, moved, (np.log(scale) * real + top[:, :, 0] * real).sum(axis=1)


def posteriors(scores: np.ndarray, real: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Forward-backward for prediction: only the posteriors, in single precision."""
    gain = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float32)
    step, start = np.exp(moves).astype(np.float32), np.exp(begin).astype(np.float32)
    ahead = np.empty_like(gain)
    ahead[:, 0] = start * gain[:, 0]
    ahead[:, 0] /= ahead[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, gain.shape[1]):
        now = np.maximum((ahead[:, t - 1] @ step) * gain[:, t], 1e-30)
        now /= now.sum(axis=1, keepdims=True)
        ahead[:, t] = np.where(real[:, t, None], now, ahead[:, t - 1])
    back = np.ones((gain.shape[0], gain.shape[2]), np.float32)
    for t in range(gain.shape[1] - 1, -1, -1):
        pull = np.maximum(gain[:, t] * back, 1e-30)
        ahead[:, t] *= back
        ahead[:, t] /= np.maximum(ahead[:, t].sum(axis=1, keepdims=True), 1e-30)
        prior = pull @ step.T
        back = np.where(real[:, t, None], prior / prior.sum(axis=1, keepdims=True), back)
    return ahead


def fit(texts: list[str], labels: list[str], steps: int = 30, rate: float = 0.2, ridge: float = 1e-6) -> Tagger | None:
    """Trains on whole texts; each word is labelled with its text's language."""
    languages = sorted(set(labels))
    if not languages:
        return None
    tokens = Tokens(pa.array(texts, pa.large_string()))
    n, kinds = len(languages), len(tokens.kinds)
    state = np.array([languages.index(x) for x in labels])[tokens.words.doc]
    used = np.zeros((kinds, n))
    np.add.at(used, (tokens.kind, state), 1)
    share = used / np.maximum(1, used.sum(axis=0))
    belongs = share > 2 * (share.sum(axis=1, keepdims=True) - share)
    keep = np.zeros((kinds, n), dtype=bool)
    for k in range(n):
        best = np.argsort(-share[:, k], kind="stable")[:LEXICON]
        keep[best, k] = belongs[best, k] & (used[best, k] > 1)
    held = keep.any(axis=1)
    model = Tagger(languages, np.zeros((BUCKETS + 1, n)), tokens.kinds[held], keep[held].astype(float), np.zeros((n, n)), np.zeros((n, n)), np.zeros(n))

    if tokens.chains == 0:
        return model
    cell, real, gold = chain_cells(tokens, state)
    features, grams, member = tokens.features(), list(tokens.grams()), model.membership(tokens.kinds)
    shape = [model.weights.shape, model.lexicon_weights.shape, model.moves.shape, model.begin.shape]
    first, second = [np.zeros(x) for x in shape], [np.zeros(x) for x in shape]
    total = real.sum()
    hot = np.eye(n)[gold] * real[:, :, None]
    stays = np.zeros((n, n))
    np.add.at(stays, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1)
    for t in range(1, steps + 1):
        emission = model.emissions(tokens, features, grams)
        grads = [np.zeros(x) for x in shape]
        slip = np.zeros((kinds, n))
        moved, begun = np.zeros((n, n)), np.zeros(n)
        block = max(1, CELLS // (CHAIN * n))
        for at in range(0, len(cell), block):
            c, r = cell[at : at + block], real[at : at + block]
            post, m, _ = forward_backward(emission[c], r, model.moves, model.begin)
            off = (post - hot[at : at + block]) * r[:, :, None]
            for k in range(n):
                slip[:, k] += np.bincount(c.ravel(), off[:, :, k].ravel(), minlength=kinds)
            moved += m
            begun += off[:, 0].sum(axis=0)
        for column in features.T:
            for k in range(n):
                grads[0][:, k] += np.bincount(column, slip[:, k], minlength=BUCKETS + 1)
        for word, bucket in grams:
            for k in range(n):
                grads[0][:, k] += np.bincount(bucket, slip[word, k], minlength=BUCKETS + 1)
        grads[1], grads[2], grads[3] = member.T @ slip, moved - stays, begun
        for k, part in enumerate((model.weights, model.lexicon_weights, model.moves, model.begin)):
            g = grads[k] / total + ridge * part
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
            part -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
        model.weights[BUCKETS] = 0
    return model


def chain_cells(tokens: Tokens, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as rows of word kinds, marks of real places, and labels; and chains made of two halves, which switch languages."""
    cell = np.zeros((tokens.chains, CHAIN), np.int64)
    real, gold = np.zeros((tokens.chains, CHAIN), dtype=bool), np.zeros((tokens.chains, CHAIN), np.int64)
    cell[tokens.chain, tokens.place], real[tokens.chain, tokens.place], gold[tokens.chain, tokens.place] = tokens.kind, True, state
    full = np.flatnonzero(real.all(axis=1))
    other = full[(np.arange(len(full)) * 7919 + len(full) // 2) % max(1, len(full))]
    half = CHAIN // 2
    join = lambda x: np.concatenate([x[full, :half], x[other, :half]], axis=1)
    return tuple(np.concatenate([x, join(x)]) for x in (cell, real, gold))


def sample(known: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Of each language the ``per_language`` distinct ids (``id, lang``) with the smallest hashes, ties by id.

    The smallest of each of ``SALTS`` parts of a language are taken first, so a hot language isn't one task. Rows of one
    id in one language count once.
    """
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(SALTS))
    ids = known.select("id", "lang").distinct().withColumn("_hash", F.xxhash64("id")).withColumn("_part", part)
    for group in (["lang", "_part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("_hash", "id"))
        ids = ids.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).drop("_rank")
    return ids.select("id", "lang")


def train(docs: DataFrame, eligible: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE) -> Tagger | None:
    """Fits the tagger on ``per_language`` ids of every language among the rows that meet ``eligible``, a condition on ``id`` and ``lang``."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    known = rows.filter(eligible).filter("lang is not null and id is not null and text is not null").select("id", "lang")
    pairs = [(r.id, r.lang) for r in sample(known, per_language).collect()]
    spark = docs.sparkSession
    if not pairs:
        return None
    # no more than per_language ids of each language, so the list is small at any size of the input
    chosen = F.broadcast(spark.createDataFrame(pairs, "id long, lang string"))
    found = sorted((r.lang, r.text) for r in rows.filter("text is not null").join(chosen, ["id", "lang"]).select("lang", "text").collect())
    return fit([text for _, text in found], [lang for lang, _ in found])


def judge(column: pa.Array, model: Tagger | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text of a batch, a slice of it at a time."""
    found = [judge_slice(part, model) for part in slices(column, SLICE_BYTES)]
    return [x for lang, _ in found for x in lang], np.concatenate([np.zeros(0), *[share for _, share in found]])


def judge_slice(column: pa.Array, model: Tagger | None) -> tuple[list[str], np.ndarray]:
    tokens, count = Tokens(column), len(column)
    letters = tokens.has_letter(column)
    n = len(model.languages) if model else 0
    votes = np.zeros((count, max(1, n)))
    if model and tokens.chains:
        emission = model.emissions(tokens)
        block = max(1, CELLS // (CHAIN * n))
        first = np.searchsorted(tokens.chain, np.arange(tokens.chains + 1))
        for at in range(0, tokens.chains, block):
            w = slice(first[at], first[min(at + block, tokens.chains)])
            chain, place = tokens.chain[w] - at, tokens.place[w]
            size = int(chain[-1]) + 1
            scores, real = np.zeros((size, CHAIN, n)), np.zeros((size, CHAIN), dtype=bool)
            scores[chain, place], real[chain, place] = emission[tokens.kind[w]], True
            post = posteriors(scores, real, model.moves, model.begin)[chain, place]
            for k in range(n):
                votes[:, k] += np.bincount(tokens.words.doc[w], post[:, k], minlength=count)
    best = votes.argmax(axis=1)
    share = np.clip(votes[np.arange(count), best] / np.maximum(1, tokens.words.counts()), 0, 1)
    known = letters & bool(model)
    return [model.languages[k] if yes else UNKNOWN for k, yes in zip(best, known)], np.where(known, share, 0.0)


def predict(docs: DataFrame, model: Tagger | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, share = judge(b.column(1), model)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Tagger | None, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``; all columns, no shuffle."""
    place = docs.columns.index(text_column)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, share = judge(b.column(place), model)
        return b.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, share)], pa.bool_()))

    return map_batches(docs, run, docs.schema)
