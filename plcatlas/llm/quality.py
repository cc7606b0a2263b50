"""Quality rules: fixed rules and a calibrated classifier.

Method: a logistic regression over hashed words, word two- and three-grams and character (byte) three-grams is trained on labelled quality rows, its outputs are turned into
probabilities on rows it hasn't seen (Platt's scaling), and every text is scored in Arrow batches against fixed thresholds.

The classifier is fitted on at most ``SAMPLE`` labelled rows of each class, those whose ids have the smallest hashes; texts of these
rows are used whole, of repeated rows of an id the least text, and only their feature counts come to the driver. All other figures are computed for every document.

Defined cases: a null or empty text has no words and fails the base rules; without labels of both classes there is no model, the
probability is null and the base rules decide alone; labels other than 0 and 1, labels without a document and repeated labels
(the smaller counts) do no harm; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import map_batches
from plcatlas.llm.words import Words, gram_hashes, hash_slices, mix, words_of

SAMPLE = 1500
BUCKETS = 1 << 15  # of characters; those of words come behind
WORD_BITS = 17
ORDERS = (1, 2, 3)
SIZE = BUCKETS + (1 << WORD_BITS)
SCALE = 30.0
THRESHOLD = 0.35
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a value a position between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each text in three-word windows that occur twice or more in it."""
    windows = gram_hashes(hashes, 3)
    covered = np.zeros(len(words), dtype=bool)
    if len(windows):
        inside = np.flatnonzero(words.doc[:-2] == words.doc[2:])
        keys = mix(windows[inside] + words.doc[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        often = np.zeros(len(keys), dtype=bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        at = inside[often]
        for step in range(3):
            covered[at + step] = True
    return per_doc(covered, words.first)


def duplicate_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), np.append(breaks, len(data))[np.searchsorted(breaks, starts)])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(ends, offsets[doc + 1])
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, doc = starts[has_word], ends[has_word], doc[has_word]
    lines = np.bincount(doc, minlength=len(offsets) - 1)
    # the text is part of the key, so equal keys are lines of one text
    keys = mix(hash_slices(data, starts, ends) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(keys)
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[order][1:] != keys[order][:-1]
    return lines - np.bincount(doc[order][first], minlength=len(offsets) - 1)


def base_figures(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    inside = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    points = (words.data & 0xC0) != 0x80
    return {
        "n_words": words.counts(),
        "word_chars": per_doc(in_word & points, words.offsets),
        "n_symbols": per_doc(SYMBOLS[words.data], words.offsets),
        "n_dup_lines": duplicate_lines(words),
        "n_repeat_words": repeated_words(words, hashes),
    }


def char_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that start at each position."""
    wide = data.astype(np.uint32)
    grams = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
    return ((grams * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def word_buckets(words: Words, hashes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three words: the bucket of the words that start at each place, and whether they are of one text."""
    found = []
    for n in ORDERS:
        grams = hashes if n == 1 else gram_hashes(hashes, n, seed=n)
        count = len(grams)
        found.append(((grams >> np.uint64(64 - WORD_BITS)).astype(np.int32) + BUCKETS, words.doc[:count] == words.doc[len(words) - count :]))
    return found


def gram_counts(words: Words, n: int) -> np.ndarray:
    """How many n-grams each text has; at least 1, to divide by."""
    return np.maximum(1, words.counts() - n + 1)


def feature_rows(b: pa.RecordBatch) -> pa.RecordBatch:
    """Label, and the buckets of a text with their shares, as bytes."""
    words = words_of(b.column(1))
    hashes = words.hashes()
    grams = word_buckets(words, hashes)
    index, value = [], []
    for row in range(b.num_rows):
        begin, end = words.first[row], words.first[row + 1]
        data = words.data[words.offsets[row] : words.offsets[row + 1]]
        parts = [char_buckets(data) if len(data) > 2 else np.zeros(0, np.int32)]
        parts += [buckets[begin:end][inside[begin:end]] for buckets, inside in grams]
        found, place = np.unique(np.concatenate(parts), return_inverse=True)
        share = np.bincount(place, np.concatenate([np.full(len(p), SCALE / max(1, len(p))) for p in parts]), minlength=len(found))
        index.append(found.astype("<i4").tobytes())
        value.append(share.astype("<f4").tobytes())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(index, pa.binary()), pa.array(value, pa.binary())], names=["label", "index", "value"])


@dataclasses.dataclass
class Model:
    """Weights by bucket, an intercept, and the calibration: probability = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def probabilities(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        margin = np.full(len(words.first) - 1, self.intercept)
        for n, (buckets, inside) in zip(ORDERS, word_buckets(words, hashes)):
            gain = np.zeros(len(words))
            gain[: len(buckets)] = self.weights[buckets] * inside
            margin += per_doc(gain, words.first) * SCALE / gram_counts(words, n)
        if len(words.data) > 2:
            gain = np.append(self.weights[char_buckets(words.data)], [0, 0])
            total = np.concatenate([[0], np.cumsum(gain)])
            begin, end = words.offsets[:-1], np.maximum(words.offsets[:-1], words.offsets[1:] - 2)
            margin = margin + (total[end] - total[begin]) * SCALE / np.maximum(1, end - begin)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 120, rate: float = 0.05, ridge: float = 1e-4) -> Model | None:
    """Trains on four fifths of the rows and calibrates on the rest."""
    if len({label for label, _, _ in rows}) < 2 or len(rows) < 10:
        return None
    held = np.arange(len(rows)) % 5 == 0
    label = np.array([r[0] for r in rows], np.float64)
    size = np.array([len(r[1]) for r in rows])
    index, value = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), size)
    learn = ~held[row]
    li, lv, lr = index[learn], value[learn], row[learn]
    balance = np.where(label == 1, 0.5 / max(1, (label[~held] == 1).sum()), 0.5 / max(1, (label[~held] == 0).sum())) * ~held
    weights, intercept = np.zeros(SIZE), 0.0
    m, v, mi, vi = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for t in range(1, steps + 1):
        margin = np.bincount(lr, lv * weights[li], minlength=len(rows)) + intercept
        slip = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - label) * balance
        g = np.bincount(li, lv * slip[lr], minlength=SIZE) + ridge * weights
        gi = slip.sum()
        m, v, mi, vi = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mi + 0.1 * gi, 0.99 * vi + 0.01 * gi * gi
        fade, grow = 1 - 0.9**t, 1 - 0.99**t
        weights -= rate * (m / fade) / (np.sqrt(v / grow) + 1e-8)
        intercept -= rate * (mi / fade) / (np.sqrt(vi / grow) + 1e-8)
    margin = np.bincount(row, value * weights[index], minlength=len(rows)) + intercept
    slope, shift = platt(margin[held], label[held]) if len(set(label[held])) == 2 else (1.0, 0.0)
    return Model(weights, float(intercept), slope, shift)


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets."""
    good, bad = (label == 1).sum(), (label == 0).sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        w, slip = np.maximum(p * (1 - p), 1e-9), p - target
        g = np.array([(slip * margin).sum(), slip.sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(slope), float(shift)) if slope > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample: int = SAMPLE) -> Model | None:
    """Fits the classifier on at most ``sample`` labelled rows of each class."""
    known = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    )
    order = F.xxhash64("id")
    chosen = known.filter("label = 0").orderBy(order, "id").limit(sample).unionByName(known.filter("label = 1").orderBy(order, "id").limit(sample))
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    # at most two samples of ids: small enough to be sent to every task at any size of the input
    one_each = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = map_batches(one_each.select("label", "text"), feature_rows, "label int, index binary, value binary")
    return fit(sorted(((r[0], np.frombuffer(r[1], "<i4"), np.frombuffer(r[2], "<f4")) for r in rows.collect()), key=lambda r: (len(r[1]), r[1].tobytes())))


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and the probability of good quality."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words = words_of(b.column(1))
        hashes = words.hashes()
        figures = base_figures(words, hashes)
        failed = (figures["n_words"] < MIN_WORDS) | (100 * figures["n_repeat_words"] > REPEAT_PERCENT * figures["n_words"])
        good = model.probabilities(words, hashes) if model else None
        kept = ~failed & (good >= threshold) if model else ~failed
        columns = {k: pa.array(v.astype(np.int64)) for k, v in figures.items()}
        columns |= {"base_failed": pa.array(failed), "kept": pa.array(kept), "quality": pa.array(good) if model else pa.nulls(b.num_rows, pa.float64())}
        return pa.RecordBatch.from_arrays([b.column(0), *columns.values()], names=["doc_id", *columns])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(
        rows, run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double",
    )
