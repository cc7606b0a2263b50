"""Repeated passages across documents.

Method: windows of ``n`` words are the edges of a De Bruijn graph. (1) Each window is represented by the smallest hash among its ``k``-word
grams (its minimizer; equal windows have equal ones), so few keys tell which windows can be repeated at all. (2) Only windows of repeated
minimizers become edges; equal edges meet, and each occurrence learns the coordinates of one in a smaller document. (3) Edges that follow each
other in both documents are compacted into one path: a span, its length and its source coordinates. (4) Spans meet their sources through joins:
a second, independent digest of the whole path is computed at the source and has to be found again in the document before
any word is removed.

Hot passages: equal keys of one batch are combined before they are shuffled, so a passage that a third of all documents share reaches its task
once a batch and not once a document. Neither minimizers nor windows are ever capped.

Defined cases: a null text has no words; texts shorter than a window lose nothing; a document without an id comes after all with one, and those
without don't remove each other's words; an id names one text, and repeated rows of it get the same result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import NO_ID, back_to_id, bounded_batches, map_batches, order_key, written
from plcatlas.llm.words import Words, gram_hashes, mix, signed, words_of

WINDOW = 13
GRAM = 5
LONE, SHARED, KNOWN = 0, 1, 2
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPAN = "ord long, tie long, start int, n int, src long, src_tie long, src_start int"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def edges(words: Words, hashes: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows within one text, and their minimizers."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = sliding_min(gram_hashes(hashes, k), n - k + 1)
    at = np.flatnonzero(words.doc[:count] == words.doc[n - 1 :])
    return at, low[at]


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return first, np.diff(np.append(first, len(sorted_keys)))


def paired(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def long_column(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).to_numpy(zero_copy_only=False)


def minimizer_rows(b: pa.RecordBatch, n: int, k: int) -> pa.RecordBatch:
    """Distinct minimizers of each text; those that two texts of the batch share are known to be repeated."""
    words = words_of(b.column(2))
    at, low = edges(words, words.hashes(), n, k)
    doc = words.doc[at]
    _, index = np.unique(paired(doc, low), return_index=True)
    doc, low = doc[index], low[index]
    ord_, tie = long_column(b, 0)[doc], long_column(b, 1)[doc]
    order = np.lexsort((ord_, low))
    low, ord_, tie = low[order], ord_[order], tie[order]
    first, length = runs(low)
    least, most = ord_[first], ord_[first + length - 1] if len(first) else ord_[:0]
    kind = np.where(np.repeat(least != most, length), np.where(ord_ == np.repeat(least, length), SHARED, KNOWN), LONE)
    return pa.RecordBatch.from_arrays([pa.array(signed(low)), pa.array(ord_), pa.array(tie), pa.array(kind.astype(np.int8))], names=["key", "ord", "tie", "kind"])


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal first values is split. Runs are bounded by what batches left of a key."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not len(columns[0]):
            continue
        key = columns[0]
        # a batch that only goes on with the key that waits is put aside as it is
        if held and held[-1][0][-1] == key[0] == key[-1]:
            held.append(columns)
            continue
        joined = [np.concatenate(c) for c in zip(*held, columns)] if held else columns
        cut = np.searchsorted(joined[0], key[-1])
        held = [[c[cut:] for c in joined]]
        if cut:
            yield [c[:cut] for c in joined]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def repeated_minimizers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps keys that stand in two documents."""
    for key, ord_, tie, kind in sorted_groups(batches):
        first, length = runs(key)
        low, high = np.minimum.reduceat(ord_, first), np.maximum.reduceat(ord_, first)
        keep = np.repeat(low != high, length) | (kind != LONE)
        yield pa.RecordBatch.from_arrays([pa.array(ord_[keep]), pa.array(tie[keep]), pa.array(key[keep])], names=["ord", "tie", "key"])


def islands(ord_, tie, at, src, src_tie, src_at) -> pa.RecordBatch:
    """Compacts edges, sorted by document and place, into paths: both ends move on by one word."""
    if not len(ord_):
        first, length = np.zeros(0, np.int64), np.zeros(0, np.int64)
    else:
        joined = np.zeros(len(ord_), dtype=bool)
        joined[1:] = (
            (ord_[1:] == ord_[:-1]) & (tie[1:] == tie[:-1]) & (at[1:] == at[:-1] + 1) & (src[1:] == src[:-1])
            & (src_tie[1:] == src_tie[:-1]) & (src_at[1:] == src_at[:-1] + 1)
        )
        first = np.flatnonzero(~joined)
        length = np.diff(np.append(first, len(ord_)))
    columns = [ord_[first], tie[first], at[first].astype(np.int32), length.astype(np.int32), src[first], src_tie[first], src_at[first].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in SPAN.split(", ")])


def edge_rows(b: pa.RecordBatch, n: int, k: int) -> Iterator[pa.RecordBatch]:
    """Edges with a repeated minimizer. Those with an equal one in a smaller document of the batch are paths at once; the others have to meet the rest."""
    words = words_of(b.column(2))
    hashes = words.hashes()
    at, low = edges(words, hashes, n, k)
    lists = b.column(3)
    wanted = paired(np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    at = at[np.isin(paired(words.doc[at], low), wanted)]
    key, doc = gram_hashes(hashes, n, 11)[at] if len(at) else np.zeros(0, np.uint64), words.doc[at]
    place = at - words.first[doc]
    ord_, tie = long_column(b, 0)[doc], long_column(b, 1)[doc]
    order = np.lexsort((place, ord_, key))
    key, ord_, tie, place = key[order], ord_[order], tie[order], place[order]
    first, length = runs(key)
    head = np.repeat(first, length)
    known = ord_ != ord_[head]
    rest = ~known
    empty = pa.nulls(int(rest.sum()), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(signed(key[rest])), pa.array(ord_[rest]), pa.array(tie[rest]), pa.array(place[rest].astype(np.int32)), pa.array(np.zeros(rest.sum(), np.int32)), empty, empty, empty.cast(pa.int32())],
        names=EDGE_NAMES,
    )
    ord_, tie, place, head_known = ord_[known], tie[known], place[known], head[known]
    src = [c[head_known] for c in (long_column(b, 0)[doc][order], long_column(b, 1)[doc][order], (at - words.first[doc])[order])]
    by_place = np.lexsort((place, tie, ord_))
    found = islands(*(c[by_place] for c in (ord_, tie, place, *src)))
    yield pa.RecordBatch.from_arrays([pa.nulls(found.num_rows, pa.int64()), *found.columns], names=EDGE_NAMES)


EDGES = "key long, " + SPAN
EDGE_NAMES = [x.split()[0] for x in EDGES.split(", ")]


def sourced_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives edges that stand in a smaller document the coordinates there."""
    for key, ord_, tie, at in sorted_groups(batches):
        first, length = runs(key)
        head = np.repeat(first, length)
        keep = ord_ != ord_[head]
        head = head[keep]
        ones = np.ones(len(head), np.int32)
        columns = [ord_[keep], tie[keep], at[keep], ones, ord_[head], tie[head], at[head]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in SPAN.split(", ")])


def compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ord_, tie, at, _, src, src_tie, src_at = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        yield islands(ord_, tie, at, src, src_tie, src_at)


def path_digests(words: Words, doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A digest of ``size`` words from word ``start`` of row ``doc``, by a hash that the keys don't use; 0 where there are no such words."""
    hashes = words.hashes(seed=977)
    count = len(hashes)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, BASE, np.uint64)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count, BASE_INVERSE, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:-1])])
    begin = words.first[doc] + start
    fits = begin + size <= words.first[doc + 1]
    begin, end = np.where(fits, begin, 0), np.where(fits, begin + size, 0)
    return np.where(fits, mix((total[end] - total[begin]) * back[begin] + size.astype(np.uint64)), np.uint64(0))


def listed(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of each struct in a list column, and the structs' fields."""
    column = b.column(i)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(b.num_rows), lengths), [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]


def source_digests(b: pa.RecordBatch, n: int) -> pa.RecordBatch:
    words = words_of(b.column(2))
    doc, (start, length) = listed(b, 3)
    digest = path_digests(words, doc, start, length + n - 1)
    ord_, tie = long_column(b, 0)[doc], long_column(b, 1)[doc]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (ord_, tie, start, length, signed(digest))], names=["src", "src_tie", "src_start", "n", "digest"])


def kept_rows(b: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """Verifies each span against its source's digest, removes its words, and hashes what is left."""
    words = words_of(b.column(2))
    gone = np.zeros(len(words) + 1, np.int64)
    doc, fields = listed(b, 3)
    if len(doc):
        start, length, digest = fields
        true = signed(path_digests(words, doc, start, length + n - 1)) == digest
        begin = words.first[doc][true] + start[true]
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + length[true] + n - 1, -1)
    keep = np.cumsum(gone)[:-1] == 0
    removed = np.concatenate([[0], np.cumsum(~keep)])
    removed = removed[words.first[1:]] - removed[words.first[:-1]]
    digests = []
    for row in range(b.num_rows):
        own = words.data[words.offsets[row] : words.offsets[row + 1]].tobytes().split()
        if removed[row]:
            own = compress(own, keep[words.first[row] : words.first[row + 1]].tolist())
        digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(words.counts()), pa.array(removed), pa.array(digests, pa.string())], names=["ord", "n_words", "n_removed", "kept_sha256"])


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """ord, tie, text: rows without an id are told apart by their text."""
    rows = docs.select(order_key(id_column).alias("ord"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return rows.select("ord", F.when(F.col("ord") == NO_ID, F.xxhash64("text")).otherwise(0).alias("tie"), "text")


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Paths of repeated windows: ord, tie, start, n (windows), src, src_tie, src_start; every row's source is a smaller document."""
    k = min(k, n)
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_column, text_column)
    minimizers = map_batches(rows, lambda b: minimizer_rows(b, n, k), "key long, ord long, tie long, kind byte")
    # what is known to be repeated need not meet its key
    route = F.when(F.col("kind") == KNOWN, F.xxhash64("ord")).otherwise(F.col("key"))
    met = minimizers.withColumn("route", route).repartition("route").drop("route").sortWithinPartitions("key")
    repeated = met.mapInArrow(repeated_minimizers, "ord long, tie long, key long")
    lists = repeated.groupBy("ord", "tie").agg(F.collect_list("key").alias("keys"))
    found = written(map_batches(rows.join(lists, ["ord", "tie"]).select("ord", "tie", "text", "keys"), lambda b: edge_rows(b, n, k), EDGES))

    open_edges = found.filter("key is not null").select("key", "ord", "tie", "start")
    sourced = open_edges.repartition("key").sortWithinPartitions("key", "ord", "start").mapInArrow(sourced_edges, SPAN)
    paths = sourced.repartition("ord", "tie").sortWithinPartitions("ord", "tie", "start").mapInArrow(compacted, SPAN)
    return written(paths.unionByName(found.filter("key is null").drop("key")))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WINDOW, k: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    spans = repeated_spans(docs, id_column, text_column, n, k)
    rows = keyed(docs, id_column, text_column)
    asked = spans.select("src", "src_tie", "src_start", "n").distinct()
    asked = asked.groupBy(F.col("src").alias("ord"), F.col("src_tie").alias("tie")).agg(F.collect_list(F.struct("src_start", "n")).alias("asked"))
    digests = map_batches(
        rows.join(asked, ["ord", "tie"]).select("ord", "tie", "text", "asked"),
        lambda b: source_digests(b, n), "src long, src_tie long, src_start int, n int, digest long",
    )
    checked = written(spans.join(digests.distinct(), ["src", "src_tie", "src_start", "n"]).select("ord", "tie", "start", "n", "digest"))
    own = checked.groupBy("ord", "tie").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))
    result = map_batches(
        rows.join(own, ["ord", "tie"], "left").select("ord", "tie", "text", "spans"), lambda b: kept_rows(b, n),
        "ord long, n_words long, n_removed long, kept_sha256 string",
    )
    return result.select(back_to_id("ord").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
