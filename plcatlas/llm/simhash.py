"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Method: two fingerprints that differ in at most ``radius`` bits have a number half-way between them, at most ``radius / 2`` bits from either. So every
distinct fingerprint emits all numbers within half the radius (2,081 of 64 bits and two flips), equal variants meet, and fingerprints that meet in one are linked;
the pair is verified bit by bit. All fingerprints of one variant are within the radius of each other, so a star about the smallest says
the same as all pairs, and each shard returns no more than a forest over what it links.

Shuffle: a variant's shard is a linear hash (exclusive or) of its bits, so the shard of ``x ^ flips`` is the shard of ``x`` exclusive or that of ``flips``. A task therefore
sends a fingerprint once to each shard that holds variants of it, and the shard makes them again from it: the key of the shuffle is the variant,
what travels is eight bytes a fingerprint and shard. The number of shards grows with the number of fingerprints, so that a shard holds some ``SHARD`` variants;
flips spread a fingerprint's variants evenly over all shards, also those of a group of near copies. A pass handles a range of shards; the number of
passes follows from the bytes a fingerprint sends in all, so the disk in use stays bounded a document.

Defined cases: null, empty and blank texts have the fingerprint zero and are linked like any other; a text of fewer words than a shingle is one shingle; texts of any
length are hashed in blocks; a document without an id takes part, its ``doc_id`` is null, and ``component_id`` is the smallest id in its class, null if there is none;
repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import bounded_batches, map_batches, written
from plcatlas.llm.components import components, forest

SHINGLE = 4
RADIUS = 4
SEED = 42
BITS = 64
SHARD = 1 << 21
LEAST_SHARDS = 8
PASS_BYTES = 1500
BLOCK = 1 << 14
EMIT = 1 << 12


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Bit by bit, whether more than half of the shingles' hashes have it set; the hash is XXH64 with seed 42 of the words joined by spaces."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) >= n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << bit for bit in np.flatnonzero(2 * counts > len(starts)).tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, print (the fingerprint as a signed 64-bit number), one row a row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t.as_py(), n) for t in b.column(1)], np.uint64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return map_batches(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), run, "doc_id long, print long")


class Shards:
    """The flips of at most ``half`` bits, sorted by their own shard, and the shard of any number."""

    def __init__(self, half: int, bits: int):
        flips = [0]
        for k in range(1, half + 1):
            flips += [sum(1 << b for b in chosen) for chosen in combinations(range(BITS), k)]
        rnd = np.random.default_rng(20260101)
        self.bits = bits
        self.rows = rnd.integers(1, 1 << 63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        flips = np.array(flips, np.uint64)
        shard = self.of(flips)
        order = np.argsort(shard, kind="stable")
        self.flips = flips[order]
        self.shards, self.first, self.count = np.unique(shard[order], return_index=True, return_counts=True)

    def of(self, x: np.ndarray) -> np.ndarray:
        """A shard's number has one bit for each row: the parity of what the row picks out."""
        out = np.zeros(len(x), np.int64)
        for k in range(self.bits):
            out |= (np.bitwise_count(x & self.rows[k]) & 1).astype(np.int64) << k
        return out

    def variants(self, x: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The variants of ``x`` in a shard, and the fingerprint of each."""
        own = self.of(x) ^ shard
        at = np.minimum(np.searchsorted(self.shards, own), len(self.shards) - 1)
        count = np.where(self.shards[at] == own, self.count[at], 0)
        owner = np.repeat(x, count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        return owner ^ self.flips[np.repeat(self.first[at], count) + step], owner


def sent(b: pa.RecordBatch, shards: Shards, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """For each shard in ``low`` to ``high`` the fingerprints with a variant there, packed."""
    prints = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    for at in range(0, len(prints), EMIT):
        x = prints[at : at + EMIT]
        target = shards.of(x)[:, None] ^ shards.shards[None, :]
        row, column = np.nonzero((target >= low) & (target < high))
        target = target[row, column]
        order = np.argsort(target, kind="stable")
        target, packed = target[order], x[row[order]]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        blobs = [packed[a:z].tobytes() for a, z in zip(first, np.append(first[1:], len(target)))]
        yield pa.RecordBatch.from_arrays([pa.array(target[first]), pa.array(blobs, pa.binary())], names=["shard", "prints"])


def met(prints: np.ndarray, shards: Shards, shard: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard that have a variant in common, verified, as a forest."""
    variant, owner = shards.variants(prints, shard)
    ordered = np.sort(variant)
    common = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(common):
        return common, common
    at = np.minimum(np.searchsorted(common, variant), len(common) - 1)
    hit = common[at] == variant
    at, owner = at[hit], owner[hit]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    centre = np.repeat(owner[first], np.diff(np.append(first, len(at))))
    close = (np.bitwise_count(centre ^ owner) <= radius) & (centre != owner)
    return forest(centre[close], owner[close])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of a table of distinct fingerprints whose classes are those of all pairs within ``radius``."""
    total = prints.count()
    shards = Shards(radius // 2, 0)
    bits = max(LEAST_SHARDS, int(np.ceil(np.log2(max(1, total) * len(shards.flips) / SHARD))))
    shards = Shards(radius // 2, bits)
    passes = min(1 << bits, -(-8 * len(shards.shards) // PASS_BYTES))
    found = None
    for k in range(passes):
        low, high = (k << bits) // passes, ((k + 1) << bits) // passes

        def send(b: pa.RecordBatch, low=low, high=high) -> Iterator[pa.RecordBatch]:
            return sent(b, shards, low, high)

        here = map_batches(prints.select("print"), send, "shard long, prints binary").repartition("shard").sortWithinPartitions("shard")
        here = written(here.mapInArrow(lambda batches: met_links(batches, shards, radius), "a long, b long"))
        found = here if found is None else found.unionByName(here)
    return found


def met_links(batches: Iterator[pa.RecordBatch], shards: Shards, radius: int) -> Iterator[pa.RecordBatch]:
    """What each shard of a sorted partition links; a shard's fingerprints are bounded by ``SHARD``."""
    held, shard = [], None

    def flush():
        a, b = met(np.unique(np.concatenate(held)), shards, shard, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key != shard and held:
                yield flush()
                held = []
            shard = key
            held.append(np.frombuffer(blob.as_buffer(), np.uint64))
    if held:
        yield flush()


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row a row."""
    if radius % 2:
        raise ValueError("the radius has to be even")
    bounded_batches(docs.sparkSession)
    rows = written(fingerprints(docs, id_column, text_column, n))
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("low")))
    classes = components(links(prints, radius)).select(F.col("node").alias("print"), "component")
    placed = prints.join(classes, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    known = written(placed.join(least, "component").select("print", "component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(known, "print").select("doc_id", hexed, "component_id")
