"""Exact duplicates by skew-safe combining.

Method: equal texts meet three times, each time among fewer rows. (1) Every task combines the texts of its own batches.
(2) The local winners meet under (digest, salt), so a group that holds a third of all rows is spread over ``salts`` tasks.
(3) The winners of the salts meet under the digest; at most ``salts`` rows of a group are left by then. Each stage compares whole
contents, the digest only says who meets; contents travel compressed, and equal compressed bytes are equal texts.

Defined cases: a null text counts as empty; empty texts form one group; a row without an id comes after all rows with one
and is kept only if its group has no id at all; rows repeated with the same id are all kept if that id is the one that stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.llm.common import back_to_id, bounded_batches, order_key, written

SALTS = 16
CHUNK_BYTES = 16 << 20
# The white space that normalisation folds.
WHITE = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"\x20\x20\x20\x20\x20")
RUNS = re.compile(rb" {2,}")
LOCAL = "ord long, digest binary, winner long, n long, content binary"


def normalise(text: bytes) -> bytes:
    """Each run of white space becomes one space."""
    text = text.translate(WHITE)
    return RUNS.sub(b" ", text) if b"  " in text else text


def combine_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, in chunks of bounded size: every row names the winner among equal texts of its chunk, which alone carries the content."""
    ids, texts, held = [], [], 0
    for b in batches:
        ids.append(b.column(0).to_numpy(zero_copy_only=False))
        texts.append(b.column(1))
        held += b.column(1).nbytes
        if held >= CHUNK_BYTES:
            yield _combined(ids, texts)
            ids, texts, held = [], [], 0
    if ids:
        yield _combined(ids, texts)


def _combined(ids: list[np.ndarray], texts: list[pa.Array]) -> pa.RecordBatch:
    ids = np.concatenate(ids)
    groups: dict[tuple[bytes, bytes], list[int]] = {}
    digests, row = [], 0
    for column in texts:
        for value in column:
            content = normalise((value.as_py() or "").encode())
            digest = hashlib.sha256(content).digest()
            digests.append(digest)
            groups.setdefault((digest, content), []).append(row)
            row += 1
    winner, count, packed = np.zeros(row, np.int64), np.zeros(row, np.int64), [None] * row
    pack = zstandard.ZstdCompressor(level=1).compress
    for (_, content), members in groups.items():
        best = min(members, key=ids.__getitem__)
        winner[members] = ids[best]
        count[best], packed[best] = len(members), pack(content)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(digests, pa.binary()), pa.array(winner), pa.array(count), pa.array(packed, pa.binary())],
        names=["ord", "digest", "winner", "n", "content"],
    )


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row: doc_id, keep_id (smallest id of equal texts), group_size, kept, text_sha256."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(order_key(id_column).alias("ord"), F.col(text_column).cast("string").alias("text"))
    local = written(rows.mapInArrow(combine_locally, LOCAL))

    salted = Window.partitionBy("digest", "salt", "content")
    winners = local.filter("n > 0").select("digest", "winner", "n", "content", F.pmod(F.xxhash64("winner"), F.lit(salts)).alias("salt"))
    winners = winners.withColumns({"salt_winner": F.min("winner").over(salted), "salt_n": F.sum("n").over(salted), "nth": F.row_number().over(salted.orderBy("winner"))})
    winners = written(winners.select("digest", "winner", "salt_winner", F.when(F.col("nth") == 1, F.col("content")).alias("content"), "salt_n", "nth"))

    merged = Window.partitionBy("digest", "content")
    final = (
        winners.filter("nth = 1")
        .withColumns({"keep": F.min("salt_winner").over(merged), "group_size": F.sum("salt_n").over(merged)})
        .select("digest", "salt_winner", "keep", "group_size")
    )
    resolved = winners.select("digest", "winner", "salt_winner").distinct().join(final, ["digest", "salt_winner"])
    return (
        local.select("ord", "digest", "winner")
        .join(resolved.select("digest", "winner", "keep", "group_size"), ["digest", "winner"])
        .select(
            back_to_id("ord").alias("doc_id"), back_to_id("keep").alias("keep_id"), "group_size",
            (F.col("ord") == F.col("keep")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def distinct_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of equal texts."""
    kept = exact_duplicates(docs, id_column, text_column, salts).filter("kept").select(order_key("doc_id").alias("ord"), F.col("text_sha256").alias("sha"))
    normal = F.regexp_replace(F.coalesce(F.col(text_column).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(order_key(id_column).alias("ord"), F.sha2(normal, 256).alias("sha"), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, ["ord", "sha"], "left_semi").dropDuplicates(["ord", "sha"]).select("row.*")
