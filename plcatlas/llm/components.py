"""Connected components: a forest of every partition, then alternating large and small stars, with joins and minima only.

Edges first shrink to a forest in each task, which takes no shuffle. ``CHUNK`` edges or fewer are finished in one task, a number that doesn't depend on the data; more go
through the rounds of the stars until that few are left or nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import written

CHUNK = 1 << 20
EDGE = "lo long, hi long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every linked number with the smallest of its class."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, top = index[: len(a)], index[len(a) :], np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(top[left], top[right]), np.maximum(top[left], top[right])
        if (low == high).all():
            break
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
    other = top != np.arange(len(nodes))
    return nodes[top[other]], nodes[other]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a forest, in chunks of bounded size."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
        if size > CHUNK:
            a, z = forest(*(np.concatenate(c) for c in zip(*held)))
            held, size = [[a, z]], len(a)
            if size > CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["lo", "hi"])
                held, size = [], 0
    if held:
        a, z = forest(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["lo", "hi"])


def components(edges: DataFrame, a: str = "a", b: str = "b", chunk: int = CHUNK) -> DataFrame:
    """node, component (its smallest node) for every node of an edge. Rounds grow with the logarithm of a component's size."""
    pairs = edges.select(F.least(a, b).cast("long").alias("lo"), F.greatest(a, b).cast("long").alias("hi")).filter("lo < hi")
    current = written(pairs.mapInArrow(forests, EDGE))
    size, mark = current.count(), None
    while size > chunk:
        both = current.unionByName(current.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        large = both.filter("hi > lo").join(least, "lo").select("hi", "m").distinct()
        lowest = large.groupBy("hi").agg(F.min("m").alias("lo"))
        small = large.join(lowest, "hi")
        current = written(
            small.select("lo", "hi").unionByName(small.select("lo", F.col("m").alias("hi"))).filter("lo < hi").distinct()
        )
        before, mark = mark, _mark(current)
        if mark == before:
            break
        size = mark[0]
    else:
        current = written(current.coalesce(1).mapInArrow(forests, EDGE))
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi") % 1_000_003), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return tuple(row)
