"""Conversations in the order of their turns, in pieces of bounded size.

Rows are range-sorted by conversation and turn, so a conversation that holds a third of all rows is spread over many partitions. A piece is the part of a conversation in
one Arrow batch; ``whole`` says that nothing of it can be anywhere else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plcatlas.llm.common import bounded_batches

LONG_CARRY = 2 << 20


def ordered(rows: DataFrame, keys: Sequence) -> DataFrame:
    """``rows`` sorted by ``keys`` (the conversation first), in ranges of about equal size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)


def pieces(rows: DataFrame, function: Callable[[pa.RecordBatch, np.ndarray, list[bool], int], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``function(rows, offsets, whole, seq)`` to the batches of sorted ``rows``, whose first column names the conversation.

    Rows ``offsets[k]`` to ``offsets[k + 1]`` are one piece; (part, seq + k) is its place. The last conversation of a batch
    waits for the next one unless it is very long, so short ones are split at the ends of a partition only.
    """
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, carry, open_left = TaskContext.get().partitionId(), 0, None, True
        for batch in _with_end(batches):
            last = batch is None
            held = [x for x in (carry, batch) if x is not None and x.num_rows]
            if not held:
                continue
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            first = b.column(0)
            change = np.zeros(b.num_rows, bool)
            change[0] = True
            if b.num_rows > 1:
                same = pc.equal(first[1:], first[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                none = first.is_null().to_numpy(zero_copy_only=False)
                change[1:] = ~(same | (none[1:] & none[:-1]))
            starts = np.flatnonzero(change)
            carry = None if last else b.slice(starts[-1])
            waits = carry is not None and carry.nbytes < LONG_CARRY
            bounds = starts if waits else np.append(starts, b.num_rows)
            if not waits:
                carry = None
            if len(bounds) > 1:
                whole = [True] * (len(bounds) - 1)
                whole[0] = not open_left
                # the last one may go on in what follows, be it of this partition or of the next
                whole[-1] = whole[-1] and waits
                yield function(b.slice(0, bounds[-1]), bounds, whole, part, seq)
                seq += len(bounds) - 1
                open_left = not waits
    return rows.mapInArrow(run, schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    for b in batches:
        if b.num_rows:
            yield b
    yield None


def as_lists(column: pa.Array, offsets: np.ndarray) -> pa.Array:
    """The rows of each piece as one list."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), column)
