"""Helpers the operators share: bounded Arrow batches, written stages, row keys that stand nulls and repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.session import cut_lineage

BATCH_BYTES = 8 << 20
NO_ID = (1 << 63) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def written(df: DataFrame) -> DataFrame:
    """Writes a stage to the shared checkpoint folder and reads it back.

    The shuffle files that only served to make it are deleted as soon as it stands, so the disk in use is that of the
    largest stage and not of all of them; a lost executor costs at most the stage it was working on.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def order_key(id_column: str) -> Column:
    """The id as a number to compare and join by; rows without an id come after all others."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))


def back_to_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))
