"""The event log as a stream.

The aggregations are those of :mod:`plcatlas.operators.telemetry`. The log has no event-time rules of its own, so the
watermark is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.operators import telemetry
from plcatlas.streaming import processors

WATERMARK = "10 minutes"


def read_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of a directory of JSON-lines files; feed them to ``telemetry.parse_events``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def counts(events: DataFrame, interval: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Running counts per kind (update or complete mode), or counts per interval and kind (any mode)."""
    if interval is None:
        return telemetry.count_by_kind(events)
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", interval).alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("start"), "kind", "count")
    )


def latest_stage(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The current stage; update or complete mode. State is one value per key."""
    return telemetry.latest_stage(events, by)


def overflow(events: DataFrame, capacity: int, interval: str = "1 second", watermark: str = WATERMARK) -> DataFrame:
    return telemetry.overflow(events.withWatermark("ts", watermark), capacity, interval)


def tool_calls(events: DataFrame) -> DataFrame:
    """Calls of a stream, in append mode: a batch gives the row of every call it touches; :func:`current_calls` keeps the last one of each.

    State is one value a call, without a time limit, so a call may stay open, or be opened again, at any time.
    """
    rows = telemetry.call_events(events).select("callId", "id", F.unix_millis("ts").alias("ms"), "kind", "tool", "argsPreview", "durationMs", "error")
    out = rows.groupBy("callId").transformWithStateInPandas(processors.Calls(), processors.schema(processors.CALL_ROW), "Append", "None")
    return out.select("call_id", "version", "tool", F.timestamp_millis("started_ms").alias("started_at"), "args_preview", "duration_ms", "status", "error")


def current_calls(changes: DataFrame) -> DataFrame:
    """The last row of each call, of a table of what :func:`tool_calls` gave."""
    return _last(changes, ["call_id"])


def index_runs(events: DataFrame, by: Sequence[str] = (), log: str | None = None) -> DataFrame:
    """Index runs of a stream, in append mode: a batch gives the row of every run it touches; :func:`current_runs` keeps the last one of each.

    ``by`` may hold ``workspace``, as for the batch operator. A log is one sequence of events; ``log`` names the column that tells logs apart, each of which is read on
    its own. Batches follow each other in the order of ids, as the log is written.
    """
    if set(by) - {"workspace"}:
        raise ValueError(f"runs of a stream are divided by workspace only: {list(by)}")
    rows = events.filter(F.col("kind").isin(*telemetry.RUN_KINDS)).select(
        (F.col(log).cast("string") if log else F.lit("log")).alias("log"), "id", "kind", "workspace",
        *[F.col(c).cast("bigint").alias(c) for c in ("totalFiles", "indexedFiles", "skippedFiles", "totalEntities", "totalEdges", "totalTimeMs", "duration", "entities", "edges")],
    )
    return rows.groupBy("log").transformWithStateInPandas(processors.Runs("workspace" in by), processors.schema(processors.RUN_ROW), "Append", "None")


def current_runs(changes: DataFrame) -> DataFrame:
    """The last row of each run, of a table of what :func:`index_runs` gave."""
    return _last(changes, ["log", "run"])


def _last(changes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "version")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*keys, "r.*")


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and write its rows as parquet.

    Append mode adds rows; complete mode keeps the last result.
    """
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(_keep_last(path)).start()
    query.awaitTermination()


def _keep_last(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)

    return write
