"""The event log: counts, index runs, tool calls, stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plcatlas.schemas import EVENTS, conform, struct_of

# Event kinds and index stages.
HIDDEN_KINDS = ("ws_client_connected", "ws_client_disconnected", "server_started", "server_stopped")
RUN_KINDS = ("index_started", "index_file_done", "index_file_failed", "index_done", "index_completed")
DONE_KINDS = ("index_done", "index_completed")
FAILED_KINDS = ("index_file_failed", "index_failed")
CALL_KINDS = ("tool_started", "tool_completed", "tool_failed")
STAGES = (
    "preparing", "lsp_open", "parsing", "extracting", "building_edges", "resolving", "persisting", "cleanup", "done",
)
HISTORY = 1000
# Sketches of durations: their size, and the rank error they keep with 99 % confidence.
SKETCH_K, SKETCH_ERROR = 400, 0.01
CALL_LIMIT = 50
RUN_BUCKET_IDS = 1_000_000
NO_START = -1


def parse_events(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(events, malformed lines)`` of a table of JSON texts; works on streams and tables.

    An event has a numeric id, a numeric time in epoch milliseconds and a kind; anything else is malformed.
    """
    wire = ", ".join(
        f"`{f.name}` BIGINT" if f.name == "ts" else f"`{f.name}` {f.dataType.simpleString()}"
        for f in struct_of(EVENTS).fields
    )
    parsed = lines.withColumn("_e", F.from_json(F.col(column), wire))
    valid = F.col("_e.id").isNotNull() & F.col("_e.ts").isNotNull() & F.col("_e.kind").isNotNull()
    events = parsed.filter(valid).select("_e.*").withColumn("ts", F.timestamp_millis("ts"))
    malformed = parsed.filter(~F.coalesce(valid, F.lit(False))).select(F.col(column).alias("line"))
    return conform(events, EVENTS), malformed


def count_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def visible(events: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Events of the wanted kinds (all if none is named) without connection and server notices."""
    shown = events.filter(~F.col("kind").isin(*HIDDEN_KINDS))
    return shown.filter(F.col("kind").isin(*kinds)) if kinds else shown


def recent(events: DataFrame, limit: int = HISTORY, since_id: int | None = None) -> DataFrame:
    """Newest events, at most ``limit``, newest first."""
    rows = events if since_id is None else events.filter(F.col("id") > since_id)
    return rows.orderBy(F.desc("id")).limit(limit)


def failed_files(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("kind").isin(*FAILED_KINDS)).alias("failed_files"))


def latest_stage(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = events.filter((F.col("kind") == "lsp_progress") & F.col("stage").isNotNull())
    return rows.groupBy(*by).agg(F.max_by("stage", "id").alias("stage"))


STATS_FIELDS = ("pous", "variables", "types", "relationships", "files", "dbBytes")


def latest_stats(events: DataFrame) -> DataFrame:
    """The last statistics snapshot in which all six numbers are present."""
    rows = events.filter(F.col("kind") == "sqlite_stats").dropna(subset=list(STATS_FIELDS))
    latest = rows.agg(F.max(F.struct("id", *STATS_FIELDS)).alias("s")).filter("s IS NOT NULL")
    return latest.select("s.*")


def overflow(events: DataFrame, capacity: int, interval: str = "1 second") -> DataFrame:
    """Intervals with more events than ``capacity``, and how many are over it."""
    return (
        events.groupBy(F.window("ts", interval).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("w.start").alias("start"), "events",
            F.greatest(F.col("events") - capacity, F.lit(0)).alias("dropped"), F.lit(capacity).alias("capacity"),
        )
        .filter("dropped > 0")
    )


def file_durations(events: DataFrame) -> DataFrame:
    return (
        events.filter("kind = 'index_file_done' AND durationMs IS NOT NULL")
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("runs"), F.avg("durationMs").alias("avg_ms"), F.max("durationMs").alias("max_ms"),
        )
    )


def duration_sketches(events: DataFrame, by: Sequence[str] = ("file",), k: int = SKETCH_K) -> DataFrame:
    """``(*by, day, runs, sketch)``: KLL sketches of the durations of a day; days merge without the events."""
    done = events.filter("kind = 'index_file_done' AND durationMs IS NOT NULL").withColumn("day", F.to_date("ts"))
    return done.groupBy(*by, "day").agg(
        F.count(F.lit(1)).alias("runs"), F.kll_sketch_agg_bigint(F.col("durationMs").cast("bigint"), k).alias("sketch")
    )


def duration_quantiles(
    sketches: DataFrame, by: Sequence[str] = ("file",), ranks: Sequence[float] = (0.5, 0.95, 0.99)
) -> DataFrame:
    """``(*by, runs, p50, p95, p99)`` of merged sketches, each within ``SKETCH_ERROR`` of its rank."""
    merged = sketches.groupBy(*by).agg(F.sum("runs").alias("runs"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(
        *by, "runs", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r))).alias(f"p{round(r * 100)}") for r in ranks]
    )


def stage_progress(events: DataFrame) -> DataFrame:
    """The furthest stage each file has reached."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    rows = events.filter("kind = 'lsp_progress' AND stage IS NOT NULL").withColumn("rank", rank)
    return (
        rows.groupBy("file")
        .agg(F.max("rank").alias("rank"))
        .select("file", F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("rank").cast("int")).alias("stage"))
    )


# ---- index runs ----


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def with_workspace(events: DataFrame, bucket_ids: int = RUN_BUCKET_IDS, workspace: str | None = None) -> DataFrame:
    """Gives events that name no workspace that of the last start before them; only starts and ends of runs name it themselves.

    A running maximum over the id order in two levels, as in ``mark_runs``. ``workspace`` is that of the last start of an earlier part of the log.
    """
    start = F.when(F.col("kind") == "index_started", F.struct("id", "workspace"))
    rows = events.withColumn("_block", F.floor(F.col("id") / bucket_ids)).withColumn("_w", start)
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.max("_w").alias("_w")).select("_block", F.max("_w").over(before).alias("_bw"))
    inside = W.partitionBy("_block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.withColumn("_w", F.max("_w").over(inside)).join(blocks, "_block")
    found = F.coalesce("workspace", F.greatest("_w", "_bw")["workspace"], F.lit(workspace).cast("string"))
    return joined.withColumn("workspace", found).select(*events.columns)


def mark_runs(
    events: DataFrame, by: Sequence[str] = (), bucket_ids: int = RUN_BUCKET_IDS
) -> DataFrame:
    """Events of index runs with ``run`` (id of the start before them) and ``closed`` (an end came in between).

    Both are running maxima over the id order. They are taken in two levels: inside blocks of ``bucket_ids``
    consecutive ids, and over the few rows that sum up the blocks. One log, or one workspace with most of the events,
    therefore spreads over as many tasks as it has blocks. Divided by workspace, events without one belong to the last start before them.
    """
    by = list(by)
    kind = F.col("kind")
    events = events.filter(kind.isin(*RUN_KINDS))
    if "workspace" in by:
        events = with_workspace(events, bucket_ids)
    rows = (
        events
        .withColumn("_block", F.floor(F.col("id") / bucket_ids))
        .withColumn("_s", F.when(kind == "index_started", F.col("id")))
        .withColumn("_d", F.when(kind.isin(*DONE_KINDS), F.col("id")))
    )
    blocks = rows.groupBy(*by, "_block").agg(F.max("_s").alias("_s"), F.max("_d").alias("_d"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*by, "_block", F.max("_s").over(before).alias("_bs"), F.max("_d").over(before).alias("_bd"))
    inside = W.partitionBy(*by, "_block").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumn("_s", F.max("_s").over(inside)).withColumn("_d", F.max("_d").over(inside))
    joined = join_by(local, blocks, [*by, "_block"])
    run = F.coalesce(F.greatest("_s", "_bs"), F.lit(NO_START))
    closed = F.coalesce(F.greatest("_d", "_bd"), F.lit(NO_START))
    return joined.select(*events.columns, run.alias("run"), (closed > run).alias("closed"))




def run_parts(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One mergeable row per run: last-by-id values as ``(id, ...)`` structs, counts as sums."""
    kind = F.col("kind")
    workspace = F.col("workspace")
    done = kind.isin(*DONE_KINDS)
    open_file = ~F.col("closed") & (kind == "index_file_done")
    elapsed = F.coalesce(F.when(kind == "index_done", F.col("totalTimeMs")).otherwise(F.col("duration")), F.lit(0))
    last = lambda when, *values: F.max(F.when(when, F.struct("id", *values)))
    present = lambda c: (kind == "index_done") & F.col(c).isNotNull()
    indexed_at_done = F.when(kind == "index_done", F.col("indexedFiles"))
    return marked.groupBy(*by, "run").agg(
        last(kind == "index_started", workspace, F.col("totalFiles")).alias("started"),
        last(done, workspace, indexed_at_done.alias("indexedFiles"), elapsed.alias("elapsed")).alias("done"),
        last(present("indexedFiles"), F.col("indexedFiles").alias("n")).alias("indexed"),
        last(present("skippedFiles"), F.col("skippedFiles").alias("n")).alias("skipped"),
        last(present("totalEntities"), F.col("totalEntities").cast("bigint").alias("n")).alias("total_entities"),
        last(present("totalEdges"), F.col("totalEdges").cast("bigint").alias("n")).alias("total_edges"),
        F.count_if(open_file).alias("file_count"),
        F.coalesce(F.sum(F.when(open_file, F.col("entities"))), F.lit(0)).alias("file_entities"),
        F.coalesce(F.sum(F.when(open_file, F.col("edges"))), F.lit(0)).alias("file_edges"),
        F.count_if(~F.col("closed") & (kind == "index_file_failed")).alias("failed"),
    )


def summarise_runs(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    indexed = F.coalesce("indexed.n", "file_count")
    skipped = F.coalesce("skipped.n", F.lit(0))
    finished = F.col("done").isNotNull()
    total = F.coalesce(
        F.col("started.totalFiles"),
        F.col("done.indexedFiles") + skipped + F.col("failed"),
        indexed + skipped + F.col("failed"),
    )
    keep = (F.col("run") != NO_START) | finished | (F.col("file_count") > 0)
    keys = [F.col(c) for c in by if c != "workspace"]
    name = F.coalesce("started.workspace", "done.workspace", F.lit("(unknown)"))
    return parts.filter(keep).select(
        *keys, name.alias("workspace"), "run", total.cast("bigint").alias("total_files"),
        indexed.cast("bigint").alias("indexed_files"), skipped.cast("bigint").alias("skipped_files"),
        F.coalesce("total_entities.n", "file_entities").alias("total_entities"),
        F.coalesce("total_edges.n", "file_edges").alias("total_edges"), "failed",
        F.coalesce("done.elapsed", F.lit(0)).alias("total_time_ms"),
        F.when(finished, "completed").when(F.col("failed") > 0, "failed").otherwise("running").alias("status"),
    )


def index_runs(events: DataFrame, by: Sequence[str] = (), bucket_ids: int = RUN_BUCKET_IDS) -> DataFrame:
    """One row per index run, each as the log's reader sees it at the end of the run."""
    return summarise_runs(run_parts(mark_runs(events, by, bucket_ids), by), by)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run per workspace."""
    rest = [c for c in runs.columns if c not in ("workspace", "run")]
    return (
        runs.groupBy("workspace")
        .agg(F.max(F.struct("run", *rest)).alias("r"))
        .select("workspace", "r.*")
    )


# ---- tool calls ----


def call_aggregates() -> list[Column]:
    """Start, first end and last end of a call."""
    ended = F.col("kind").isin("tool_completed", "tool_failed")
    error = F.when(F.col("kind") == "tool_failed", F.coalesce("error", F.lit("(unknown error)")))
    duration = F.coalesce("durationMs", F.lit(0))
    return [
        F.max(F.when(F.col("kind") == "tool_started", F.struct("id", "ts", "tool", "argsPreview"))).alias("s"),
        F.min(F.when(ended, F.struct("id", "ts", duration.alias("durationMs")))).alias("e1"),
        F.max(F.when(ended, F.struct("id", "tool", duration.alias("durationMs"), "kind", error.alias("error")))).alias("e"),
    ]


def call_columns() -> list[Column]:
    running = F.col("e").isNull() | (F.col("s.id") > F.col("e.id"))
    running = F.coalesce(running, F.lit(False))
    guessed = F.timestamp_millis(F.unix_millis("e1.ts") - F.col("e1.durationMs"))
    return [
        F.when(running, F.col("s.tool")).otherwise(F.col("e.tool")).alias("tool"),
        F.coalesce("s.ts", guessed).alias("started_at"),
        F.coalesce("s.argsPreview", F.lit("")).alias("args_preview"),
        F.when(~running, F.col("e.durationMs")).alias("duration_ms"),
        F.when(running, "running").when(F.col("e.kind") == "tool_completed", "completed").otherwise("failed").alias("status"),
        F.when(~running, F.col("e.error")).alias("error"),
    ]


def call_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("kind").isin(*CALL_KINDS)).dropna(subset=["callId", "tool"])


def tool_calls(events: DataFrame, limit: int | None = CALL_LIMIT) -> DataFrame:
    """One row per call: a start opens it (again), the last end closes it, an end without a start stands alone."""
    calls = call_events(events).groupBy(F.col("callId").alias("call_id")).agg(*call_aggregates())
    rows = calls.select("call_id", *call_columns())
    return rows if not limit else rows.orderBy(F.desc("started_at"), "call_id").limit(limit)


def tool_call_summary(calls: DataFrame) -> DataFrame:
    return calls.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed")
    ])
