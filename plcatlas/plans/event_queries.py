"""Registered queries over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.operators import telemetry
from plcatlas.plans.registry import Registry
from plcatlas.schemas import EVENTS, conform
from plcatlas.sources import fixtures

registry = Registry()
BY = ("workspace",)


def log(spark, sf, view="event_log"):
    return conform(fixtures.view(spark, sf, view), EVENTS)


def event_query(name, operator, sql, view="event_log"):
    registry.define(name, lambda spark, sf: operator(log(spark, sf, view)), fixtures.oracle(sql, view) if sql else None)


event_query("event_counts", telemetry.count_by_kind, "SELECT kind, count(*) AS count FROM event_log GROUP BY kind")
event_query("visible_events", lambda e: telemetry.visible(e, ("index_started", "ws_client_connected", "lsp_progress"))
            .select("id", "kind", "workspace"),
            "SELECT id, kind, workspace FROM event_log WHERE kind IN ('index_started', 'lsp_progress')")
event_query("recent_events", lambda e: telemetry.recent(e, since_id=100).select("id", "kind"),
            "SELECT id, kind FROM event_log WHERE id > 100 ORDER BY id DESC LIMIT 1000")
event_query("failed_files", telemetry.failed_files, """
SELECT count(*) AS failed_files FROM event_log WHERE kind IN ('index_file_failed', 'index_failed')""")
event_query("latest_stage", lambda e: telemetry.latest_stage(e, BY), """
SELECT workspace, arg_max(stage, id) AS stage FROM event_log WHERE kind = 'lsp_progress' AND stage IS NOT NULL
GROUP BY workspace""")
event_query("latest_stats", telemetry.latest_stats, """
SELECT id, pous, variables, types, relationships, files, dbBytes FROM event_log WHERE kind = 'sqlite_stats'
 AND variables IS NOT NULL AND files IS NOT NULL ORDER BY id DESC LIMIT 1""")
event_query("rate_overflow", lambda e: telemetry.overflow(e, 3, "10 minutes")
            .select(F.unix_millis("start").alias("start_ms"), "events", "dropped"), """
SELECT epoch_ms(time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01')) AS start_ms, count(*) AS events,
 count(*) - 3 AS dropped FROM event_log GROUP BY 1 HAVING count(*) > 3""")
event_query("file_durations", telemetry.file_durations, """
SELECT file, count(*) AS runs, avg(durationMs) AS avg_ms, max(durationMs) AS max_ms FROM event_log
WHERE kind = 'index_file_done' GROUP BY file""")
# a sketch of at most SKETCH_K values is exact; tests hold larger ones against their rank error
event_query("file_duration_quantiles", lambda e: telemetry.duration_quantiles(telemetry.duration_sketches(e)), """
SELECT file, count(*) AS runs, quantile_disc(durationMs, 0.5) AS p50, quantile_disc(durationMs, 0.95) AS p95,
 quantile_disc(durationMs, 0.99) AS p99 FROM event_log WHERE kind = 'index_file_done' AND durationMs IS NOT NULL GROUP BY file""")
_STAGES = ", ".join(f"'{s}'" for s in telemetry.STAGES)
event_query("stage_progress", telemetry.stage_progress, f"""
SELECT file, list_extract([{_STAGES}], max(list_position([{_STAGES}], stage))) AS stage FROM event_log
WHERE kind = 'lsp_progress' AND stage IS NOT NULL GROUP BY file""")

_RUNS = """
WITH marked AS (SELECT *, kind IN ('index_done', 'index_completed') AS is_done,
  coalesce(max(CASE WHEN kind = 'index_started' THEN id END) OVER w, -1) AS run,
  coalesce(max(CASE WHEN kind IN ('index_done', 'index_completed') THEN id END) OVER w, -1) AS last_done
 FROM event_log WHERE kind IN ('index_started', 'index_file_done', 'index_file_failed', 'index_done', 'index_completed')
 WINDOW w AS (PARTITION BY workspace ORDER BY id)),
parts AS (SELECT workspace, run, max(totalFiles) FILTER (kind = 'index_started') AS started_files,
  count(*) FILTER (is_done) AS ends, max(id) FILTER (is_done) AS end_id,
  arg_max(indexedFiles, id) FILTER (kind = 'index_done' AND indexedFiles IS NOT NULL) AS indexed,
  coalesce(arg_max(skippedFiles, id) FILTER (kind = 'index_done' AND skippedFiles IS NOT NULL), 0) AS skipped,
  arg_max(totalEntities, id) FILTER (kind = 'index_done' AND totalEntities IS NOT NULL) AS entities,
  arg_max(totalEdges, id) FILTER (kind = 'index_done' AND totalEdges IS NOT NULL) AS edges,
  count(*) FILTER (kind = 'index_file_done' AND last_done <= run) AS n,
  coalesce(sum(entities) FILTER (kind = 'index_file_done' AND last_done <= run), 0) AS file_entities,
  coalesce(sum(edges) FILTER (kind = 'index_file_done' AND last_done <= run), 0) AS file_edges,
  count(*) FILTER (kind = 'index_file_failed' AND last_done <= run) AS failed FROM marked GROUP BY workspace, run),
runs AS (SELECT p.workspace, p.run,
  CAST(coalesce(p.started_files, CASE WHEN e.kind = 'index_done' THEN e.indexedFiles END + p.skipped + p.failed,
   coalesce(p.indexed, p.n) + p.skipped + p.failed) AS BIGINT) AS total_files,
  CAST(coalesce(p.indexed, p.n) AS BIGINT) AS indexed_files, CAST(p.skipped AS BIGINT) AS skipped_files,
  CAST(coalesce(p.entities, p.file_entities) AS BIGINT) AS total_entities,
  CAST(coalesce(p.edges, p.file_edges) AS BIGINT) AS total_edges, p.failed,
  coalesce(CASE WHEN e.kind = 'index_done' THEN e.totalTimeMs ELSE e.duration END, 0) AS total_time_ms,
  CASE WHEN p.ends > 0 THEN 'completed' WHEN p.failed > 0 THEN 'failed' ELSE 'running' END AS status
 FROM parts p LEFT JOIN event_log e ON e.id = p.end_id
 WHERE p.run <> -1 OR p.ends > 0 OR p.n > 0)"""


def named_runs(events):
    """Runs with the workspace their events are grouped by; a run known only by its files has no name of its own."""
    marked = telemetry.mark_runs(events, BY)
    runs = telemetry.summarise_runs(
        telemetry.run_parts(marked, BY).withColumnRenamed("workspace", "log"), ("log",)
    )
    return runs.drop("workspace").withColumnRenamed("log", "workspace")


event_query("index_runs", named_runs, f"{_RUNS} SELECT * FROM runs")
event_query("latest_index_runs", lambda e: telemetry.latest_runs(named_runs(e)), f"""{_RUNS}
SELECT r.* FROM runs r JOIN (SELECT workspace, max(run) AS run FROM runs GROUP BY workspace) m USING (workspace, run)""")

_RUN_KINDS = "('index_started', 'index_file_done', 'index_file_failed', 'index_done', 'index_completed')"
_FILLED = f"""WITH filled AS (SELECT * REPLACE (coalesce(workspace, last_value(CASE WHEN kind = 'index_started' THEN workspace END IGNORE NULLS)
  OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS workspace) FROM bare_log WHERE kind IN {_RUN_KINDS}), """
event_query("bare_index_runs", named_runs, _RUNS.strip().replace("WITH ", _FILLED, 1).replace("FROM event_log", "FROM filled")
            .replace("JOIN event_log", "JOIN filled") + " SELECT * FROM runs", "bare_log")
# a log read as one sequence, whoever its events belong to
_SEQUENCE = (
    _RUNS.replace("event_log", "bare_log").replace("PARTITION BY workspace ORDER BY id", "ORDER BY id")
    .replace("GROUP BY workspace, run", "GROUP BY run")
    .replace("SELECT workspace, run, max", """SELECT coalesce(arg_max(workspace, id) FILTER (kind = 'index_started'),
  arg_max(workspace, id) FILTER (is_done), '(unknown)') AS workspace, run, max""")
)
event_query("log_runs", telemetry.index_runs, f"{_SEQUENCE} SELECT * FROM runs", "bare_log")

_CALLS = """
WITH valid AS (SELECT * FROM call_log WHERE callId IS NOT NULL AND tool IS NOT NULL),
s AS (SELECT callId, arg_max({'id': id, 'ts': ts, 'tool': tool, 'args': argsPreview}, id) AS s FROM valid
 WHERE kind = 'tool_started' GROUP BY callId),
e AS (SELECT callId, arg_max({'id': id, 'tool': tool, 'd': coalesce(durationMs, 0), 'kind': kind, 'error': error}, id) AS e,
 arg_min({'ts': ts, 'd': coalesce(durationMs, 0)}, id) AS f FROM valid WHERE kind <> 'tool_started' GROUP BY callId),
calls AS (SELECT coalesce(s.callId, e.callId) AS call_id, e IS NULL OR coalesce(s.s.id > e.e.id, false) AS open, s.s AS s, e.e AS e, e.f AS f
 FROM s FULL JOIN e ON e.callId = s.callId),
rows AS (SELECT call_id, CASE WHEN open THEN s.tool ELSE e.tool END AS tool,
 coalesce(epoch_us(s.ts) // 1000, epoch_us(f.ts) // 1000 - f.d) AS started_ms, coalesce(s.args, '') AS args_preview,
 CASE WHEN NOT open THEN e.d END AS duration_ms,
 CASE WHEN open THEN 'running' WHEN e.kind = 'tool_completed' THEN 'completed' ELSE 'failed' END AS status,
 CASE WHEN NOT open AND e.kind = 'tool_failed' THEN coalesce(e.error, '(unknown error)') END AS error FROM calls)"""


def call_rows(calls):
    return calls.withColumn("started_ms", F.unix_millis("started_at")).drop("started_at")


event_query("tool_calls", lambda e: call_rows(telemetry.tool_calls(e, None)), f"{_CALLS} SELECT * FROM rows", "call_log")
event_query("recent_tool_calls", lambda e: call_rows(telemetry.tool_calls(e, 50)), f"""{_CALLS},
 exact AS (SELECT r.*, coalesce(epoch_us(c.s.ts), (epoch_us(c.f.ts) // 1000 - c.f.d) * 1000) AS began
 FROM rows r JOIN calls c USING (call_id))
SELECT * EXCLUDE (began) FROM exact ORDER BY began DESC, call_id LIMIT 50""", "call_log")
event_query("tool_call_summary", lambda e: telemetry.tool_call_summary(telemetry.tool_calls(e, None)), f"""{_CALLS}
SELECT count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'completed') AS completed,
 count(*) FILTER (status = 'failed') AS failed FROM rows""", "call_log")


def wire_lines(events):
    """The log as JSON lines, some of them broken."""
    line = F.to_json(F.struct("id", F.unix_millis("ts").alias("ts"), "kind", "workspace", "entities", F.lit("x").alias("other")))
    return events.select(
        F.when(F.col("id") % 11 == 0, '{"id": 5, "ts"')
        .when(F.col("id") % 13 == 0, '{"id": "5", "ts": 1, "kind": "k"}')
        .when(F.col("id") % 17 == 0, '{"id": 5, "kind": "k"}')
        .otherwise(line).alias("value")
    )


event_query("parsed_events", lambda e: telemetry.parse_events(wire_lines(e))[0].select("id", F.unix_millis("ts").alias("ts_ms"), "kind", "workspace", "entities"),
            """SELECT id, epoch_us(ts) // 1000 AS ts_ms, kind, workspace, entities FROM event_log
WHERE id % 11 <> 0 AND id % 13 <> 0 AND id % 17 <> 0""")
event_query("malformed_events", lambda e: telemetry.parse_events(wire_lines(e))[1].groupBy("line").agg(F.count(F.lit(1)).alias("n")), """
SELECT CASE WHEN id % 11 = 0 THEN '{"id": 5, "ts"' WHEN id % 13 = 0 THEN '{"id": "5", "ts": 1, "kind": "k"}'
 ELSE '{"id": 5, "kind": "k"}' END AS line, count(*) AS n FROM event_log
WHERE id % 11 = 0 OR id % 13 = 0 OR id % 17 = 0 GROUP BY 1""")
event_query("event_times", lambda e: e.select("id", text.iso_time(F.unix_millis("ts")).alias("at"),
                                              text.args_preview(F.repeat("workspace", (F.col("id") % 90).cast("int"))).alias("preview")), """
SELECT id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, CASE WHEN length(w) > 200 THEN left(w, 200) || '…' ELSE w END AS preview
FROM (SELECT id, ts, repeat(workspace, CAST(id % 90 AS INT)) AS w FROM event_log) x""")
