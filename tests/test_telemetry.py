import bisect
import json
import random

import pytest
from conftest import records

from plcatlas.operators import telemetry
from plcatlas.schemas import EVENTS, conform
from plcatlas.streaming import telemetry as streams


def event_lines(rows):
    return [json.dumps({"id": i, "ts": 1_700_000_000_000 + ts, "kind": kind, **rest}) for i, ts, kind, rest in rows]


def events(spark, rows):
    lines = spark.createDataFrame([(line,) for line in event_lines(rows)], "value STRING")
    return telemetry.parse_events(lines)[0]


CALLS = [
    (1, 0, "tool_started", {"callId": "a", "tool": "t", "argsPreview": "{}"}),
    (2, 10, "tool_completed", {"callId": "a", "tool": "t", "durationMs": 10}),
    (3, 20, "tool_started", {"callId": "b", "tool": "t"}),
    (4, 30, "tool_failed", {"callId": "b", "tool": "t", "durationMs": 10}),
    (5, 40, "tool_completed", {"callId": "c", "tool": "t", "durationMs": 15}),
    (6, 50, "tool_started", {"callId": "d", "tool": "t"}),
    (7, 60, "tool_started", {"callId": "a", "tool": "u"}),
    (8, 70, "tool_started", {"callId": None, "tool": "u"}),
    (9, 80, "tool_failed", {"callId": "c", "tool": "t", "durationMs": 3, "error": "late"}),
]
BASE = 1_700_000_000_000


def call_records(df):
    return [(c, t, int(s.timestamp() * 1000) - BASE, a, d, st, e) for c, t, s, a, d, st, e in records(
        df, "call_id", "tool", "started_at", "args_preview", "duration_ms", "status", "error")]


EXPECTED_CALLS = [
    ("a", "u", 60, "", None, "running", None),
    ("b", "t", 20, "", 10, "failed", "(unknown error)"),
    ("c", "t", 25, "", 3, "failed", "late"),
    ("d", "t", 50, "", None, "running", None),
]


def test_tool_calls(spark):
    calls = telemetry.tool_calls(events(spark, CALLS), None)
    assert call_records(calls) == EXPECTED_CALLS
    assert records(telemetry.tool_call_summary(calls)) == [(2, 0, 2)]
    newest = telemetry.tool_calls(events(spark, CALLS), 2)
    assert [r.call_id for r in newest.collect()] == ["a", "d"]


def reference_runs(rows):
    """The log read event by event."""
    runs, run = [], None

    def fresh(start):
        return dict(run=start[0] if start else -1, start=start, done=None, indexed=None, skipped=None, entities=None,
                    edges=None, n=0, fe=0, fd=0, failed=0)

    run = fresh(None)
    for row in rows:
        i, _, kind, rest = row
        if kind == "index_started":
            runs.append(run)
            run = fresh(row)
        elif kind in ("index_done", "index_completed"):
            run["done"] = row
            if kind == "index_done":
                for key, field in (("indexed", "indexedFiles"), ("skipped", "skippedFiles"), ("entities", "totalEntities"),
                                   ("edges", "totalEdges")):
                    run[key] = rest.get(field) if rest.get(field) is not None else run[key]
        elif run["done"] is None and kind == "index_file_done":
            run["n"] += 1
            run["fe"] += rest.get("entities", 0)
            run["fd"] += rest.get("edges", 0)
        elif run["done"] is None and kind == "index_file_failed":
            run["failed"] += 1
    runs.append(run)
    out = []
    for r in runs:
        if r["start"] is None and r["done"] is None and not r["n"]:
            continue
        start, done = (r["start"] or (0, 0, "", {}))[3], (r["done"] or (0, 0, "", {}))[3]
        pick = lambda a, b: a if a is not None else b
        indexed, skipped = pick(r["indexed"], r["n"]), pick(r["skipped"], 0)
        done_indexed = done.get("indexedFiles") if r["done"] and r["done"][2] == "index_done" else None
        total = start.get("totalFiles")
        if total is None:
            total = (pick(done_indexed, indexed)) + skipped + r["failed"]
        took = 0
        if r["done"]:
            took = done.get("totalTimeMs" if r["done"][2] == "index_done" else "duration") or 0
        status = "completed" if r["done"] else "failed" if r["failed"] else "running"
        out.append((r["run"], total, indexed, skipped, pick(r["entities"], r["fe"]), pick(r["edges"], r["fd"]), r["failed"], took, status))
    return sorted(out, key=repr)


RUN_COLUMNS = ("run", "total_files", "indexed_files", "skipped_files", "total_entities", "total_edges", "failed", "total_time_ms", "status")


def random_log(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["index_started", "index_file_done", "index_file_done", "index_file_done", "index_file_failed",
                           "index_done", "index_completed", "lsp_progress"])
        rest = {}
        if kind == "index_started" and rng.random() < 0.5:
            rest = {"totalFiles": rng.randrange(9), "workspace": "w"}
        if kind == "index_file_done":
            rest = {"entities": rng.randrange(5), "edges": rng.randrange(5)}
        if kind == "index_done":
            rest = {k: rng.randrange(9) for k in ("indexedFiles", "skippedFiles", "totalEntities", "totalEdges", "totalTimeMs")
                    if rng.random() < 0.6}
        if kind == "index_completed":
            rest = {"duration": rng.randrange(9)}
        rows.append((i * 3, i, kind, rest))
    return rows


@pytest.mark.parametrize("seed, bucket", [(1, 7), (2, 50), (3, 1_000_000)])
def test_index_runs_match_the_reader(spark, seed, bucket):
    rows = random_log(seed)
    got = records(telemetry.index_runs(events(spark, rows), bucket_ids=bucket), *RUN_COLUMNS)
    assert got == reference_runs(rows)


def in_parts(spark, tmp_path, rows, stream, parts=2):
    """What a stream gives that is stopped and started again for every part of the log."""
    source, out = tmp_path / "log", str(tmp_path / "out")
    source.mkdir()
    size = -(-len(rows) // parts)
    for part in range(parts):
        (source / f"part-{part}.json").write_text("\n".join(event_lines(rows[part * size : (part + 1) * size])))
        parsed = telemetry.parse_events(streams.read_lines(spark, str(source), 1))[0]
        streams.drain(stream(parsed), out, str(tmp_path / "cp"))
        yield rows[: (part + 1) * size], spark.read.parquet(out)


def test_run_stream_equals_batch(spark, tmp_path):
    for seen, changes in in_parts(spark, tmp_path, random_log(4), streams.index_runs):
        assert records(streams.current_runs(changes), *RUN_COLUMNS) == reference_runs(seen)


def test_run_stream_of_file_events_without_workspace(spark, tmp_path):
    """Two workspaces take turns; only starts and some ends name theirs, and a run outlives both restarts."""
    rng, rows = random.Random(9), []
    for i in range(90):
        kind = rng.choice(["index_started", *["index_file_done"] * 5, "index_file_failed", "index_done"]) if i else "index_started"
        rest = {"workspace": rng.choice("xy")} if kind == "index_started" or kind == "index_done" and i % 2 else {}
        rows.append((i, i, kind, rest | {"entities": 2} if kind == "index_file_done" else rest))
    for seen, changes in in_parts(spark, tmp_path, rows, lambda e: streams.index_runs(e, ["workspace"])):
        batch = telemetry.index_runs(events(spark, seen), ["workspace"])
        assert records(streams.current_runs(changes), "workspace", *RUN_COLUMNS) == records(batch, "workspace", *RUN_COLUMNS)


def test_call_stream_equals_batch(spark, tmp_path):
    """Calls that last for days and go on after a restart, starts after ends, ends without a start."""
    rng, rows = random.Random(2), []
    for i in range(150):
        kind = rng.choice(["tool_started", "tool_completed", "tool_failed"])
        rest = {"callId": rng.choice([None, *(f"c{k}" for k in range(25))]), "tool": rng.choice(["t", "u", None]), "durationMs": rng.choice([None, 5, 70]), "error": rng.choice([None, "bad"])}
        rows.append((i, i * 86_400_000, kind, rest | ({"argsPreview": f"a{i}"} if i % 3 else {})))
    for seen, changes in in_parts(spark, tmp_path, rows, streams.tool_calls):
        assert call_records(streams.current_calls(changes)) == call_records(telemetry.tool_calls(events(spark, seen), None))


def test_streams_equal_batch(spark, tmp_path):
    """A sentinel far in the future moves the watermark past everything else."""
    sentinel = (99, 10_000_000, "tool_started", {"callId": "zz", "tool": "t"})
    stages = [(20 + i, 100 + i, "lsp_progress", {"stage": s, "workspace": w}) for i, (s, w) in enumerate(
        [("parsing", "x"), ("done", "y"), ("cleanup", "x")])]
    rows = [*CALLS, *stages, sentinel]
    source = tmp_path / "log"
    source.mkdir()
    (source / "a.json").write_text("\n".join(event_lines(rows) + ["{broken", '{"id": 1}']))
    batch = events(spark, rows)
    lines = lambda: streams.read_lines(spark, str(source))
    parse = lambda: telemetry.parse_events(lines())[0]
    run = lambda df, name, mode="append": streams.drain(
        df, str(tmp_path / name), str(tmp_path / f"{name}-cp"), mode) or spark.read.parquet(str(tmp_path / name))

    calls = streams.current_calls(run(streams.tool_calls(parse()), "calls"))
    assert call_records(calls.filter("call_id <> 'zz'")) == EXPECTED_CALLS
    assert records(run(streams.counts(parse()), "counts", "complete")) == records(telemetry.count_by_kind(batch))
    assert records(run(streams.latest_stage(parse(), ["workspace"]), "stage", "complete")) == [("x", "cleanup"), ("y", "done")]
    windows = records(run(streams.counts(parse(), "1 second"), "windows"), "kind", "count")
    assert windows == [("lsp_progress", 3), ("tool_completed", 2), ("tool_failed", 2), ("tool_started", 5)]
    over = records(run(streams.overflow(parse(), 5), "over"), "events", "dropped", "capacity")
    assert over == [(12, 7, 5)]
    assert records(run(telemetry.parse_events(lines())[1], "bad")) == [('{"id": 1}',), ("{broken",)]


def test_small_reports(spark):
    rows = [(1, 0, "sqlite_stats", dict(pous=1, variables=2, types=3, relationships=4, files=5, dbBytes=6)),
            (2, 0, "sqlite_stats", dict(pous=9)), (3, 0, "ws_client_connected", {}), (4, 0, "index_failed", {}),
            (5, 0, "index_file_failed", {})]
    log = events(spark, rows)
    assert records(telemetry.latest_stats(log)) == [(1, 1, 2, 3, 4, 5, 6)]
    assert records(telemetry.failed_files(log)) == [(2,)]
    assert records(telemetry.visible(log), "id") == [(1,), (2,), (4,), (5,)]
    assert [r.id for r in telemetry.recent(log, 2).collect()] == [5, 4]
    assert conform(log, EVENTS).columns == log.columns


def test_runs_whose_file_events_name_no_workspace(spark):
    """Only starts and ends of runs name the workspace; file events belong to the last start."""
    log = [(1, "index_started", "a"), (2, "index_file_done", None), (3, "index_file_done", None), (4, "index_file_failed", None),
           (5, "index_done", "a"), (6, "index_started", "b"), (7, "index_file_done", None)]
    df = spark.createDataFrame(log, "id BIGINT, kind STRING, workspace STRING")
    for bucket in (2, 100):
        got = records(telemetry.with_workspace(df, bucket), "id", "workspace")
        assert got == [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "b"), (7, "b")]
    tail = telemetry.with_workspace(df.filter("id in (2, 3)"), workspace="z")
    assert records(tail, "workspace") == [("z",), ("z",)]
    marked = telemetry.mark_runs(df, ["workspace"], 2)
    assert records(marked, "id", "run") == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6)]


def test_duration_quantiles_keep_their_rank_error(spark):
    """Sketches of days merge to one whose quantiles lie within the stated rank error; few values are kept exactly."""
    rows = spark.range(60_000).selectExpr(
        "id", "timestamp_seconds(1700000000 + id * 40) AS ts", "'index_file_done' AS kind", "if(id % 6000 = 0, 'few', 'hot') AS file",
        "CAST(id * 7919 % 60000 AS BIGINT) AS durationMs",
    )
    days = telemetry.duration_sketches(rows).cache()
    assert days.filter("file = 'hot'").count() > 20
    got = {r.file: r for r in telemetry.duration_quantiles(days).collect()}
    values = sorted(r.durationMs for r in rows.filter("file = 'hot'").collect())
    assert got["hot"].runs == len(values) == 59_990
    for rank, value in ((0.5, got["hot"].p50), (0.95, got["hot"].p95), (0.99, got["hot"].p99)):
        assert abs(bisect.bisect_right(values, value) / len(values) - rank) <= telemetry.SKETCH_ERROR
    few = sorted(r.durationMs for r in rows.filter("file = 'few'").collect())
    assert (got["few"].runs, got["few"].p50, got["few"].p99) == (10, few[4], few[9])
    assert telemetry.duration_quantiles(telemetry.duration_sketches(rows.limit(0))).isEmpty()
