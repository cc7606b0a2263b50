import random

import hashlib
import pytest
from conftest import records
from st_files import FILES, MIXED, corpus

from plcatlas.graph import Graph
from plcatlas.plans import index_job
from plcatlas.plans.index_job import Options
from plcatlas.plans.run_log import Journal, record
from plcatlas.sources import corpus as sources
from plcatlas.sources import store as tables
from plcatlas.sources.store import GraphStore
from plcatlas.streaming import ingest

ALL = {**FILES, "mixed.st": MIXED}
NAMES = ("pous", "variables", "variable_lists", "types", "fields", "relationships", "references", "files")


def content(graph):
    return {n: [repr(r) for r in records(graph.tables()[n])] for n in NAMES}


def assert_same(store, spark, files):
    expected = index_job.build(corpus(spark, files), Options(1)).graph
    got, want = content(store.read()), content(expected)
    for name in NAMES:
        assert got[name] == want[name], name


def test_full_then_incremental_equals_full(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    stats = index_job.full_index(store, corpus(spark, ALL), Options(1)).first()
    assert (stats.total_files, stats.indexed_files, stats.skipped_files) == (7, 7, 0)
    assert_same(store, spark, ALL)
    same = index_job.update(store, corpus(spark, ALL), Options(1)).first()
    assert (same.indexed_files, same.skipped_files) == (0, 7)

    rng = random.Random(3)
    files = dict(ALL)
    for step in range(3):
        changed = rng.choice(sorted(files))
        if step == 0:
            # a unit moves to a new file, another is gone: files that did not change refer to both
            files.pop("plant/FB_Motor.st")
            files["new/Motor.st"] = FILES["plant/FB_Motor.st"]
            files["iface.st"] = "INTERFACE I_Service\nEND_INTERFACE\n"
        elif step == 1:
            files["a/earlier.st"] = FILES["plant/FB_Device.st"]
        else:
            files[changed] = files[changed].replace("FB_", "FX_")
        index_job.update(store, corpus(spark, files), Options(1))
        assert_same(store, spark, files)


def test_update_named_and_stale(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    index_job.update_named(store, corpus(spark, ALL), spark.createDataFrame([("mixed.st",)], "path STRING"), Options(1))
    assert records(store.read().files, "path") == [("mixed.st",)]
    rest = {k: v for k, v in ALL.items() if k != "mixed.st"}
    index_job.update(store, corpus(spark, rest), Options(1))
    assert_same(store, spark, rest)


def test_unfinished_version_is_not_read(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    index_job.full_index(store, corpus(spark, FILES), Options(1))
    before = content(store.read())
    store._write("pous", store.read().pous.limit(1), store.version() + 1)
    assert content(store.read()) == before


def test_stepwise_ingest(spark, tmp_path):
    root = tmp_path / "src"
    for path, text in ALL.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.st").write_text("PROGRAM P\nEND_PROGRAM")
    assert records(sources.read_corpus(spark, str(root), sources.EXCLUDED)) == sorted(ALL.items(), key=repr)
    assert sources.read_corpus(spark, str(root)).count() == len(ALL) + 1
    store = GraphStore(spark, str(tmp_path / "g"), buckets=2)
    query = ingest.start(spark, str(root), store, Options(1), str(tmp_path / "cp"), files_per_batch=3, patterns=sources.EXCLUDED)
    query.awaitTermination()
    assert query.exception() is None
    assert_same(store, spark, ALL)


def test_excluded_and_order(spark):
    paths = ["a/b.st", "Node_Modules/x.st", "x\\DIST\\y.st", "_common.st", "A.st"]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    assert [r.path for r in df.filter(~sources.excluded("path")).orderBy(sources.listing_order("path")).collect()] == [
        "_common.st", "A.st", "a/b.st"]


def test_changed_files(spark):
    files = corpus(spark)
    registry = sources.fingerprints(files.filter("path like 'plant%'"))
    work = sources.changed_files(files, registry)
    assert records(work, "path") == [("short/FB_Blank.st",), ("short/FB_Valve.st",)]
    assert sources.changed_files(files, registry, force=True).count() == 6


def test_table_operations(spark):
    old = spark.createDataFrame([("a", "1", 10, 1, 1), ("b", "1", 10, 2, 2)], "path STRING, hash STRING, last_indexed BIGINT, pou_count BIGINT, var_count BIGINT")
    new = spark.createDataFrame([("b", "2", 11, 5, 5), ("c", "3", 9, 1, 1)], old.schema)
    assert records(tables.upsert_files(old, new), "path", "hash") == [("a", "1"), ("b", "2"), ("c", "3")]
    assert records(tables.registry_totals(old)) == [(2, 3)]

    diag = "file_path STRING, line INT, column INT, severity INT, code STRING, message STRING, source STRING"
    first = tables.diagnostic_rows(spark.createDataFrame([("a", 0, 0, 1, "E", "m", "s"), ("b", 1, 1, 2, "E", "n", "s"), ("c", 1, 1, 2, "E", "n", "s")], diag), 1)
    assert records(first, "id", "line")[0] == (f"st:diag:a:0:0:{hashlib.sha256(b'm').hexdigest()}", 1)
    second = tables.diagnostic_rows(spark.createDataFrame([("a", 5, 0, 1, "E", "new", "s")], diag), 2)
    analysed = spark.createDataFrame([("a",), ("b",)], "path STRING")
    assert records(tables.upsert_diagnostics(first, second, analysed), "file_path", "message") == [("a", "new"), ("c", "n")]

    pous = spark.createDataFrame([("1", "A"), ("2", "B")], "id STRING, name STRING")
    updates = spark.createDataFrame([("2", None), ("9", "Z")], "id STRING, name STRING")
    assert records(tables.update_pous(pous, updates)) == [("1", "A"), ("2", None)]


def test_remove_types_and_reset(spark):
    graph = index_job.build(corpus(spark, ALL), Options(1)).graph
    ids = graph.types.filter("name = 'E_State'").select("id")
    less = tables.remove_types(graph, ids)
    assert less.types.count() == graph.types.count() - 1
    assert less.relationships.filter("to_id = 'st:type:mixed.st:E_State'").count() == 0
    with pytest.raises(ValueError):
        tables.reset(graph)
    empty, counts = tables.reset(graph, force=True)
    assert dict(records(counts))["pous"] == graph.pous.count()
    assert isinstance(empty, Graph) and empty.pous.isEmpty()
    gone = tables.removal_counts(graph, spark.createDataFrame([("mixed.st",)], "path STRING"))
    assert dict(records(gone))["types"] == 3


def told(journal):
    """Events without times, as ``(id, kind, file, index, entities, edges)``."""
    return [tuple(r) for r in journal.events().orderBy("id").select("id", "kind", "file", "index", "entities", "edges").collect()]


def test_jobs_write_their_events(spark, tmp_path):
    from plcatlas.operators import telemetry

    ticks = iter(range(1000, 9000, 70))
    journal = Journal(spark, str(tmp_path / "log"), "ws", lambda: next(ticks))
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    files = {**ALL, "open.st": "FUNCTION_BLOCK FB_Open\nVAR\nEND_VAR\n", "blank.st": " "}
    stats = index_job.full_index(store, corpus(spark, files), Options(1), journal).first()
    assert (stats.total_files, stats.indexed_files, stats.skipped_files) == (9, 8, 0)
    events = told(journal)
    assert [e[0] for e in events] == list(range(1, 21)) and events[0][1] == "index_started" and events[-1][1] == "index_done"
    assert [(e[2], e[3]) for e in events[1:-1:2]] == [(e[2], e[3]) for e in events[2:-1:2]] == [(p, k + 1) for k, p in enumerate(sorted(files))]
    graph = store.read()
    want = {p: [0, 0] for p in files}
    for df, k in ((graph.pous, 0), (graph.types, 0), (graph.relationships, 1)):
        for r in df.collect():
            want[r.file_path][k] += 1
    ends = {e[2]: e for e in events if e[1] in ("index_file_done", "index_file_failed")}
    assert {p for p, e in ends.items() if e[1] == "index_file_failed"} == {"open.st"}
    assert {p: [e[4], e[5]] for p, e in ends.items() if p != "open.st"} == {p: v for p, v in want.items() if p != "open.st"}
    assert ends["blank.st"][4:] == (0, 0) and ends["open.st"][4:] == (None, None)

    same = index_job.update(store, corpus(spark, files), Options(1), journal=journal).first()
    assert (same.total_files, same.indexed_files, same.skipped_files, same.total_entities) == (9, 0, 9, 0)
    files["mixed.st"] += "\n"
    files.pop("blank.st")
    index_job.update(store, corpus(spark, files), Options(1), journal=journal)
    last = told(journal)[22:]
    assert [(e[0], e[1], e[2], e[3]) for e in last] == [
        (23, "index_started", None, None), (24, "index_file_started", "mixed.st", 1), (25, "index_file_done", "mixed.st", 1), (26, "index_done", None, None)]
    runs = records(telemetry.index_runs(journal.events()), "workspace", "total_files", "indexed_files", "skipped_files", "failed", "status", "total_time_ms")
    assert runs == sorted([("ws", 9, 8, 0, 1, "completed", 70), ("ws", 9, 0, 9, 0, "completed", 70), ("ws", 8, 1, 7, 0, "completed", 70)])


def test_a_run_that_breaks_says_so(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "log"), "ws")
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)

    def broken():
        raise RuntimeError("disk gone")

    with pytest.raises(RuntimeError):
        record(journal, store, corpus(spark, FILES).select("path"), broken)
    assert [(r.id, r.kind, r.error) for r in journal.events().orderBy("id").collect()] == [(1, "index_started", None), (2, "index_failed", "disk gone")]
    index_job.full_index(store, corpus(spark, FILES), Options(1), journal)
    assert told(journal)[2][:2] == (3, "index_started")


def write_sources(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_catch_up_sees_edits_and_deletions(spark, tmp_path):
    root, store = tmp_path / "src", GraphStore(spark, str(tmp_path / "g"), buckets=4)
    files = {**ALL, "odd [1] {a}*.st": "PROGRAM Odd\nVAR m : FB_Motor; END_VAR\nEND_PROGRAM\n"}
    write_sources(root, files)
    first = ingest.catch_up_folder(spark, str(root), store, Options(1), files_per_step=3)
    assert [r.step for r in first.orderBy("path").collect()] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert_same(store, spark, files)
    version = store.version()
    assert ingest.catch_up_folder(spark, str(root), store, Options(1)).isEmpty() and store.version() == version

    # between two passes: an edit, a new file, a file that moved and one that is gone
    files["plant/FB_Device.st"] = files["plant/FB_Device.st"].replace("FB_Device", "FB_Unit")
    files["new/FB_Device.st"] = FILES["plant/FB_Device.st"]
    files["moved/FB_Motor.st"] = files.pop("plant/FB_Motor.st")
    files.pop("mixed.st")
    (root / "plant" / "FB_Motor.st").unlink()
    (root / "mixed.st").unlink()
    write_sources(root, files)
    work = ingest.catch_up_folder(spark, str(root), store, Options(1), files_per_step=2)
    assert records(work, "path", "gone") == [
        ("mixed.st", True), ("moved/FB_Motor.st", False), ("new/FB_Device.st", False), ("plant/FB_Device.st", False), ("plant/FB_Motor.st", True)]
    assert_same(store, spark, files)


def test_catch_up_goes_on_after_a_step_that_broke(spark, tmp_path):
    store, calls = GraphStore(spark, str(tmp_path / "g"), buckets=4), []

    def read(paths):
        calls.append(sorted(r.path for r in paths.collect()))
        if len(calls) == 2:
            raise OSError("lost")
        return sources.named_files(corpus(spark, ALL), paths)

    with pytest.raises(OSError):
        ingest.catch_up(store, corpus(spark, ALL), Options(1), 3, read)
    assert store.read().files.count() == 3
    ingest.catch_up(store, corpus(spark, ALL), Options(1), 3, read)
    assert calls[0] == sorted(ALL)[:3] and calls[2] == sorted(ALL)[3:6] and calls[3] == sorted(ALL)[6:]
    assert_same(store, spark, ALL)


def test_a_file_that_vanished_is_left_out(spark, tmp_path):
    write_sources(tmp_path, {"a.st": "PROGRAM A\nEND_PROGRAM\n"})
    paths = spark.createDataFrame([("a.st",), ("gone.st",)], "path STRING")
    assert records(sources.read_files(spark, str(tmp_path), paths), "path") == [("a.st",)]
    assert sources.read_files(spark, str(tmp_path), paths.limit(0)).isEmpty()


def test_excluded_takes_whole_segments(spark):
    kept = ["src/FB_Combine.st", "src/FB_Object.st", "Cabinet/A.st", "digital/FB_X.st", "src/FB_Build.st"]
    df = spark.createDataFrame([(p,) for p in [*kept, "a/obj/x.st", "bin/y.st", "node_modules/z/w.st"]], "path STRING")
    assert records(df.filter(~sources.excluded("path")), "path") == sorted((p,) for p in kept)
    assert df.filter(sources.excluded("path", ["FB_*.st"])).count() == 4
    assert df.filter(sources.excluded("path", [])).count() == 0


def test_an_update_opens_the_buckets_it_needs(spark, tmp_path):
    """The buckets an update reads depend on its files and their names, not on the size of the store."""
    files = {f"m/{i}.st": f"FUNCTION_BLOCK FB_{i}\nVAR\n n : FB_{i + 1};\nEND_VAR\nEND_FUNCTION_BLOCK\n" for i in range(60)}
    store = GraphStore(spark, str(tmp_path / "g"), buckets=64)
    index_job.full_index(store, corpus(spark, files), Options(1))
    opened = []
    table = store.table
    store.table = lambda name, only=None: (opened.append((name, None if only is None else len(only))), table(name, only))[1]
    files["m/7.st"] = files["m/7.st"].replace("FB_7", "FB_Seven")
    index_job.apply(store, corpus(spark, {"m/7.st": files["m/7.st"]}), spark.createDataFrame([("m/7.st",)], "path STRING"), Options(1))
    store.table = table
    assert opened and all(n is not None and n <= 4 for _, n in opened)
    assert_same(store, spark, files)


def test_the_next_bearer_of_a_name_takes_over(spark, tmp_path):
    unit = "FUNCTION_BLOCK FB_Twice\nEND_FUNCTION_BLOCK\n"
    files = {"a.st": unit, "b.st": unit, "use.st": "PROGRAM P\nVAR x : FB_Twice; END_VAR\nEND_PROGRAM\n"}
    store = GraphStore(spark, str(tmp_path / "g"), buckets=8)
    index_job.full_index(store, corpus(spark, files), Options(1))
    for gone in ("a.st", "b.st"):
        files.pop(gone)
        index_job.update(store, corpus(spark, files), Options(1))
        assert_same(store, spark, files)
    assert store.read().relationships.isEmpty()
    files["c.st"] = unit
    index_job.update(store, corpus(spark, files), Options(1))
    assert records(store.read().relationships, "to_id") == [("st:c.st:FB_Twice",)]


def test_updates_carry_diagnostics_and_rejects(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=4)
    schema = "file_path STRING, line INT, column INT, severity INT, code STRING, message STRING, source STRING"
    found = spark.createDataFrame([(p, 0, 3, 1, "C1", "bad", "st") for p in ("a.st", "b.st", "b.st", "not-there.st")], schema)
    files = {"a.st": "PROGRAM A\nEND_PROGRAM\n", "b.st": "FUNCTION_BLOCK B EXTENDS Nobody\nEND_FUNCTION_BLOCK\n"}
    index_job.update(store, corpus(spark, files), Options(1), diagnostics=found)
    assert records(store.read().diagnostics, "file_path", "line", "column") == [("a.st", 1, 4), ("b.st", 1, 4)]
    files["b.st"] += "\n"
    index_job.update(store, corpus(spark, files), Options(2))
    assert store.read().diagnostics.count() == 2
    index_job.update(store, corpus(spark, files), Options(3), force=True, diagnostics=found.filter("file_path = 'a.st'"))
    assert records(store.read().diagnostics, "file_path", "created_at") == [("a.st", 3)]
    files.pop("a.st")
    index_job.update(store, corpus(spark, files), Options(4))
    assert store.read().diagnostics.isEmpty()
    touched = spark.createDataFrame([("b.st",)], "path STRING")
    rejects = index_job.apply(store, corpus(spark, files), touched, Options(5))
    assert records(rejects, "kind", "reason") == [("relationship", "unknown target")]
