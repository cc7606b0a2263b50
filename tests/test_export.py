import json
from pathlib import Path

import pytest
from conftest import records
from st_files import FILES, MIXED, corpus

from plcatlas.graph import Graph
from plcatlas.operators import render
from plcatlas.plans import export_job, index_job
from plcatlas.plans.index_job import Options
from plcatlas.sources import snapshot

ALL = {**FILES, "mixed.st": MIXED}


@pytest.fixture(scope="module")
def graph(spark):
    built = index_job.build(corpus(spark, ALL), Options(1, resolve_instances=True)).graph
    return built.with_tables(**{n: df.cache() for n, df in built.tables().items()})


def test_documents(spark, graph, tmp_path):
    base = str(tmp_path / "vault")
    first = export_job.export(graph, corpus(spark, ALL), base, 5).first()
    assert (first.pous_exported, first.types_exported, first.files_written, first.files_skipped, first.index_written) == (
        10, 3, 14, 0, True)
    main = Path(base, "pous", "PRG_Station.md").read_text()
    assert main == """---
name: PRG_Station
type: PROGRAM
file: plant/PRG_Station.st
start_line: 1
end_line: 11
variable_count: 3
dependencies_count: 2
dependents_count: 0
tags: ["program", "pou"]
schema_version: 1
---

# PRG_Station

**Type:** PROGRAM
**File:** `plant/PRG_Station.st` (lines 1–11)

## Variables

| Direction | Name | Type | Default | Line |
| --- | --- | --- | --- | --- |
| VAR | `inlet` | `FB_Pump` |  | 3 |
| VAR | `spare` | `FB_Device` |  | 4 |
| VAR | `wet` | `BOOL` |  | 5 |
## Calls

Outgoing CALLS (2) from [[PRG_Station|plant/PRG_Station.st]]:

[[FB_Device|plant/FB_Device.st]]
[[FB_Pump|plant/FB_Pump.st]]
## Called by

_Nothing calls this POU yet._
## Source

```st
""" + FILES["plant/PRG_Station.st"] + "\n```\n"
    enum = Path(base, "types", "E_State.md").read_text()
    assert "**Enum values (3):**\n\n- `Idle`\n- `Run`\n- `Stop`\n## Used by\n\n- [[FB_Mixed|mixed.st]]\n" in enum
    index = Path(base, "_index.md").read_text()
    assert "Total: **10** POUs, **3** types." in index and "  PRG_Station --> FB_Device" in index
    # two methods are called Run: one keeps the name, the other gets a key
    runs = sorted(p.name for p in Path(base, "pous").glob("Run*.md"))
    assert len(runs) == 2 and "Run.md" in runs

    again = export_job.export(graph, corpus(spark, ALL), base, 6).first()
    assert (again.pous_exported, again.types_exported, again.files_skipped, again.files_written) == (0, 0, 13, 1)
    manifest, run = export_job.latest_manifest(spark, base)
    assert run == 2 and records(manifest.filter("relpath not like '\\\\_index%'"), "exported_at")[0] == (5,)

    changed = {**ALL, "plant/FB_Motor.st": FILES["plant/FB_Motor.st"].replace("Torque", "Outcome")}
    new = index_job.build(corpus(spark, changed), Options(1, resolve_instances=True)).graph
    third = export_job.export(new, corpus(spark, changed), base, 7).first()
    assert (third.pous_exported, third.types_exported) == (1, 0)
    assert "Outcome" in Path(base, "pous", "FB_Motor.md").read_text()
    full = export_job.export(new, None, base, 8, mode="full").first()
    assert full.files_written == 14


def test_long_lists_go_on_further_pages(spark):
    hub, callers = "hub", [f"c{i:03d}" for i in range(100)]
    pous = spark.createDataFrame([(n, n, "FUNCTION_BLOCK", f"{n}.st", 1) for n in [hub, *callers]],
                                 "id STRING, name STRING, pou_type STRING, file_path STRING, start_line INT")
    calls = spark.createDataFrame([(f"e{c}", c, hub, "CALLS") for c in callers],
                                  "id STRING, from_id STRING, to_id STRING, type STRING")
    docs = render.pou_documents(Graph(spark, pous=pous, relationships=calls), page_rows=10)
    pages = docs.filter("entity_id = 'hub'").collect()
    assert len(pages) > 5
    links = [line for p in pages for line in p.body.split("\n") if line.startswith("[[c")]
    assert sorted(links) == [f"[[{c}|{c}.st]]" for c in callers]
    assert all(max(1, p.body.count("[[c")) < 40 for p in pages)
    first = next(p for p in pages if p.page == 0)
    assert "dependents_count: 100" in first.body and first.relpath == "pous/hub.md"
    assert {p.relpath for p in pages} == {"pous/hub.md"} | {f"pous/hub.{p.page + 1}.md" for p in pages if p.page}
    index = render.index_documents(Graph(spark, pous=pous, relationships=calls), page_rows=10).collect()
    assert sum(p.body.count("- [[") for p in index) == 101


def test_empty_graph(spark):
    empty = Graph(spark)
    docs = export_job.documents(empty).collect()
    assert [d.relpath for d in docs] == ["_index.md"]
    assert "empty[No CALLS relationships]" in docs[0].body


def test_snapshot_source(spark, tmp_path):
    place = lambda line, col: {"start": {"line": line, "col": col}, "end": {"line": line + 1, "col": 0}}
    child = lambda name, kind, line: {"id": f"m:{line}", "name": name, "kind": kind, "file_path": "m.st", "range": place(line, 2)}
    doc = {"snapshot": {
        "diagnostics": [{"code": "E1", "col": 4, "line": 9, "message": "undeclared", "path": "m.st", "severity": "error"}],
        "metadata": {"edge_count": 0, "entity_count": 2, "export_time": "x", "project_path": "p"},
        "symbols": [
            {"id": "m:1", "name": "FB_A (FUNCTION_BLOCK)", "kind": "function_block", "file_path": "m.st", "range": place(0, 0),
             "children": [child("x", "variable", 1), child("Run", "method", 2)]},
            {"id": "m:2", "name": "E_S", "kind": "type", "file_path": "m.st", "range": place(5, 0), "children": [child("Idle", "enum_value", 5)]},
            {"id": "m:3", "name": "odd", "kind": "other", "file_path": "m.st", "range": place(7, 0), "children": []},
        ],
        "types": [{"file_path": "m.st", "kind": "enum", "name": "E_S"}],
    }}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    snaps = snapshot.read_snapshots(spark, str(tmp_path / "s.json"))
    found = snapshot.entities(snaps)
    assert records(found, "id", "type", "line", "column", "parent") == [
        ("m.st:E_S", "TYPE", 6, 1, None), ("m.st:E_S.Idle", "ENUM_MEMBER", 6, 3, "E_S"), ("m.st:FB_A", "FUNCTION_BLOCK", 1, 1, None),
        ("m.st:FB_A.Run", "METHOD", 3, 3, "FB_A"), ("m.st:FB_A.x", "VARIABLE", 2, 3, "FB_A"),
    ]
    pous, types = snapshot.tables(found, 1)
    assert records(pous, "id") == [("st:m.st:E_S.Idle",), ("st:m.st:FB_A",), ("st:m.st:FB_A.Run",)]
    assert records(types, "id") == [("st:type:m.st:E_S",)]
    assert records(snapshot.diagnostics(snaps), "file_path", "line", "severity") == [("m.st", 9, 1)]
    assert records(snapshot.listed_types(snaps)) == [("E_S", "enum", "m.st")]


def test_write_snapshot(spark, graph, tmp_path):
    export_job.write_snapshot(graph, str(tmp_path / "snap"))
    nodes = spark.read.json(str(tmp_path / "snap" / "nodes"))
    assert records(nodes.filter("id like '%PRG_Station'"), "type", "data.label") == [("program", "PRG_Station")]
    assert spark.read.json(str(tmp_path / "snap" / "edges")).count() == graph.relationships.count()


def pages_of(base):
    return {str(p.relative_to(base)): p.read_text() for p in Path(base).rglob("*.md")}


def test_a_change_renders_the_pages_it_concerns(spark, tmp_path):
    """Increments end with the pages of a full export, and render no page that shows nothing of the change."""
    build = lambda files: index_job.build(corpus(spark, files), Options(1, resolve_instances=True)).graph
    files, base = dict(ALL), str(tmp_path / "vault")
    twin = "FUNCTION_BLOCK FB_Device\nVAR z : INT; END_VAR\nEND_FUNCTION_BLOCK\n"
    steps = [
        {},
        {"plant/FB_Motor.st": FILES["plant/FB_Motor.st"].replace("Torque", "Outcome")},
        {"a/twin.st": twin},  # takes the plain page name
        {"plant/FB_Motor.st": None},
        {"a/twin.st": None, "mixed.st": None},
    ]
    rendered = []
    for now, step in enumerate(steps):
        files = {k: v for k, v in {**files, **step}.items() if v is not None}
        graph = build(files)
        stats = export_job.export(graph, corpus(spark, files), base, now).first()
        full = str(tmp_path / f"full{now}")
        export_job.export(graph, corpus(spark, files), full, now, mode="full")
        assert pages_of(base) == pages_of(full), now
        rendered.append(stats.files_written)
    assert rendered[1] == 2
    before = export_job.page_inputs(build({**ALL, "x.st": "PROGRAM X\nEND_PROGRAM\n"}), None)
    after = build({**ALL, "x.st": "PROGRAM X\nVAR n : FB_Pump; END_VAR\nn();\nEND_PROGRAM\n"})
    found = {r.id for r in export_job.affected_entities(after, export_job.page_inputs(after, None), before).collect()}
    assert found == {"st:x.st:X", "st:plant/FB_Pump.st:FB_Pump"}


def test_other_settings_render_all_pages_again(spark, tmp_path):
    graph, base = index_job.build(corpus(spark, ALL), Options(1)).graph, str(tmp_path / "vault")
    export_job.export(graph, corpus(spark, ALL), base, 1)
    assert export_job.export(graph, None, base, 2).first().files_written > 5
    assert export_job.export(graph, None, base, 3).first().files_written == 1
