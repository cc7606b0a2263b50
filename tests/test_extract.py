import random

import pytest
from conftest import records
from st_files import FILES, MIXED, corpus

from plcatlas.functions import standard
from plcatlas.functions.scanner import scan
from plcatlas.operators import extract, resolve
from plcatlas.plans import index_job
from plcatlas.plans.index_job import Options

NOW = Options(now_ms=1)


@pytest.fixture(scope="module")
def facts(spark):
    return extract.extract(corpus(spark, {**FILES, "mixed.st": MIXED})).cache()


@pytest.mark.parametrize("code, clean, notes", [
    ("a // x\nb", "a \nb", [(1, "x")]),
    ("(* a (* b *) c *) y", "  y", [(1, "a  b  c")]),
    ("a (* 1\n2\n3 *) b", "a \n\n b", [(1, "1\n2\n3")]),
    ("x := 'it''s // no';", "x := 'it''s // no';", []),
    ('y := "(* no *)";', 'y := "(* no *)";', []),
    ("{pragma} z", "  z", []),
    ("{attribute 'q'} z", "{attribute 'q'} z", []),
    ("z (* open\nw", "z \n", [(1, "open\nw")]),
    ("a\n\n// one\n(* two *)\nb", "a\n\n\n \nb", [(3, "one"), (4, "two")]),
])
def test_scan(code, clean, notes):
    assert scan(code) == (clean, notes)


def test_scan_keeps_lines():
    rng = random.Random(5)
    pieces = ["a", "'", "''", '"', "//", "\n", "(*", "*)", "{", "}", "{attribute", " ", "x"]
    for _ in range(2000):
        code = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert scan(code)[0].count("\n") == code.count("\n"), code


def test_units(facts):
    got = records(extract.units(facts).filter("file_path <> 'mixed.st'"),
                  "name", "pou_type", "start_line", "end_line", "extends", "implements")
    assert got == sorted([
        ("FB_Device", "FUNCTION_BLOCK", 1, 10, None, None),
        ("FB_Pump", "FUNCTION_BLOCK", 1, 9, "FB_Device", ["I_Service"]),
        ("FB_Motor", "FUNCTION_BLOCK", 1, 7, None, None),
        ("PRG_Station", "PROGRAM", 1, 11, None, None),
        ("FB_Valve", "FUNCTION_BLOCK", 1, 2, None, None),
        ("FB_Blank", "FUNCTION_BLOCK", 1, 2, None, None),
    ], key=repr)


def test_members_and_modifiers(facts):
    got = records(extract.units(facts).filter("file_path = 'mixed.st'"), "id", "start_line", "end_line", "namespace", "implements")
    assert got == sorted([
        ("st:mixed.st:FB_Mixed", 12, 32, None, ["I_A", "I_B"]),
        ("st:mixed.st:FB_Mixed.Run", 17, 20, "FB_Mixed", None),
        ("st:mixed.st:I_A", 33, 36, None, None),
        ("st:mixed.st:I_A.Run", 34, 35, "I_A", None),
    ], key=repr)


def test_variables(facts):
    got = records(extract.variables(facts), "pou_id", "name", "direction", "var_type", "default_value", "start_line")
    short = [(p.rsplit(":", 1)[1], *rest) for p, *rest in got]
    assert sorted(short, key=repr) == sorted([
        ("FB_Device", "Alarm", "VAR_IN_OUT", "BOOL", None, 3),
        ("FB_Device", "hours", "VAR", "UDINT", None, 6),
        ("FB_Device", "starts", "VAR", "UDINT", None, 6),
        ("FB_Pump", "Level", "VAR_INPUT", "REAL", None, 3),
        ("FB_Pump", "drive", "VAR", "FB_Motor", None, 6),
        ("FB_Motor", "Speed", "VAR_INPUT", "REAL", "0.0", 2),
        ("FB_Motor", "Torque", "VAR_OUTPUT", "REAL", None, 3),
        ("PRG_Station", "inlet", "VAR", "FB_Pump", None, 3),
        ("PRG_Station", "spare", "VAR", "FB_Device", None, 4),
        ("PRG_Station", "wet", "VAR", "BOOL", None, 5),
        ("FB_Valve", "shut", "VAR_OUTPUT", "BOOL", None, 2),
        ("FB_Mixed", "c", "VAR", "INT", "5", 15),
        ("FB_Mixed", "st", "VAR", "E_State", None, 16),
        ("FB_Mixed", "t", "VAR", "BOOL", None, 16),
        ("FB_Mixed", "x", "VAR", "POINTER TO FB_Motor", None, 16),
        ("FB_Mixed.Run", "k", "VAR_INPUT", "INT", None, 18),
        ("FB_Mixed", "late", "VAR_TEMP", "REAL", None, 21),
    ], key=repr)


def test_types_fields_globals(facts):
    assert records(extract.types(facts), "name", "type_kind", "start_line", "end_line", "definition") == [
        ("ALIAS1", "TYPE", 7, 7, '{"kind":"alias","values":[],"fields":[]}'),
        ("E_State", "ENUM", 1, 1, '{"kind":"enum","values":["Idle","Run","Stop"],"fields":[]}'),
        ("ST_A", "STRUCT", 3, 6, '{"kind":"struct","values":[],"fields":[{"name":"a","type":"INT"},'
         '{"name":"b","type":"INT"},{"name":"s","type":"STRING"}]}'),
    ]
    assert records(extract.fields(facts), "name", "field_type", "default_value", "start_line") == [
        ("a", "INT", "3", 4), ("b", "INT", "3", 4), ("s", "STRING", "'x;VAR y'", 5),
    ]
    assert records(extract.global_lists(facts), "name", "direction", "start_line") == [
        ("g1", "VAR_GLOBAL", 10), ("g2", "VAR_GLOBAL", 10),
    ]


def test_calls(facts):
    assert records(extract.call_sites(facts), "path", "line", "scope", "callee") == sorted([
        ("mixed.st", 19, "Run", "FB_Motor"),
        ("plant/FB_Pump.st", 8, "FB_Pump", "drive"),
        ("plant/PRG_Station.st", 7, "PRG_Station", "spare"),
        ("plant/PRG_Station.st", 9, "PRG_Station", "inlet"),
    ], key=repr)


def test_states(facts):
    found, moves = extract.states(facts)
    assert records(found, "selector", "state", "line") == [
        ("q", "0", 26), ("q", "1", 26), ("st", "5", 24), ("st", "Idle", 23), ("st", "Run", 24), ("st", "Stop", 27),
    ]
    assert records(moves, "selector", "from_state", "to_state", "line") == [
        ("q", "0", "1", 26), ("q", "1", "2", 26), ("st", "5", "Stop", 25), ("st", "ELSE", "Idle", 30),
        ("st", "Idle", "Run", 23), ("st", "Run", "Stop", 25), ("st", "Stop", "Idle", 28),
    ]
    assert records(extract.state_counts(found, moves), "total_states", "total_transitions") == [(6, 7)]


def test_edges_and_rejects(spark):
    result = index_job.build(corpus(spark), NOW)
    assert records(result.graph.relationships.filter("type <> 'REFERENCES'"), "type", "from_id", "to_id") == [
        ("EXTENDS", "st:plant/FB_Pump.st:FB_Pump", "st:plant/FB_Device.st:FB_Device"),
    ]
    assert records(result.rejects) == [
        ("relationship", "st:rel:implements:plant/FB_Pump.st:FB_Pump:I_Service", "unknown target")
    ]


def test_instance_calls(spark):
    result = index_job.build(corpus(spark), Options(1, resolve_instances=True))
    got = records(result.graph.calls, "from_id", "to_id", "line")
    assert [(a.rsplit(":", 1)[1], b.rsplit(":", 1)[1], n) for a, b, n in got] == [
        ("FB_Pump", "FB_Motor", 8), ("PRG_Station", "FB_Device", 7), ("PRG_Station", "FB_Pump", 9),
    ]


def test_mixed_edges(spark):
    result = index_job.build(corpus(spark, {**FILES, "mixed.st": MIXED}), NOW)
    got = records(result.graph.relationships.filter("file_path = 'mixed.st'"), "type", "from_id", "to_id")
    short = [(t, a.split(":")[-1], b.split(":")[-1]) for t, a, b in got]
    assert sorted(short) == [
        ("CALLS", "FB_Mixed.Run", "FB_Motor"), ("CONTAINS", "FB_Mixed", "FB_Mixed.Run"), ("CONTAINS", "I_A", "I_A.Run"),
        ("EXTENDS", "FB_Mixed", "FB_Device"), ("IMPLEMENTS", "FB_Mixed", "I_A"), ("REFERENCES", "FB_Mixed", "E_State"),
        ("REFERENCES", "FB_Mixed", "FB_Motor"), ("USES", "FB_Mixed", "E_State"),
    ]
    by_file = index_job.build(corpus(spark, {**FILES, "mixed.st": MIXED}), Options(1, uses="file")).graph
    assert records(by_file.relationships.filter("type = 'USES'"), "to_id") == [
        ("st:type:mixed.st:ALIAS1",), ("st:type:mixed.st:E_State",), ("st:type:mixed.st:ST_A",),
    ]


def test_corpus_order_does_not_matter(spark):
    files = {**FILES, "mixed.st": MIXED}
    a = index_job.build(corpus(spark, files), NOW).graph
    b = index_job.build(corpus(spark, dict(reversed(files.items()))).repartition(3), NOW).graph
    for name in ("pous", "variables", "types", "fields", "relationships"):
        assert [repr(r) for r in records(a.tables()[name])] == [repr(r) for r in records(b.tables()[name])], name


def test_attribute_callers_matches_scopes(spark, facts):
    sites = extract.call_sites(facts)
    got = extract.attribute_callers(sites.select("path", "line", "callee"), extract.units(facts))
    assert records(got, "path", "line", "callee", "pou_id") == records(sites, "path", "line", "callee", "pou_id")


def test_attribute_callers_open_and_nested(spark):
    pous = spark.createDataFrame(
        [("f", 1, None, "open", None), ("f", 10, 30, "outer", None), ("f", 12, 15, "inner", "outer")],
        "file_path STRING, start_line INT, end_line INT, id STRING, namespace STRING",
    )
    sites = spark.createDataFrame([("f", n) for n in (0, 1, 5, 10, 12, 15, 16, 30, 31)], "path STRING, line INT")
    got = dict(records(extract.attribute_callers(sites, pous), "line", "pou_id"))
    assert got == {1: "open", 5: "open", 10: "outer", 12: "inner", 15: "inner", 16: "outer", 30: "outer", 31: "open"}


def test_standard_names(spark):
    names = ["TON", "INT_TO_REAL", "INT_TO_INT", "STRING_TO_BOOL", "STRING_TO_INT", "TIME_TO_LINT", "FB_Helper", "ton", "TIME_TO_REAL"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING").filter(standard.is_standard("n"))
    assert sorted(r.n for r in df.collect()) == ["INT_TO_REAL", "STRING_TO_INT", "TIME_TO_LINT", "TON"]


def test_base_type(spark):
    values = ["INT", "ARRAY[0..3] OF ST_A", "POINTER TO ARRAY [1..2] OF FB_X", "STRING(80)", "REFERENCE TO lib.T"]
    df = spark.createDataFrame([(v,) for v in values], "v STRING").select(resolve.base_type("v").alias("b"))
    assert [r.b for r in df.collect()] == ["INT", "ST_A", "FB_X", "STRING", "lib.T"]


def test_comments_and_coverage(spark):
    files = {"a.st": "// one\nPROGRAM P\nEND_PROGRAM (* two *)\n", "b.st": "FUNCTION_BLOCK F\n", "c.st": "x := 1;"}
    frame = corpus(spark, files)
    assert records(extract.comments(frame)) == [("a.st", 1, "one"), ("a.st", 3, "two")]
    assert records(extract.comment_density(frame), "path", "lines", "comments") == [("a.st", 4, 2), ("b.st", 2, 0), ("c.st", 1, 0)]
    rows = index_job.coverage(extract.extract(frame), frame)
    assert records(rows) == [("a.st", "parsed"), ("b.st", "failed"), ("c.st", "failed")]
    assert records(index_job.coverage_summary(rows)) == [(3, 1, 2, 33.3)]


WRAPPED = """VAR_GLOBAL CONSTANT
  g,

  h : INT;
END_VAR
INTERFACE I_Both EXTENDS I_A, lib.I_B
END_INTERFACE
FUNCTION_BLOCK FB_W EXTENDS lib.FB_Base
  IMPLEMENTS lib.I_X, I_Both
VAR_OUTPUT first,
  second : BOOL; third
  : E_K; text : STRING := 'a;b : c'; END_VAR
VAR RETAIN
  {attribute 'hide'}
  noted : INT
    := 5
END_VAR
METHOD Run(x : INT) : BOOL FB_Q(1);
END_METHOD
IF first THEN
  FB_Z(x :=
    FB_K(1));
END_IF
END_FUNCTION_BLOCK
PROGRAM P FB_W(); END_PROGRAM
"""


def test_wrapped_declarations(spark):
    """Declarations keep the line they start on; bodies keep their lines."""
    facts = extract.extract(corpus(spark, {"w.st": WRAPPED, "empty.st": "", "open.st": "VAR\n  a,"})).cache()
    assert records(extract.variables(facts), "name", "var_type", "default_value", "start_line") == sorted([
        ("first", "BOOL", None, 10), ("second", "BOOL", None, 10), ("third", "E_K", None, 11),
        ("text", "STRING", "'a;b : c'", 12), ("noted", "INT", "5", 15),
    ], key=repr)
    assert records(extract.global_lists(facts), "name", "start_line") == [("g", 2), ("h", 2)]
    assert records(extract.call_sites(facts), "scope", "callee", "line") == sorted([
        ("Run", "FB_Q", 18), ("FB_W", "FB_Z", 21), ("FB_W", "FB_K", 22), ("P", "FB_W", 25)], key=repr)
    heads = {r.name: (r.extends, r.implements) for r in extract.units(facts).collect()}
    assert heads["I_Both"] == ("I_A, lib.I_B", None) and heads["FB_W"] == ("lib.FB_Base", ["lib.I_X", "I_Both"])


def test_lines_that_wrap_nothing_stay_apart(spark):
    """A file with a wrapped declaration gives the same facts for its other parts as one without."""
    tail = "PROGRAM Q\nVAR\n  a : INT;\n  b : REAL := 1.5;\nEND_VAR\nCASE a OF\n  0: a := 1;\n  1:\n    a := 0;\nEND_CASE\nEND_PROGRAM\n"
    plain = extract.extract(corpus(spark, {"q.st": "\n\n\n\n" + tail}))
    wrapped = extract.extract(corpus(spark, {"q.st": "VAR_GLOBAL\n  g\n  : INT;\nEND_VAR\n" + tail}))
    for table in (extract.variables, extract.units, lambda f: extract.states(f)[0], lambda f: extract.states(f)[1]):
        assert records(table(wrapped)) == records(table(plain))


def test_no_line_texts_are_shuffled_for_case_blocks(spark):
    facts = extract.extract(corpus(spark, {"a.st": "PROGRAM A\nCASE s OF\n 0: s := 1; (* x *)\nEND_CASE\nEND_PROGRAM\n"}))
    assert facts.filter("text IS NOT NULL").isEmpty() and extract.states(facts)[1].count() == 1
