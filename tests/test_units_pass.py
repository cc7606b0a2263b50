"""Units are read off the facts in one pass."""

import re

from plcatlas.operators import extract
from plcatlas.plans import index_job

TEXT = """FUNCTION_BLOCK A EXTENDS B
METHOD m1
END_METHOD
METHOD open_one
METHOD m2
END_METHOD
END_FUNCTION_BLOCK
PROGRAM left_open
FUNCTION f : INT
IF f THEN END_IF
END_FUNCTION
TYPE T : STRUCT x : INT; END_STRUCT END_TYPE
PROGRAM last
"""


def facts_of(spark):
    return extract.extract(spark.createDataFrame([("a.st", TEXT), ("b.st", "// nothing\nx := 1;")], "path STRING, content STRING"))


def test_ends_of_units(spark):
    got = {r.name: (r.start_line, r.end_line, r.namespace, r.extends) for r in extract.units(facts_of(spark)).collect()}
    assert got == {
        "A": (1, 7, None, "B"), "m1": (2, 3, "A", None), "open_one": (4, None, "A", None), "m2": (5, 6, "A", None),
        "left_open": (8, None, None, None), "f": (9, 11, None, None), "last": (13, None, None, None),
    }


def test_texts_are_read_once(spark):
    """Neither units nor coverage go back to the texts, and no union halves the tasks of a window."""
    facts = facts_of(spark)
    for rows in (extract.units(facts), index_job.coverage(facts, spark.createDataFrame([("a.st",)], "path STRING"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "_strip_batch" not in plan
        assert not re.search(r"Window \[lead", plan) or "Union" not in plan
