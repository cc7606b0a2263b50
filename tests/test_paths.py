"""Paths without repeated units: what a search writes, and cycles that share units."""

import random

import pytest
from conftest import records

from plcatlas.graph import Graph
from plcatlas.operators import traverse


def graph_of(spark, pairs):
    nodes = sorted({n for a, b, _ in pairs for n in (a, b)})
    pous = spark.createDataFrame([(n, n) for n in nodes], "id STRING, name STRING").coalesce(1)
    rows = [(f"{a}{kind}{b}", a, b, kind) for a, b, kind in pairs]
    return Graph(spark, pous=pous, relationships=spark.createDataFrame(rows, "id STRING, from_id STRING, to_id STRING, type STRING").coalesce(1))


def test_ways_that_meet_again_are_one_row(spark, monkeypatch):
    """Seven forks in a row: 128 paths lead from the last unit to the first."""
    pairs = [(f"{side}{k}", f"m{k}", "CALLS") for k in range(7) for side in "ab"] + [(f"m{k + 1}", f"{side}{k}", "CALLS") for k in range(7) for side in "ab"]
    graph, written, cut = graph_of(spark, pairs), [], traverse.cut_lineage

    def counted(rows):
        table = cut(rows)
        written.append(table.count() if "visited" in table.columns else 0)
        return table

    monkeypatch.setattr(traverse, "cut_lineage", counted)
    found = traverse.transitive_dependents(graph, spark.createDataFrame([("m0",)], "id STRING"), 20, "paths")
    assert found.filter("id = 'm7' AND depth = 14").count() == 1 and found.count() == 21
    assert sum(written) <= 2 * 21


@pytest.mark.parametrize("seed", [1])
def test_paths_through_cycles(spark, seed):
    draw = random.Random(seed)
    pairs = sorted({(f"n{draw.randrange(9)}", f"n{draw.randrange(9)}", draw.choice(["CALLS", "EXTENDS", "CONTAINS"])) for _ in range(22)})
    graph, want = graph_of(spark, pairs), set()
    roots = sorted({b for _, b, _ in pairs})
    for root in roots:
        level = {(a, kind, (a,)) for a, b, kind in pairs if b == root}
        for depth in range(1, 6):
            want |= {(root, node, kind, depth) for node, kind, _ in level}
            level = {(a, kind, (*seen, a)) for node, _, seen in level for a, b, kind in pairs if b == node and kind != "CONTAINS" and a not in seen}
    got = traverse.transitive_dependents(graph, spark.createDataFrame([(r,) for r in roots], "id STRING"), 5, "paths")
    assert records(got, "root", "id", "rel_type", "depth") == sorted(want, key=repr)
