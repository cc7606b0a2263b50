import random
from collections import Counter

import pytest
from conftest import records

from plcatlas.functions import text
from plcatlas.graph import Graph
from plcatlas.operators import clones, edges, lookup, metrics, near_clones, paging, strong, traverse
from pyspark.sql import functions as F

EDGE = "id STRING, from_id STRING, to_id STRING, type STRING"
POU = "id STRING, name STRING, pou_type STRING, file_path STRING, start_line INT"


def small_graph(spark, pairs, n, kinds=("CALLS",)):
    rows = [(f"e{i}", f"n{a}", f"n{b}", kinds[i % len(kinds)]) for i, (a, b) in enumerate(pairs)]
    pous = [(f"n{i}", f"N{i}", "FUNCTION_BLOCK", f"f{i % 3}", i) for i in range(n)]
    return Graph(spark, pous=spark.createDataFrame(pous, POU), relationships=spark.createDataFrame(rows, EDGE))


def random_pairs(seed, n, m):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_walks_equal_enumeration(spark):
    pairs = random_pairs(7, 6, 10) + [(0, 1), (0, 1)]
    graph = small_graph(spark, pairs, 6)
    got = Counter(map(tuple, records(traverse.expand(traverse.call_chain(graph, graph.pous.select("id"), max_depth=4)))))
    want, level = Counter(), [(f"n{a}", f"n{a}", f"n{b}") for a, b in pairs]
    for depth in range(1, 5):
        want.update((r, a, b, depth) for r, a, b in level)
        level = [(r, b, f"n{d}") for r, _, b in level for c, d in pairs if f"n{c}" == b]
    assert got == want
    sizes = {r.id: (r.chain_size, r.chain_depth) for r in traverse.calls_view(graph, max_depth=4).collect()}
    for i in range(6):
        own = [d for (r, _, _, d), n in want.items() if r == f"n{i}" for _ in range(n)]
        assert sizes[f"n{i}"] == (len(own), max(own, default=0))


def test_shortest_and_paths(spark):
    pairs = random_pairs(11, 7, 14)
    graph = small_graph(spark, pairs, 7, ("CALLS", "CONTAINS", "USES"))
    rel = [(r.from_id, r.to_id, r.type) for r in graph.relationships.collect()]
    want = set()

    def walk(root, node, depth, seen):
        for a, b, t in rel:
            if b == node and (depth == 1 or t != "CONTAINS") and (depth == 1 or a not in seen):
                want.add((root, a, t, depth))
                if depth < 6:
                    walk(root, a, depth + 1, seen | {a})

    for i in range(7):
        walk(f"n{i}", f"n{i}", 1, frozenset())
    got = set(records(traverse.transitive_dependents(graph, graph.pous.select("id"), max_depth=6, mode="paths"), "root", "id", "rel_type", "depth"))
    assert got == want
    best = {}
    for root, node, _, depth in want:
        best[root, node] = min(depth, best.get((root, node), 99))
    short = records(traverse.transitive_dependents(graph, graph.pous.select("id"), max_depth=6), "root", "id", "depth")
    assert {(r, i): d for r, i, d in short} == best
    counts = records(traverse.impact_reach(graph, graph.pous.select("id"), 6), "id", "n_roots", "min_depth")
    assert counts == sorted((i, len(ds), min(ds)) for i in {i for _, i in best} for ds in [[d for (_, j), d in best.items() if j == i]])


def test_search_from_more_roots_than_a_block(spark):
    pairs = random_pairs(5, 200, 330)
    graph = small_graph(spark, pairs, 200)
    want = {}
    for root in range(0, 200, 2):
        level, depth, seen = {root}, 0, set()
        while level and depth < 20:
            depth += 1
            level = {a for a, b in pairs if b in level} - seen
            seen |= level
            want.update({(f"n{root}", f"n{a}"): depth for a in level})
    roots = spark.createDataFrame([(f"n{i}",) for i in range(0, 200, 2)] * 2, "id STRING").repartition(3)
    assert {(r, i): d for r, i, d in records(traverse.transitive_dependents(graph, roots), "root", "id", "depth")} == want
    nobody = spark.createDataFrame([("nobody",)], "id STRING")
    assert traverse.transitive_dependents(graph, nobody).count() == 0 and traverse.impact_reach(graph, nobody).count() == 0


def by_hand(pairs):
    nodes = {x for p in pairs for x in p}
    ways = {n: {b for a, b in pairs if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in ways[n]:
                ways[n] |= ways[k]
    return {n: min([n, *(m for m in nodes if m in ways[n] and n in ways[m])]) for n in nodes}


@pytest.mark.parametrize("seed, n, m", [(1, 40, 60), (2, 30, 90), (3, 60, 62), (4, 25, 24)])
def test_strong_components(spark, seed, n, m):
    pairs = [(f"{a:03}", f"{b:03}") for a, b in random_pairs(seed, n, m)]
    edges = spark.createDataFrame(pairs, "from_id STRING, to_id STRING")
    assert dict(records(strong.strong_components(edges))) == by_hand(pairs)


def test_strong_components_of_rings_and_chains(spark):
    ring = [(f"r{i:03}", f"r{(i + 1) % 70:03}") for i in range(70)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("c040", "r000"), ("r035", "d000"), ("d000", "d001"), ("s", "s")]
    edges = spark.createDataFrame(ring + chain, "from_id STRING, to_id STRING")
    assert dict(records(strong.strong_components(edges))) == by_hand(ring + chain)
    assert strong.strong_components(edges.limit(0)).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = strong.cut_lineage
    monkeypatch.setattr(strong, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    edges = spark.range(4096).selectExpr("concat('n', id) AS from_id", "concat('n', id + 1) AS to_id")
    assert strong.trimmed(edges).isEmpty() and len(rounds) <= 30


def test_near_clones(spark):
    rng = random.Random(3)
    shared = [("x", f"T{k}") for k in range(12)]
    sets = {}
    for i in range(90):
        own = shared[: rng.randint(2, 12)] + [(f"v{rng.randint(0, 30)}", "INT") for _ in range(rng.randint(0, 4))]
        sets[f"u{i:02}"] = set(own)
    sets.update({f"w{i}": sets["u05"] for i in range(5)})
    rows = [(f"{u}:{k}", u, n, t, ("VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT")[k % 3]) for u, own in sets.items() for k, (n, t) in enumerate([*own, *list(own)[:2]])]
    rows += [(f"{u}:own", u, "private", u, "VAR") for u in sets]
    graph = Graph(
        spark, pous=spark.createDataFrame([(u, u, "FUNCTION_BLOCK", "f", 1) for u in sets], POU),
        variables=spark.createDataFrame(rows, "id STRING, pou_id STRING, name STRING, var_type STRING, direction STRING"),
    )
    for percent in (80, 50, 100):
        big = {u: s for u, s in sets.items() if len(s) >= 3}
        linked = {u: [w for w, b in big.items() if w != u and 100 * len(a & b) >= percent * len(a | b)] for u, a in big.items()}
        want = sorted(
            (u, min(w for w, b in big.items() if b == big[u]), sum(b == big[u] for b in big.values()), len({frozenset(big[w]) for w in ws} - {frozenset(big[u])}), len(ws))
            for u, ws in linked.items() if ws
        )
        got = records(near_clones.near_clones(graph, percent), "id", "class_id", "class_size", "near_classes", "links")
        assert got == want and len(want) > 5
    assert near_clones.near_clones(Graph(spark)).count() == 0


@pytest.mark.parametrize("pairs, depth, cyclic", [
    ([(0, 1), (1, 2), (2, 3)], 3, False), ([(0, 1), (1, 0), (1, 2)], 50, True), ([(0, 0)], 50, True), ([(0, 1), (2, 1)], 1, False),
])
def test_depth_and_cycles(spark, pairs, depth, cyclic):
    graph = small_graph(spark, pairs, 4)
    assert records(traverse.max_call_depth(graph)) == [(depth,)]
    assert traverse.has_cycle(graph.relationships) is cyclic


def test_depth_is_capped(spark):
    graph = small_graph(spark, [(i, i + 1) for i in range(9)], 10)
    assert records(traverse.max_call_depth(graph, cap=5)) == [(5,)]
    assert records(traverse.max_call_depth(Graph(spark))) == [(0,)]


def test_paged_lists_keep_everything(spark):
    rows = [("hot", f"i{i}", i) for i in range(500)] + [("cold", "a", 1), ("cold", "b", None)]
    df = spark.createDataFrame(rows, "k STRING, id STRING, v INT")
    pages = paging.paged_lists(df, ["k"], {"vs": F.col("v")}, ["id"], page_rows=50).collect()
    assert sorted(v for p in pages if p.k == "hot" for v in p.vs) == list(range(500))
    assert max(len(p.vs) for p in pages) < 120
    assert [(p.page, p.vs) for p in pages if p.k == "cold"] == [(0, [1])]


def test_pages_are_ranges_of_the_sorted_lists(spark):
    rows = [(k, f"i{i:03}", i * 37 % 101, i % 3) for k, n in (("hot", 400), (None, 95), ("cold", 3)) for i in range(n)] + [("none", "x", None, 0)]
    df = spark.createDataFrame(rows, "k STRING, id STRING, v INT, list INT").repartition(7)
    lists = {"a": F.when(F.col("list") == 0, F.col("v")), "b": F.when(F.col("list") > 0, F.struct("v", "id"))}
    whole = {r.k: (r.a, r.b) for r in paging.paged_lists(df, ["k"], lists, ["id"]).collect()}
    pages = sorted(paging.paged_lists(df, ["k"], lists, ["id"], page_rows=20).collect(), key=lambda r: r.page)
    for k, (a, b) in whole.items():
        own = [r for r in pages if r.k == k]
        assert [x for r in own for x in r.a] == a and [x for r in own for x in r.b] == b
        assert [r.page for r in own] == list(range(len(own)))
        assert all(len(r.a) == min(20, max(0, len(a) - 20 * r.page)) for r in own)


def test_counts_and_links_of_paged_units(spark):
    from plcatlas.operators import render

    graph = small_graph(spark, [(0, 1)] * 30 + [(2, 1)] * 5 + [(0, 2)], 3)
    var = "id STRING, pou_id STRING, name STRING, direction STRING, var_type STRING"
    graph = graph.with_tables(variables=spark.createDataFrame([(f"v{i}", "n0", f"x{i}", "VAR_INPUT", "T") for i in range(30)], var))
    flow = [r for r in lookup.variable_flow(graph, page_rows=10).collect() if r.id == "n0"]
    assert len(flow) == 3 and {r.input_count for r in flow} == {30} and {r.output_count for r in flow} == {0}
    pages = sorted(render.pou_documents(graph, page_rows=10).filter("entity_id = 'n0'").collect(), key=lambda r: r.page)
    bodies = "\n".join(r.body for r in pages)
    assert bodies.count("[[N1|f1]]") == 1 and bodies.count("[[N2|f2]]") == 1 and "Outgoing CALLS (31)" in bodies
    assert [bodies.index(f"`x{i}`") for i in sorted(range(30), key=str)] == sorted(bodies.index(f"`x{i}`") for i in range(30))


def test_clones_ignore_order(spark):
    var = "id STRING, pou_id STRING, name STRING, direction STRING, var_type STRING"
    sets = {"n0": "abc", "n1": "cba", "n2": "abd", "n3": "ab", "n4": "aab", "n5": "abb"}
    rows = [(f"{p}{i}", p, c, "VAR_INPUT", "T") for p, cs in sets.items() for i, c in enumerate(cs)]
    graph = small_graph(spark, [(0, 1)], 6).with_tables(variables=spark.createDataFrame(rows, var))
    found = clones.pou_clones(graph)
    assert records(found, "group_id", "id", "group_size", "items") == [("n0", "n0", 2, 3), ("n0", "n1", 2, 3)]
    assert records(clones.clone_summary(found)) == [(1, 2)]


def test_search_wildcards(spark):
    names = ["FB_A", "FBxA", "fb_a2", "a\\b"]
    pous = spark.createDataFrame([(n, n, "PROGRAM", "f", 1) for n in names], POU)
    graph = Graph(spark, pous=pous)
    hit = lambda q, **o: records(lookup.search_pous(graph, q, **o), "name")
    assert hit("b_a") == []
    assert hit("FB_A") == [("FB_A",), ("FBxA",)]
    assert hit("bxa") == [("FBxA",)]
    assert hit("bxa", case_sensitive=True) == []
    assert hit("a\\b") == [("a\\b",)]
    assert hit("^fb.a$", regex=True) == [("FB_A",), ("FBxA",)]


def test_envelope(spark):
    rows = spark.range(120)
    full, default, some = paging.envelope(rows, 0), paging.envelope(rows), paging.envelope(rows, 200)
    assert (full.count, full.total_count, full.has_more, full.limit) == (120, 120, False, None)
    assert (default.count, default.has_more, default.rows.count()) == (50, True, 50)
    assert (some.count, some.has_more) == (120, False)


def test_pages_cover_the_graph(spark):
    graph = small_graph(spark, random_pairs(3, 25, 40), 25)
    seen, after = [], None
    while True:
        page = paging.graph_page(graph, 7, after)
        rows = page.collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        after = (rows[-1].kind, rows[-1].file, rows[-1].line, rows[-1].id)
        ids = {r.id for r in rows}
        assert {r.source for r in paging.graph_page_edges(graph, page).collect()} <= ids
    assert sorted(seen) == sorted(f"n{i}" for i in range(25)) and len(seen) == 25


def test_text_functions(spark):
    row = spark.range(1).select(
        text.slugify(F.lit("__a.é-b__")).alias("slug"), text.wikilink(F.lit("A b"), F.lit("")).alias("bare"),
        text.half_up(F.lit(1.005), 2).alias("half"), text.args_preview(F.lit(None).cast("string")).alias("none"),
        text.relative_path(F.lit("C:\\ws\\a\\b.st"), "C:\\ws").alias("inside"), text.relative_path(F.lit("D:\\x"), "C:\\ws").alias("outside"),
        text.iso_time(F.lit(1700000000123)).alias("iso"), text.definition_size(F.lit("{bad")).alias("bad"),
        text.infer_type(F.lit("Thing (STRUCT)")).alias("kind"),
    ).first()
    assert row.slug == "_a_b_".strip("_") and row.bare == "[[A_b]]" and row.half == 1.0 and row.none == "{}"
    assert (row.inside, row.outside, row.iso) == ("a/b.st", "D:\\x", "2023-11-14T22:13:20.123Z")
    assert (row.bad, row.kind) == (0, "TYPE")


def test_empty_graph_reports(spark):
    empty = Graph(spark)
    assert records(metrics.health_score(empty)) == [(100, 0, 0, 0, 0)]
    assert records(metrics.graph_overview(empty)) == [(0, 0, 0, 0, 0, 0.0)]
    assert ("status", "empty", 1) in records(metrics.graph_health(empty))


def test_interface_units_have_implementers(spark):
    pous = spark.createDataFrame([("i", "I_X", "INTERFACE", "f", 1), ("a", "A", "PROGRAM", "f", 2)], POU)
    rel = spark.createDataFrame([("e", "a", "i", "IMPLEMENTS")], EDGE)
    assert records(edges.implementers(Graph(spark, pous=pous, relationships=rel), "I_X"), "interface", "name") == [("I_X", "A")]
