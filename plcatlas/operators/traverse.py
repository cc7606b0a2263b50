"""Walks over the edges: frontier joins, one level per step.

A step joins the frontier with the edges and writes the next level to the checkpoint folder, so a plan never holds
more than one level. The frontier is a written table of known size: a small one is broadcast by Spark, a large one
is shuffled, and adaptive execution splits a hot node. The loop on the driver sees row counts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.operators import reach, strong
from plcatlas.operators.edges import direct_dependents, targets
from plcatlas.operators.lookup import by_keys
from plcatlas.session import cut_lineage

CALL_CHAIN_DEPTH = 10  # fixed values: default depths of the walks
CALLS_VIEW_DEPTH = 5
INHERITANCE_DEPTH = 20
DEPENDENTS_DEPTH = 20
MAX_CALL_DEPTH = 50


def _union(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, levels)


def walks(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Every walk of up to ``max_depth`` edges from the roots: ``(root, from_id, to_id, depth, walks)``.

    ``edges`` is ``(from_id, to_id)`` with one row per parallel edge. A row stands for ``walks`` equal rows of the
    bag of walk ends, so cycles cost a number and not rows; :func:`expand` gives the bag itself.
    """
    links = cut_lineage(edges.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")))
    frontier = roots.select(F.col(roots.columns[0]).alias("root")).distinct().select(
        "root", F.col("root").alias("node"), F.lit(1).cast("bigint").alias("walks")
    )
    levels = []
    for depth in range(1, max_depth + 1):
        step = (
            frontier.join(links, frontier["node"] == links["from_id"])
            .select("root", "from_id", "to_id", (F.col("walks") * F.col("n")).alias("walks"))
        )
        level = cut_lineage(step)
        if level.isEmpty():
            if not levels:
                levels.append(level.withColumn("depth", F.lit(depth)))
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
        frontier = level.groupBy("root", F.col("to_id").alias("node")).agg(F.sum("walks").alias("walks"))
    return _union(levels).select("root", "from_id", "to_id", "depth", "walks")


def expand(rows: DataFrame) -> DataFrame:
    """One row per walk."""
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("walks")))).drop("_i", "walks")


def call_chain(graph: Graph, roots: DataFrame, max_depth: int = CALL_CHAIN_DEPTH) -> DataFrame:
    """Call edges on every walk from the roots (ids), with depth and number of walks."""
    return walks(graph.calls.select("from_id", "to_id"), roots, max_depth)


def chain_sizes(calls: DataFrame, max_depth: int) -> DataFrame:
    """``id, chain_size, chain_depth``: how many walks of up to ``max_depth`` calls begin at a unit, and how long the longest is.

    Walks of k calls from a unit are those of k - 1 calls from its callees, so a level has one row a unit, whatever the number of walks.
    """
    links = cut_lineage(calls.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n")))
    level = cut_lineage(links.groupBy(F.col("from_id").alias("id")).agg(F.sum("n").alias("walks")))
    levels = [level.withColumn("depth", F.lit(1))]
    for depth in range(2, max_depth + 1):
        step = links.join(level, links["to_id"] == level["id"]).groupBy(links["from_id"]).agg(F.sum(F.col("n") * F.col("walks")).alias("walks"))
        level = cut_lineage(step.withColumnRenamed("from_id", "id"))
        if level.isEmpty():
            break
        levels.append(level.withColumn("depth", F.lit(depth)))
    return _union(levels).groupBy("id").agg(F.sum("walks").alias("chain_size"), F.max("depth").alias("chain_depth"))


def calls_view(graph: Graph, roots: DataFrame | None = None, max_depth: int = CALLS_VIEW_DEPTH) -> DataFrame:
    """Per unit: callers, callees, size of the call chain and its depth."""
    units = graph.pous.select("id", "name", "pou_type", "file_path")
    if roots is not None:
        units = by_keys(units, "id", roots)
    chain = chain_sizes(graph.calls.select("from_id", "to_id"), max_depth)
    ends = graph.calls.select(F.explode(F.array(
        F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    degrees = ends.groupBy("id").agg(F.sum("i").alias("incoming_count"), F.sum("o").alias("outgoing_count"))
    return units.join(degrees, "id", "left").join(chain, "id", "left").fillna(
        0, ["incoming_count", "outgoing_count", "chain_size", "chain_depth"]
    )


def _inheritance(graph: Graph, roots: DataFrame | None, max_depth: int, upwards: bool) -> DataFrame:
    edges = graph.relationships.filter("type = 'EXTENDS'").select("from_id", "to_id")
    if not upwards:
        edges = edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    units = graph.pous.select(F.col("id").alias("to_id"), "name", "file_path")
    edges = edges.join(units.select("to_id"), "to_id", "left_semi").select("from_id", "to_id")
    starts = graph.pous.select("id") if roots is None else roots
    rows = walks(edges, starts, max_depth)
    reached = rows.groupBy("root", "to_id", "depth").agg(F.sum("walks").alias("walks"))
    return reached.join(units, "to_id").select("root", F.col("to_id").alias("id"), "name", "file_path", "depth", "walks")


def ancestors(graph: Graph, roots: DataFrame | None = None, max_depth: int = INHERITANCE_DEPTH) -> DataFrame:
    """Base units, from child to parent."""
    return _inheritance(graph, roots, max_depth, upwards=True)


def descendants(graph: Graph, roots: DataFrame | None = None, max_depth: int = INHERITANCE_DEPTH) -> DataFrame:
    """Derived units, from parent to child."""
    return _inheritance(graph, roots, max_depth, upwards=False)


def _dependency_edges(graph: Graph) -> DataFrame:
    units = graph.pous.select(F.col("id").alias("from_id"))
    edges = graph.relationships.select("from_id", "to_id", F.col("type").alias("rel_type")).distinct()
    return cut_lineage(edges.join(units, "from_id", "left_semi").select("from_id", "to_id", "rel_type"))


def _units(graph: Graph) -> DataFrame:
    return graph.pous.select("id", "name", "pou_type", "file_path")


def dependents(graph: Graph, roots: DataFrame, max_depth: int = DEPENDENTS_DEPTH) -> reach.Reach:
    """The search behind :func:`transitive_dependents`, with a bit a root: levels hold each dependent at its smallest depth and maybe again at later ones."""
    edges = _dependency_edges(graph).select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), F.col("rel_type").alias("label"))
    return reach.search(edges, edges.filter("label <> 'CONTAINS'"), roots, max_depth)


def transitive_dependents(
    graph: Graph, roots: DataFrame, max_depth: int = DEPENDENTS_DEPTH, mode: str = "shortest"
) -> DataFrame:
    """Units that depend on the roots (ids) over any number of edges: ``(root, id, ..., rel_type, depth)``.

    The first edge may be of any type, later ones are not CONTAINS. ``shortest`` reports a dependent at its smallest
    depth only and visits it once. ``paths`` reports every depth at which a path without repeated units ends; the
    number of such paths can grow exponentially with the depth. The rows are pairs; ``impact_reach`` counts them without making them.
    """
    columns = ["root", "id", "name", "pou_type", "file_path", "rel_type", "depth"]
    if mode == "shortest":
        return reach.pairs(dependents(graph, roots, max_depth), _units(graph)).withColumnRenamed("label", "rel_type").select(*columns)
    if mode != "paths":
        raise ValueError(f"unknown mode: {mode}")
    edges = _dependency_edges(graph)
    starts = roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    first = edges.join(starts, edges["to_id"] == starts["root"]).select("root", F.col("from_id").alias("id"), "rel_type")
    return _paths(first, edges.filter("rel_type <> 'CONTAINS'"), max_depth).join(_units(graph), "id").select(*columns)


def impact_reach(graph: Graph, roots: DataFrame, max_depth: int = DEPENDENTS_DEPTH) -> DataFrame:
    """Per unit: on how many of the roots it depends, and at which smallest depth."""
    return _units(graph).join(reach.root_counts(dependents(graph, roots, max_depth)), "id")


def _paths(first: DataFrame, later: DataFrame, max_depth: int) -> DataFrame:
    """Ends of paths without repeated units. A path that leaves a strong component never comes back to it, so a row remembers only what its
    path has visited of the component it is in, and nothing outside of cycles: paths that differ in nothing else are one row.
    """
    later = later.filter("from_id <> to_id")
    components = strong.strong_components(later.select("from_id", "to_id"))
    large = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    cyclic = cut_lineage(components.join(large, "component").select("node", "component"))
    of = lambda end: cyclic.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
    # stays: the edge remains within a component; cyclic: it leads to a unit that a path may come back to
    later = cut_lineage(later.join(of("to_id"), "to_id", "left").join(of("from_id"), "from_id", "left").select(
        "from_id", "to_id", "rel_type", F.coalesce(F.col("_from_id") == F.col("_to_id"), F.lit(False)).alias("stays"), F.col("_from_id").isNotNull().alias("cyclic")
    ))
    nothing = F.array().cast("array<string>")
    begin = first.join(of("id"), "id", "left").select("root", "id", "rel_type", F.when(F.col("_id").isNotNull(), F.array("id")).otherwise(nothing).alias("visited"))
    level = cut_lineage(begin)
    levels = [level.select("root", "id", "rel_type", F.lit(1).alias("depth"))]
    for depth in range(2, max_depth + 1):
        # rows are dealt by the unit they are at, once for both the distinct rows and the join
        frontier = level.select("root", F.col("id").alias("to_id"), "visited").repartition("to_id").distinct()
        step = frontier.join(later, "to_id").filter(~(F.col("stays") & F.array_contains("visited", F.col("from_id"))))
        seen = F.when(F.col("stays"), F.array_append("visited", F.col("from_id"))).when(F.col("cyclic"), F.array("from_id")).otherwise(nothing)
        level = cut_lineage(step.select("root", F.col("from_id").alias("id"), "rel_type", seen.alias("visited")))
        if level.isEmpty():
            break
        levels.append(level.select("root", "id", "rel_type", F.lit(depth).alias("depth")))
    return _union(levels).repartition("id").distinct()


def impact(
    graph: Graph, names: DataFrame | str | None = None, max_depth: int = DEPENDENTS_DEPTH, mode: str = "shortest"
) -> DataFrame:
    """Direct and transitive dependents of named entities: ``(target, scope, id, ..., rel_type, depth)``."""
    named = cut_lineage(targets(graph, names))
    found = named.select(F.col("name").alias("target"), "id")
    direct = direct_dependents(graph, found=named).select(
        "target", F.lit("direct").alias("scope"), "id", "name", "pou_type", "file_path", "rel_type", F.lit(1).alias("depth")
    )
    roots = found.withColumnRenamed("id", "root")
    if mode == "shortest":
        reached = reach.pairs(dependents(graph, found.select("id"), max_depth), _units(graph), roots).withColumnRenamed("label", "rel_type")
    else:
        reached = transitive_dependents(graph, found.select("id"), max_depth, mode).join(roots, "root")
    transitive = reached.select(
        "target", F.lit("transitive").alias("scope"), "id", "name", "pou_type", "file_path", "rel_type", "depth"
    )
    return direct.unionByName(transitive)


def impact_summary(rows: DataFrame) -> DataFrame:
    """Rows per target: direct edges, transitive entries, deepest level."""
    return rows.groupBy("target").agg(
        F.count_if(F.col("scope") == "direct").alias("direct_count"),
        F.count_if(F.col("scope") == "transitive").alias("transitive_count"),
        F.max("depth").alias("max_depth"),
    )


def max_call_depth(graph: Graph, cap: int = MAX_CALL_DEPTH) -> DataFrame:
    """Length of the longest call walk, at most ``cap``; one row.

    Only the distinct ends of the walks of each length are kept. The sets shrink from level to level; a set that no
    longer shrinks is fed by a cycle, so walks of any length exist and the answer is the cap.
    """
    spark = graph.pous.sparkSession
    links = cut_lineage(graph.calls.select("from_id", "to_id").distinct())
    ends = cut_lineage(links.select(F.col("to_id").alias("node")).distinct())
    depth, size = 0, ends.count()
    while size and depth < cap:
        depth += 1
        if depth == cap:
            break
        ends = cut_lineage(
            links.join(ends, links["from_id"] == ends["node"], "left_semi").select(F.col("to_id").alias("node")).distinct()
        )
        size, before = ends.count(), size
        if size == before:
            depth = cap
    return spark.createDataFrame([(depth,)], "max_call_depth INT")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left after nodes without entering or without leaving edges are removed until none is left.

    The result is empty exactly if the edges hold no cycle; otherwise it holds the cycles and what connects them.
    """
    return strong.trimmed(edges)


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_core(edges).isEmpty()


def strong_components(graph: Graph) -> DataFrame:
    """``node, component``: entities that lead to each other over edges of any type."""
    return strong.strong_components(graph.relationships)
