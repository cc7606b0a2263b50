"""Counts, health figures, hotspots and per-unit metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.functions.text import half_up
from plcatlas.graph import Graph
from plcatlas.operators import edges, traverse

DAY_MS = 24 * 60 * 60 * 1000
MERMAID_EDGES = 200  # fixed value: edges drawn in the index document


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def counts_by_type(graph: Graph) -> DataFrame:
    """``(section, type, count)`` for unit types, type kinds and edge types."""
    part = lambda df, section, column: (
        df.groupBy(F.col(column).alias("type"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.lit(section).alias("section"), "type", "count")
    )
    return union_all([
        part(graph.pous, "pou", "pou_type"),
        part(graph.types, "type", "type_kind"),
        part(graph.relationships, "edge", "type"),
    ])


def _totals(graph: Graph) -> DataFrame:
    """``(key, value)``: one count per table. One-row aggregates are stacked, not crossed."""
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
    return union_all([
        n(graph.files, "files"),
        n(graph.pous, "pous"),
        n(graph.types, "types"),
        n(graph.variables, "variables"),
        n(graph.relationships, "relationships"),
        n(graph.calls, "calls"),
    ])


def _value(key: str):
    return F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(0))


def _per_pou(key: str):
    ratio = half_up(_value(key) / _value("pous"), 2)
    return F.when(_value("pous") > 0, ratio).otherwise(F.lit(0.0))


def graph_overview(graph: Graph) -> DataFrame:
    return _totals(graph).agg(
        _value("files").alias("total_files"),
        _value("pous").alias("total_pous"),
        _value("types").alias("total_types"),
        _value("variables").alias("total_variables"),
        _value("relationships").alias("total_relationships"),
        _per_pou("variables").alias("avg_variables_per_pou"),
    )


def graph_health(graph: Graph) -> DataFrame:
    """``(section, key, value)``: entities and edges by type with totals, files, last index time, status.

    A unit type and a type kind of the same name are one entry.
    """
    counts = counts_by_type(graph).select(
        F.when(F.col("section") == "edge", "edges").otherwise("entities").alias("section"), "type", "count"
    )
    by_type = counts.groupBy("section", F.col("type").alias("key")).agg(F.sum("count").alias("value"))
    files = graph.files.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.max("last_indexed"), F.lit(0)).alias("last_indexed")
    )
    stacked = files.select(F.stack(F.lit(2), F.lit("total"), "total", F.lit("last_indexed"), "last_indexed").alias("key", "value"))
    # totals come from the few rows of by_type; the union with zeros keeps them present in an empty graph
    zeros = graph.pous.sparkSession.createDataFrame([("edges", 0), ("entities", 0)], "section STRING, value BIGINT")
    sums = by_type.select("section", "value").unionByName(zeros).groupBy("section").agg(F.sum("value").alias("value"))
    status = sums.filter("section = 'entities'").select(
        F.lit("status").alias("section"), F.when(F.col("value") > 0, "ready").otherwise("empty").alias("key"),
        F.lit(1).cast("bigint").alias("value"),
    )
    return union_all([
        by_type,
        sums.select("section", F.lit("total").alias("key"), "value"),
        stacked.select(F.lit("files").alias("section"), "key", "value"),
        status,
    ])


def stale_files(graph: Graph, now_ms: int, age_ms: int = DAY_MS) -> DataFrame:
    return graph.files.filter(F.col("last_indexed") < now_ms - age_ms).select("path", "last_indexed")


def extended_stats(graph: Graph, now_ms: int) -> DataFrame:
    """One row: averages per unit, deepest call chain, number of stale files and of orphans."""
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
    rows = union_all([
        _totals(graph),
        n(stale_files(graph, now_ms), "stale_files"),
        n(edges.orphans(graph), "orphans"),
        traverse.max_call_depth(graph).select(F.lit("max_call_depth").alias("key"), F.col("max_call_depth").cast("bigint").alias("value")),
    ])
    return rows.agg(
        _per_pou("variables").alias("avg_vars_per_pou"),
        _per_pou("calls").alias("avg_calls_per_pou"),
        _value("max_call_depth").alias("max_call_depth"),
        _value("stale_files").alias("stale_files"),
        _value("orphans").alias("orphans"),
    )


def most_connected(graph: Graph, limit: int = 10) -> DataFrame:
    """Distinct sources plus distinct targets over an entity's edges; entities without edges are left out.

    Every edge is seen from both ends (one scan, no OR join). Seen from its own end a node adds itself, hence one
    distinct source if it has leaving edges and one distinct target if it has entering ones.
    """
    seen = lambda node, side, other: F.struct(
        F.col(node).alias("id"), F.lit(side).alias("side"), F.col(other).alias("other")
    )
    ends = F.array(
        seen("from_id", "to", "to_id"), seen("from_id", "from", "from_id"),
        seen("to_id", "from", "from_id"), seen("to_id", "to", "to_id"),
    )
    pairs = graph.relationships.select(F.explode(ends).alias("e")).select("e.*").distinct()
    scores = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("connections"))
    nodes = graph.pous.select("id", "name").unionByName(graph.types.select("id", "name"))
    return nodes.join(scores, "id").orderBy(F.desc("connections"), "id").limit(limit)


def hotspots(graph: Graph, metric: str = "combined", limit: int = 10) -> DataFrame:
    """Units by number of distinct dependents, of variables, or both; edges and variables are counted first."""
    dependents = graph.relationships.groupBy(F.col("to_id").alias("id")).agg(
        F.count_distinct("from_id").alias("dependents")
    )
    variables = graph.variables.groupBy(F.col("pou_id").alias("id")).agg(F.count(F.lit(1)).alias("variables"))
    rows = (
        graph.pous.select("id", "name", F.col("pou_type").alias("type"), F.col("file_path").alias("file"))
        .join(dependents, "id", "left")
        .join(variables, "id", "left")
        .fillna(0, ["dependents", "variables"])
    )
    if metric == "dependents":
        rows = rows.filter("dependents > 0").withColumn("score", F.col("dependents"))
    elif metric in ("variables", "complexity"):
        rows = rows.filter("variables > 0").withColumn("score", F.col("variables"))
    elif metric == "combined":
        rows = rows.withColumn("score", F.col("dependents") + F.col("variables"))
    else:
        raise ValueError(f"unknown hotspot metric: {metric}")
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def indegree_top(graph: Graph, limit: int = 10) -> DataFrame:
    """Edges per target, the names looked up for the few rows that remain."""
    top = (
        graph.relationships.groupBy(F.col("to_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("dependents_count"))
        .orderBy(F.desc("dependents_count"), "id")
        .limit(limit)
    )
    nodes = graph.pous.select("id", "name").unionByName(graph.types.select("id", "name"))
    # at most `limit` rows on the broadcast side
    return nodes.join(F.broadcast(top), "id", "right").select("id", "name", "dependents_count")


def health_score(graph: Graph) -> DataFrame:
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
    kinds = graph.pous.groupBy("pou_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pous"),
        F.coalesce(F.sum(F.when(F.col("pou_type") == "FUNCTION_BLOCK", F.col("n"))), F.lit(0)).alias("fbs"),
        F.coalesce(F.sum(F.when(F.col("pou_type") == "PROGRAM", F.col("n"))), F.lit(0)).alias("programs"),
    )
    rows = kinds.select(
        F.stack(F.lit(3), F.lit("pous"), "pous", F.lit("fbs"), "fbs", F.lit("programs"), "programs").alias("key", "value")
    ).unionByName(n(edges.isolated(graph), "isolated"))
    connected = (_value("pous") - _value("isolated")) / _value("pous") * 100
    return rows.agg(
        F.when(_value("pous") > 0, half_up(connected)).otherwise(100).cast("bigint").alias("score"),
        _value("fbs").alias("fb_count"), _value("programs").alias("program_count"),
        _value("pous").alias("total_nodes"), _value("isolated").alias("isolated_nodes"),
    )


def pou_metrics(graph: Graph, name: str | None = None, file_path: str | None = None) -> DataFrame:
    """Lines, variables by direction and calls of every unit: one pass over variables, one over calls."""
    pous = graph.pous
    if name is not None:
        pous = pous.filter(F.col("name") == name)
    if file_path:
        pous = pous.filter(F.col("file_path").ilike(f"%{file_path}%"))
    direction = F.col("direction")
    variables = graph.variables.groupBy(F.col("pou_id").alias("id")).agg(
        F.count_if(direction == "VAR_INPUT").alias("input_vars"),
        F.count_if(direction == "VAR_OUTPUT").alias("output_vars"),
        F.count_if(~direction.isin("VAR_INPUT", "VAR_OUTPUT")).alias("internal_vars"),
        F.count(F.lit(1)).alias("total_vars"),
    )
    calls = graph.calls.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    lines = F.coalesce("end_line", "start_line") - F.col("start_line") + 1
    rows = (
        pous.select("id", "name", "pou_type", "file_path", lines.alias("lines"), "start_line")
        .join(variables, "id", "left")
        .join(calls, "id", "left")
        .fillna(0, ["input_vars", "output_vars", "internal_vars", "total_vars", "calls"])
    )
    if name is not None:
        rows = rows.orderBy("file_path", "start_line", "id").limit(1)
    return rows.drop("start_line")


def health_report(graph: Graph, mode: str = "full", now_ms: int | None = None) -> DataFrame:
    """``(part, section, key, value)`` as text; the parts depend on the mode."""
    parts = [graph_health(graph).select(F.lit("basic").alias("part"), "section", "key", F.col("value").cast("string").alias("value"))]
    if mode in ("extended", "full"):
        if now_ms is None:
            raise ValueError("the extended report needs now_ms")
        stats = extended_stats(graph, now_ms)
        parts.append(_long(stats, "extended", "stats"))
        parts.append(stale_files(graph, now_ms).select(
            F.lit("extended").alias("part"), F.lit("stale_file").alias("section"), F.col("path").alias("key"),
            F.col("last_indexed").cast("string").alias("value"),
        ))
        parts.append(edges.orphans(graph).select(
            F.lit("extended").alias("part"), F.concat(F.lit("orphan_"), "type").alias("section"), F.col("id").alias("key"),
            F.col("name").alias("value"),
        ))
    if mode in ("metrics", "full"):
        parts.append(_long(graph_overview(graph), "metrics", "totals"))
    if mode in ("stats", "full"):
        parts.append(counts_by_type(graph).select(
            F.lit("stats").alias("part"), "section", F.col("type").alias("key"), F.col("count").cast("string").alias("value")
        ))
        parts.append(most_connected(graph).select(
            F.lit("stats").alias("part"), F.lit("most_connected").alias("section"), F.col("id").alias("key"),
            F.col("connections").cast("string").alias("value"),
        ))
    if mode not in ("basic", "extended", "metrics", "stats", "full"):
        raise ValueError(f"unknown report mode: {mode}")
    return union_all(parts)


def _long(row: DataFrame, part: str, section: str) -> DataFrame:
    text = row.select(*[F.col(c).cast("string").alias(c) for c in row.columns])
    return text.unpivot([], text.columns, "key", "value").select(
        F.lit(part).alias("part"), F.lit(section).alias("section"), "key", "value"
    )
