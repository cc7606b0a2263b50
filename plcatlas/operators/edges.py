"""Joins over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.operators.lookup import by_keys, first_by_name
from plcatlas.operators.paging import LIST_ROWS, paged_lists


def node_ids(graph: Graph) -> DataFrame:
    """Ids of everything an edge may touch."""
    return graph.pous.select("id").unionByName(graph.types.select("id"))


def fb_instances(graph: Graph, fb: DataFrame | str | None = None) -> DataFrame:
    """Variables typed with a unit's name, with the owning unit; all of them unless names are given."""
    if fb is None:
        fb = graph.pous.select("name")
    variables = by_keys(graph.variables, "var_type", fb).select(
        "pou_id", F.col("id").alias("var_id"), F.col("name").alias("var_name"), "direction", "var_type",
        F.col("start_line").alias("line"),
    )
    owners = graph.pous.select(
        F.col("id").alias("pou_id"), F.col("name").alias("pou_name"), "pou_type", F.col("file_path").alias("file")
    )
    return variables.join(owners, "pou_id").drop("pou_id")


def importers(graph: Graph, name: str, limit: int | None = 100) -> DataFrame:
    """Units that declare a variable of the type, once per line."""
    rows = (
        fb_instances(graph, name)
        .select(F.col("pou_name").alias("name"), F.col("pou_type").alias("type"), "file", "line")
        .distinct()
    )
    return rows if not limit else rows.orderBy("name", "type", "file", "line").limit(limit)


def references(graph: Graph, ids: DataFrame | str | None = None) -> DataFrame:
    """Edges that touch an entity, as ``(entity_id, direction, ...)``; a loop appears in both directions."""
    columns = ["id", "from_id", "to_id", "type"]
    rel = graph.relationships
    leaving = rel.select(F.col("from_id").alias("entity_id"), F.lit("out").alias("direction"), *columns)
    entering = rel.select(F.col("to_id").alias("entity_id"), F.lit("in").alias("direction"), *columns)
    if ids is None:
        return leaving.unionByName(entering)
    return by_keys(leaving, "entity_id", ids).unionByName(by_keys(entering, "entity_id", ids))


def call_hierarchy(graph: Graph, ids: DataFrame | str | None = None, direction: str = "both") -> DataFrame:
    """One hop of calls around units, with the name of the other side where it is a known unit."""
    calls = graph.calls
    known = graph.pous.select(
        F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("file_path").alias("other_file")
    )
    sides = []
    if direction in ("incoming", "both"):
        sides.append(calls.select(
            F.col("to_id").alias("pou_id"), F.lit("incoming").alias("direction"), F.col("from_id").alias("other_id"),
            "line", "id",
        ))
    if direction in ("outgoing", "both"):
        sides.append(calls.select(
            F.col("from_id").alias("pou_id"), F.lit("outgoing").alias("direction"), F.col("to_id").alias("other_id"),
            "line", "id",
        ))
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    if ids is not None:
        rows = by_keys(rows, "pou_id", ids)
    return rows.join(known, "other_id", "left").select(
        "id", "pou_id", "direction", "other_id", "other_name", "other_file", "line"
    )


def implementers(graph: Graph, names: DataFrame | str | None = None) -> DataFrame:
    """Units that implement an interface; the interface may be a type or a unit of kind INTERFACE."""
    interfaces = graph.types.select("id", "name").unionByName(
        graph.pous.filter("pou_type = 'INTERFACE'").select("id", "name")
    )
    if names is not None:
        interfaces = by_keys(interfaces, "name", names)
    interfaces = interfaces.select(F.col("id").alias("to_id"), F.col("name").alias("interface"))
    edges = graph.relationships.filter("type = 'IMPLEMENTS'").select("from_id", "to_id").join(interfaces, "to_id")
    units = graph.pous.select(F.col("id").alias("from_id"), "name", "pou_type", "file_path")
    return edges.join(units, "from_id").select(
        "interface", F.col("from_id").alias("id"), "name", "pou_type", "file_path"
    )


def targets(graph: Graph, names: DataFrame | str | None = None) -> DataFrame:
    """Name -> entity id: the first unit of the name, else the first type of the name."""
    pous, types = graph.pous, graph.types
    if names is not None:
        pous, types = by_keys(pous, "name", names), by_keys(types, "name", names)
    unit = first_by_name(pous).withColumnRenamed("id", "pou_id")
    type_ = first_by_name(types).withColumnRenamed("id", "type_id")
    return unit.join(type_, "name", "full").select("name", F.coalesce("pou_id", "type_id").alias("id"))


def direct_dependents(
    graph: Graph, names: DataFrame | str | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Units with an edge to the named entity, one row per edge; ``found`` is ``targets`` where that is at hand."""
    found = targets(graph, names) if found is None else found
    found = found.select(F.col("name").alias("target"), F.col("id").alias("to_id"))
    edges = graph.relationships.select(
        F.col("id").alias("edge_id"), "from_id", "to_id", F.col("type").alias("rel_type")
    )
    units = graph.pous.select(F.col("id").alias("from_id"), "name", "pou_type", "file_path")
    return (
        edges.join(found, "to_id")
        .join(units, "from_id")
        .select("target", "edge_id", F.col("from_id").alias("id"), "name", "pou_type", "file_path", "rel_type")
    )


def _flow_parts(graph: Graph, names: DataFrame | str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    callers = graph.pous if names is None else by_keys(graph.pous, "name", names)
    callers = callers.select(F.col("id").alias("from_id"), F.col("name").alias("from_pou"))
    callees = graph.pous.select(F.col("id").alias("to_id"), F.col("name").alias("to_pou"))
    edges = (
        graph.calls.select(F.col("id").alias("edge_id"), "from_id", "to_id")
        .join(callers, "from_id")
        .join(callees, "to_id")
    )
    side = lambda direction, key, name, kind: graph.variables.filter(F.col("direction") == direction).select(
        F.col("pou_id").alias(key), F.col("name").alias(name), F.col("var_type").alias(kind)
    )
    return edges, side("VAR_OUTPUT", "from_id", "from_var", "from_type"), side("VAR_INPUT", "to_id", "to_var", "to_type")


def data_flow(graph: Graph, names: DataFrame | str | None = None, by_type: bool = False) -> DataFrame:
    """Outputs of a caller against inputs of its callee, per call edge.

    The result is as large as outputs times inputs along every call; ``data_flow_summary`` holds the same
    information in one row per call edge and is the form to use over a whole graph. ``by_type`` keeps only pairs
    of the same declared type, as part of the join key.
    """
    edges, outputs, inputs = _flow_parts(graph, names)
    flows = edges.join(outputs, "from_id")
    if by_type:
        flows = flows.join(
            inputs.withColumnRenamed("to_type", "from_type"), ["to_id", "from_type"]
        )
    else:
        flows = flows.join(inputs, "to_id")
    return flows.select("edge_id", "from_pou", "from_var", "to_pou", "to_var")


def data_flow_summary(graph: Graph, names: DataFrame | str | None = None) -> DataFrame:
    """Number of outputs, inputs and flows per call edge; variables are counted before they meet an edge."""
    edges, outputs, inputs = _flow_parts(graph, names)
    outputs = outputs.groupBy("from_id").agg(F.count(F.lit(1)).alias("outputs"))
    inputs = inputs.groupBy("to_id").agg(F.count(F.lit(1)).alias("inputs"))
    return (
        edges.join(outputs, "from_id")
        .join(inputs, "to_id")
        .select("edge_id", "from_pou", "to_pou", "outputs", "inputs", (F.col("outputs") * F.col("inputs")).alias("flows"))
    )


def cross_file_dependencies(graph: Graph, file: str | None = None) -> DataFrame:
    """Edges between units of different files, counted by file pair and type.

    Edges are counted per (source file, target id) before the second join, which shrinks what a hot target sends.
    """
    places = graph.pous.select("id", "file_path")
    sources = places.select(F.col("id").alias("from_id"), F.col("file_path").alias("from_file"))
    sinks = places.select(F.col("id").alias("to_id"), F.col("file_path").alias("to_file"))
    counted = (
        graph.relationships.select("from_id", "to_id", "type")
        .join(sources, "from_id")
        .groupBy("from_file", "to_id", "type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = counted.join(sinks, "to_id").filter(F.col("from_file") != F.col("to_file"))
    if file:
        pairs = pairs.filter((F.col("from_file") == file) | (F.col("to_file") == file))
    return pairs.groupBy("from_file", "to_file", "type").agg(F.sum("n").alias("count"))


def isolated(graph: Graph) -> DataFrame:
    """Units no edge touches. The two ends are united first: an OR in the join would become a nested loop."""
    touched = graph.relationships.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return graph.pous.join(touched, "id", "left_anti").select("id", "name", "pou_type", "file_path")


def orphans(graph: Graph) -> DataFrame:
    """Variables without their unit, and edges that start at no known entity."""
    units = graph.pous.select(F.col("id").alias("pou_id"))
    variables = graph.variables.join(units, "pou_id", "left_anti").select(
        "id", "name", F.col("pou_id").alias("place"), F.lit("variable").alias("type")
    )
    nodes = node_ids(graph).select(F.col("id").alias("from_id"))
    edges = graph.relationships.join(nodes, "from_id", "left_anti").select(
        "id", F.col("type").alias("name"), F.col("file_path").alias("place"), F.lit("relationship").alias("type")
    )
    return variables.unionByName(edges)


def call_lists(graph: Graph, page_rows: int = LIST_ROWS) -> DataFrame:
    """Outgoing and incoming calls per unit; incoming ones only from known callers, with their names."""
    names = graph.pous.select("id", F.col("name").alias("other_name"), F.col("file_path").alias("other_file"))
    none = F.lit(None).cast("string")
    pous = graph.pous.select("id")
    outgoing = (
        graph.calls.select(F.col("from_id").alias("pou_id"), F.col("to_id").alias("other_id"), F.col("id").alias("edge_id"))
        .join(pous.withColumnRenamed("id", "pou_id"), "pou_id", "left_semi")
        .join(names.withColumnRenamed("id", "other_id"), "other_id", "left")
        .select("pou_id", F.coalesce("other_name", "other_id").alias("call"), none.alias("caller"), "other_file",
                F.concat(F.lit(">"), "edge_id").alias("member"))
    )
    incoming = (
        graph.calls.select(F.col("to_id").alias("pou_id"), F.col("from_id").alias("other_id"), F.col("id").alias("edge_id"))
        .join(pous.withColumnRenamed("id", "pou_id"), "pou_id", "left_semi")
        .join(names.withColumnRenamed("id", "other_id"), "other_id")
        .select("pou_id", none.alias("call"), F.col("other_name").alias("caller"), "other_file",
                F.concat(F.lit("<"), "edge_id").alias("member"))
    )
    return paged_lists(
        outgoing.unionByName(incoming), ["pou_id"],
        {
            "calls": F.when(F.col("call").isNotNull(), F.struct(F.col("call").alias("name"), F.col("other_file").alias("file"))),
            "called_by": F.when(F.col("caller").isNotNull(), F.struct(F.col("caller").alias("name"), F.col("other_file").alias("file"))),
        },
        ["member"], page_rows,
    )


def type_usages(graph: Graph) -> DataFrame:
    """Units with any edge to a type, once per type."""
    types = graph.types.select(F.col("id").alias("to_id"), F.col("name").alias("type_name"))
    units = graph.pous.select(F.col("id").alias("from_id"), "name", F.col("file_path").alias("file"))
    edges = graph.relationships.select("from_id", "to_id").distinct()
    return edges.join(types, "to_id").join(units, "from_id").select(
        F.col("to_id").alias("type_id"), "type_name", F.col("from_id").alias("pou_id"), "name", "file"
    )
