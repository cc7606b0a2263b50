"""From names to edges: references between units and types, and their validation.

Names are resolved when all declarations are known, so the order in which files are read does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.functions.standard import is_elementary
from plcatlas.operators import extract
from plcatlas.operators.lookup import first_by_name
from plcatlas.schemas import NAME_OWNERS, NAME_USERS, REFERENCES, RELATIONSHIPS, conform

CALL_CONTEXT = "regex_fallback"  # fixed value
INSTANCE_CONTEXT = "instance_call"

# ARRAY[..] OF, POINTER TO, REFERENCE TO, REF_TO, and a length or range behind the name
_PREFIX = r"(?i)^(?:\s*(?:ARRAY\s*\[[^\]]*\]\s*OF|POINTER\s+TO|REFERENCE\s+TO|REF_TO)\s+)+"
_TYPE_WORD = r"^\s*([A-Za-z_]\w*(?:\.\w+)*)"


def base_type(var_type: Column | str) -> Column:
    """The name inside ``ARRAY[0..3] OF X``, ``POINTER TO X``, ``X(1..5)``."""
    value = F.col(var_type) if isinstance(var_type, str) else var_type
    return F.nullif(F.regexp_extract(F.regexp_replace(value, _PREFIX, ""), _TYPE_WORD, 1), F.lit(""))


def _reference(rows: DataFrame, id_: Column, target: Column, type_: str, line: Column, context: Column) -> DataFrame:
    return rows.select(
        id_.alias("id"), F.col("pou_id").alias("from_id"), target.alias("target_name"), F.lit(type_).alias("type"),
        F.col("path").alias("file_path"), line.alias("line"), context.alias("context"),
    )


def references(
    sites: DataFrame, pous: DataFrame, variables: DataFrame, resolve_instances: bool = False
) -> DataFrame:
    """Every use of a name: calls, base units, interfaces, variable types. Nothing is looked up yet."""
    no_line, no_context = F.lit(None).cast("int"), F.lit(None).cast("string")
    join = lambda *parts: F.concat_ws(":", *parts)
    scope = F.concat_ws(".", "parent", "scope")
    calls = _reference(
        sites, join(F.lit("st:rel:call"), "path", scope, "callee", "line"), F.col("callee"), "CALLS", F.col("line"),
        F.lit(CALL_CONTEXT),
    )
    heads = pous.withColumn("pou_id", F.col("id")).withColumn("path", F.col("file_path"))
    # an interface may extend several others
    bases = heads.withColumn("base", F.explode(F.split("extends", r"\s*,\s*")))
    extends = _reference(
        bases, join(F.lit("st:rel:extends"), "path", "name", "base"), F.col("base"), "EXTENDS", no_line, no_context,
    )
    interfaces = heads.withColumn("interface", F.explode("implements"))
    implements = _reference(
        interfaces, join(F.lit("st:rel:implements"), "path", "name", "interface"), F.col("interface"), "IMPLEMENTS",
        no_line, no_context,
    )
    typed = variables.withColumn("path", F.col("file_path")).withColumn("_base", base_type("var_type")).filter(
        F.col("_base").isNotNull() & ~is_elementary("_base")
    )
    uses = _reference(
        typed, join(F.lit("st:rel:reference"), F.col("id")), F.col("_base"), "REFERENCES", F.col("start_line"), no_context
    )
    rows = calls.unionByName(extends).unionByName(implements).unionByName(uses)
    if resolve_instances:
        rows = rows.unionByName(_instance_calls(sites, pous, variables))
    return conform(rows, REFERENCES)


def _instance_calls(sites: DataFrame, pous: DataFrame, variables: DataFrame) -> DataFrame:
    """Calls through a variable of the unit, or of the unit around it, as calls of the variable's type."""
    own = sites.withColumn("owner", F.col("pou_id"))
    outer = sites.filter("parent IS NOT NULL").withColumn(
        "owner", extract.pou_id(F.col("path"), F.col("parent"), F.lit(None).cast("string"))
    )
    instances = variables.select(
        F.col("pou_id").alias("owner"), F.col("name").alias("callee"), base_type("var_type").alias("target")
    )
    found = own.unionByName(outer).join(instances, ["owner", "callee"]).distinct()
    scope = F.concat_ws(".", "parent", "scope")
    return _reference(
        found, F.concat_ws(":", F.lit("st:rel:call"), "path", scope, "target", "line", "callee"), F.col("target"), "CALLS",
        F.col("line"), F.lit(INSTANCE_CONTEXT),
    )


def name_owners(pous: DataFrame, types: DataFrame) -> DataFrame:
    """Every bearer of a name: when the first one goes, the next is known without a look at the declarations."""
    rows = lambda df, is_type: df.select(
        F.col("name").alias("target_name"), F.lit(is_type).alias("is_type"), "id", "file_path", "start_line"
    )
    return conform(rows(pous, False).unionByName(rows(types, True)), NAME_OWNERS)


def name_users(refs: DataFrame) -> DataFrame:
    """Name -> files that refer to it, declared or not."""
    return conform(refs.select("target_name", "file_path").distinct(), NAME_USERS)


def owner_table(owners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``name_table`` of the bearers of names."""
    rows = owners.withColumnRenamed("target_name", "name")
    return name_table(rows.filter("NOT is_type"), rows.filter("is_type"), by)


def name_table(pous: DataFrame, types: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Name -> first unit and first type of that name: ``(target_name, pou_id, type_id)``.

    Here and below, ``by`` names whole-number columns that tables are told apart by: rows that differ in them never meet.
    """
    unit = first_by_name(pous, by).select(*by, "name", F.col("id").alias("pou_id"))
    type_ = first_by_name(types, by).select(*by, "name", F.col("id").alias("type_id"))
    return unit.join(type_, [*by, "name"], "full").withColumnRenamed("name", "target_name")


def _edge_rows(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return conform(rows, ", ".join([RELATIONSHIPS, *(f"{c} BIGINT" for c in by)]))


def resolve(refs: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges of the references whose name is known; calls reach units only, and no unit calls itself."""
    target = F.when(F.col("type") == "CALLS", F.col("pou_id")).otherwise(F.coalesce("pou_id", "type_id"))
    rows = refs.join(names, [*by, "target_name"]).withColumn("to_id", target).filter("to_id IS NOT NULL")
    rows = rows.filter((F.col("type") != "CALLS") | (F.col("from_id") != F.col("to_id")))
    context = F.when(F.col("context").isNotNull(), F.create_map(F.lit("context"), "context"))
    edges = rows.select(*by, "id", "from_id", "to_id", "type", "file_path", "line", context.alias("metadata"))
    return _edge_rows(edges, by)


def unresolved(refs: DataFrame, names: DataFrame) -> DataFrame:
    return refs.join(names, "target_name", "left_anti")


def contains_edges(pous: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From a unit to its members in the same file."""
    parents = pous.filter("namespace IS NULL").select(*by, "file_path", F.col("name").alias("namespace"), F.col("id").alias("from_id"))
    members = pous.filter("namespace IS NOT NULL").select(*by, "file_path", "namespace", F.col("id").alias("to_id"), "name")
    rows = members.join(parents, [*by, "file_path", "namespace"]).select(
        *by,
        F.concat(F.lit("st:rel:"), "file_path", F.lit(":"), "namespace", F.lit("->"), "file_path", F.lit(":"), "namespace",
                 F.lit("."), "name").alias("id"),
        "from_id", "to_id", F.lit("CONTAINS").alias("type"), "file_path",
    )
    return _edge_rows(rows, by)


def uses_edges(pous: DataFrame, types: DataFrame, edges: DataFrame, uses: str = "declared", by: Sequence[str] = ()) -> DataFrame:
    """From function blocks and programs to types.

    ``declared``: types that a variable of the unit is declared with, wherever they are. ``file``: all types of the
    unit's file, used or not; that is every pair of the two within a file, so it is only for corpora of small files.
    """
    users = pous.filter(F.col("pou_type").isin("FUNCTION_BLOCK", "PROGRAM"))
    if uses == "declared":
        pairs = (
            edges.filter("type = 'REFERENCES'")
            .select(*by, "from_id", "to_id", "file_path")
            .join(types.select(*by, F.col("id").alias("to_id"), F.col("name").alias("target")), [*by, "to_id"])
            .join(users.select(*by, F.col("id").alias("from_id"), "name"), [*by, "from_id"])
            .distinct()
        )
    elif uses == "file":
        kinds = types.select(*by, "file_path", F.col("id").alias("to_id"), F.col("name").alias("target"))
        pairs = users.select(*by, "file_path", F.col("id").alias("from_id"), "name").join(kinds, [*by, "file_path"])
    else:
        raise ValueError(f"unknown uses mode: {uses}")
    rows = pairs.select(
        *by, F.concat(F.lit("st:rel:"), "from_id", F.lit("->USES->"), "to_id").alias("id"), "from_id", "to_id",
        F.lit("USES").alias("type"), "file_path",
    )
    return _edge_rows(rows, by)


def unique_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per edge id. Equal ids have equal ends, so any of them will do."""
    return edges.dropDuplicates([*by, "id"])


# ---- validation ----


def validate(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph without dangling rows, and those rows as ``(kind, id, reason)``.

    A variable needs its unit, a field its type, an edge both ends among units and types.
    """
    units = graph.pous.select(F.col("id").alias("pou_id"))
    types = graph.types.select(F.col("id").alias("parent_type_id"))
    nodes = graph.pous.select("id").unionByName(graph.types.select("id"))
    start, end = nodes.withColumnRenamed("id", "from_id"), nodes.withColumnRenamed("id", "to_id")
    rejected = lambda df, kind, reason: df.select(
        F.lit(kind).alias("kind"), "id", F.lit(reason).alias("reason")
    )
    rel = graph.relationships
    rejects = (
        rejected(graph.variables.join(units, "pou_id", "left_anti"), "variable", "unknown unit")
        .unionByName(rejected(graph.fields.join(types, "parent_type_id", "left_anti"), "field", "unknown type"))
        .unionByName(rejected(rel.join(start, "from_id", "left_anti"), "relationship", "unknown source"))
        .unionByName(rejected(
            rel.join(start, "from_id", "left_semi").join(end, "to_id", "left_anti"), "relationship", "unknown target"
        ))
    )
    valid = graph.with_tables(
        variables=graph.variables.join(units, "pou_id", "left_semi"),
        fields=graph.fields.join(types, "parent_type_id", "left_semi"),
        relationships=rel.join(start, "from_id", "left_semi").join(end, "to_id", "left_semi"),
    )
    return valid, rejects


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("count"))
