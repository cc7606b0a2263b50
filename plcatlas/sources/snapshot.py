"""Symbol snapshots: JSON documents with diagnostics, nested symbols and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.schemas import SNAPSHOT

# Kinds of the snapshot and the entity types they stand for.
KINDS = {
    "program": "PROGRAM", "function_block": "FUNCTION_BLOCK", "function": "FUNCTION", "method": "METHOD",
    "property": "PROPERTY", "interface": "INTERFACE", "type": "TYPE", "struct": "TYPE", "enum": "ENUM",
    "enum_value": "ENUM_MEMBER", "variable": "VARIABLE", "parameter": "VARIABLE",
}
SEVERITY_CODES = {"error": 1, "warning": 2, "info": 3, "hint": 4}


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per snapshot file."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select("snapshot.*")


def symbols(snapshots: DataFrame) -> DataFrame:
    """All symbols, children after their parents' level: ``(id, name, kind, file_path, line, column, end_line, parent)``.

    Positions count from 0 in a snapshot and from 1 here.
    """
    top = snapshots.select(F.explode("symbols").alias("s"))
    place = lambda c: [
        (F.col(f"{c}.range.start.line") + 1).alias("line"), (F.col(f"{c}.range.start.col") + 1).alias("column"),
        (F.col(f"{c}.range.end.line") + 1).alias("end_line"),
    ]
    columns = lambda c: [F.col(f"{c}.{n}").alias(n) for n in ("id", "name", "kind", "file_path")]
    parents = top.select(*columns("s"), *place("s"), F.lit(None).cast("string").alias("parent"))
    children = top.select(F.col("s.name").alias("parent"), F.explode("s.children").alias("c"))
    return parents.unionByName(children.select(*columns("c"), *place("c"), text.clean_name("parent").alias("parent")))


def entities(snapshots: DataFrame) -> DataFrame:
    """Symbols as entities: ``(id, name, type, file, line, column, end_line, parent)``; symbols of no known type drop out."""
    rows = symbols(snapshots)
    name = text.clean_name("name")
    type_ = F.coalesce(_lookup(KINDS, F.col("kind")), text.infer_type("name"))
    path = F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), name)).otherwise(name)
    return rows.select(
        F.concat_ws(":", "file_path", path).alias("id"), name.alias("name"), type_.alias("type"), F.col("file_path").alias("file"),
        "line", "column", "end_line", "parent",
    ).filter("type IS NOT NULL")


def tables(found: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Entities as units and types; variables go to neither."""
    child = F.when(F.col("parent").isNotNull(), F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))
    now = F.lit(now_ms).cast("bigint")
    is_type = F.col("type").isin("TYPE", "ENUM")
    pous = found.filter(~is_type & (F.col("type") != "VARIABLE")).select(
        F.concat_ws(":", F.lit("st"), "file", child).alias("id"), "name", F.col("type").alias("pou_type"), F.col("file").alias("file_path"),
        F.col("line").alias("start_line"), "end_line", F.col("parent").alias("namespace"), now.alias("created_at"), now.alias("updated_at"),
    )
    types = found.filter(is_type).select(
        F.concat_ws(":", F.lit("st:type"), "file", "name").alias("id"), "name", F.col("type").alias("type_kind"),
        F.col("file").alias("file_path"), F.col("line").alias("start_line"), "end_line", now.alias("created_at"),
    )
    return pous, types


def diagnostics(snapshots: DataFrame) -> DataFrame:
    """Diagnostics with positions from 0, ready for ``store.diagnostic_rows``."""
    return snapshots.select(F.explode("diagnostics").alias("d")).select(
        F.col("d.path").alias("file_path"), "d.line", F.col("d.col").alias("column"), _lookup(SEVERITY_CODES, F.col("d.severity")).alias("severity"),
        "d.code", "d.message", F.lit("snapshot").alias("source"),
    )


def listed_types(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.explode("types").alias("t")).select("t.name", "t.kind", "t.file_path")
