"""Table schemas of the code graph and of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = "path STRING, content STRING"

POUS = (
    "id STRING, name STRING, pou_type STRING, file_path STRING, start_line INT, end_line INT, namespace STRING, "
    "extends STRING, implements ARRAY<STRING>, signature STRING, created_at BIGINT, updated_at BIGINT"
)
VARIABLES = (
    "id STRING, pou_id STRING, name STRING, direction STRING, var_type STRING, default_value STRING, "
    "start_line INT, end_line INT, file_path STRING"
)
VARIABLE_LISTS = "id STRING, file_path STRING, name STRING, direction STRING, start_line INT, end_line INT"
TYPES = (
    "id STRING, name STRING, type_kind STRING, file_path STRING, start_line INT, end_line INT, "
    "definition STRING, created_at BIGINT"
)
FIELDS = (
    "id STRING, parent_type_id STRING, name STRING, field_type STRING, default_value STRING, "
    "start_line INT, end_line INT, file_path STRING"
)
RELATIONSHIPS = (
    "id STRING, from_id STRING, to_id STRING, type STRING, file_path STRING, line INT, metadata MAP<STRING,STRING>"
)
FILES = "path STRING, hash STRING, last_indexed BIGINT, pou_count BIGINT, var_count BIGINT"
DIAGNOSTICS = (
    "id STRING, file_path STRING, line INT, `column` INT, severity INT, code STRING, message STRING, "
    "source STRING, created_at BIGINT"
)

# Every use of a name that becomes an edge once the name is known (calls, base units, interfaces, variable types).
REFERENCES = (
    "id STRING, from_id STRING, target_name STRING, type STRING, file_path STRING, line INT, context STRING"
)

# Two tables besides the graph's: who bears a name, and which files refer to it.
NAME_OWNERS = "target_name STRING, is_type BOOLEAN, id STRING, file_path STRING, start_line INT"
NAME_USERS = "target_name STRING, file_path STRING"

DEFINITION = "kind STRING, values ARRAY<STRING>, fields ARRAY<STRUCT<name: STRING, type: STRING>>"

EDGE_TYPES = ("CONTAINS", "USES", "CALLS", "EXTENDS", "IMPLEMENTS", "REFERENCES")

_RANGE = "STRUCT<start: STRUCT<line: INT, col: INT>, `end`: STRUCT<line: INT, col: INT>>"
SNAPSHOT = (
    "snapshot STRUCT<"
    "diagnostics: ARRAY<STRUCT<code: STRING, col: INT, line: INT, message: STRING, path: STRING, severity: STRING>>, "
    "metadata: STRUCT<edge_count: INT, entity_count: INT, export_time: STRING, project_path: STRING>, "
    f"symbols: ARRAY<STRUCT<id: STRING, name: STRING, kind: STRING, file_path: STRING, range: {_RANGE}, "
    f"children: ARRAY<STRUCT<id: STRING, name: STRING, kind: STRING, file_path: STRING, range: {_RANGE}>>>>, "
    "types: ARRAY<STRUCT<file_path: STRING, kind: STRING, name: STRING>>>"
)

EVENTS = (
    "id BIGINT, ts TIMESTAMP, kind STRING, callId STRING, tool STRING, argsPreview STRING, durationMs BIGINT, "
    "ok BOOLEAN, error STRING, workspace STRING, file STRING, `index` INT, total INT, current INT, stage STRING, "
    "totalFiles INT, indexedFiles INT, skippedFiles INT, entities INT, edges INT, totalEntities INT, "
    "totalEdges INT, totalTimeMs BIGINT, duration BIGINT, line INT, severity STRING, message STRING, pous INT, "
    "variables INT, types INT, relationships INT, files INT, dbBytes BIGINT, dropped INT, capacity INT"
)


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project ``df`` onto a table schema; columns it lacks become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_of(ddl).fields
        ]
    )
