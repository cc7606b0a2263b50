"""The code graph: one DataFrame per table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plcatlas import schemas

TABLE_SCHEMAS = {
    "pous": schemas.POUS,
    "variables": schemas.VARIABLES,
    "variable_lists": schemas.VARIABLE_LISTS,
    "types": schemas.TYPES,
    "fields": schemas.FIELDS,
    "relationships": schemas.RELATIONSHIPS,
    "files": schemas.FILES,
    "diagnostics": schemas.DIAGNOSTICS,
    "references": schemas.REFERENCES,
}

Source = DataFrame | Callable[[], DataFrame]


class Graph:
    """Tables of the code graph as attributes (``graph.pous`` ...).

    A table may be given as a function; it is called when the table is first used, so a query opens no table it does
    not read. Tables not given are empty, columns not given are null.
    """

    pous: DataFrame
    variables: DataFrame
    variable_lists: DataFrame
    types: DataFrame
    fields: DataFrame
    relationships: DataFrame
    files: DataFrame
    diagnostics: DataFrame
    references: DataFrame

    def __init__(self, spark: SparkSession, **sources: Source) -> None:
        unknown = set(sources) - set(TABLE_SCHEMAS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self.spark = spark
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_SCHEMAS:
            raise AttributeError(name)
        source = self._sources.get(name)
        if source is None:
            table = self.spark.createDataFrame([], TABLE_SCHEMAS[name])
        else:
            table = schemas.conform(source if isinstance(source, DataFrame) else source(), TABLE_SCHEMAS[name])
        setattr(self, name, table)
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_SCHEMAS}

    def with_tables(self, **sources: Source) -> "Graph":
        return Graph(self.spark, **{**self._sources, **sources})

    @property
    def calls(self) -> DataFrame:
        return self.relationships.filter("type = 'CALLS'")
