"""Lookups, searches and projections over the graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.graph import Graph
from plcatlas.operators.paging import LIST_ROWS, list_sizes, paged_lists

POU_KINDS = ("POU", "FUNCTION_BLOCK", "PROGRAM", "FUNCTION", "METHOD", "CLASS")
TYPE_KINDS = ("TYPE", "STRUCT", "ENUM", "ARRAY")
NOT_FOUND = "// File not found: "


def by_keys(table: DataFrame, column: str, keys: DataFrame | str, ignore_case: bool = False) -> DataFrame:
    """Rows whose ``column`` is one of the keys: a literal is a filter, a table of keys is one semi-join."""
    if isinstance(keys, str):
        if ignore_case:
            return table.filter(F.lower(column) == keys.lower())
        return table.filter(F.col(column) == keys)
    wanted = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    value = F.lower(table[column]) if ignore_case else table[column]
    wanted_key = F.lower(F.col("_key")) if ignore_case else F.col("_key")
    return table.join(wanted, value == wanted_key, "left_semi")


def first_by_name(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per name, the first by file, line and id: ``(name, id)``; one per name and ``by`` if more columns are given."""
    return table.groupBy(*by, "name").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("id"))


def names(graph: Graph) -> DataFrame:
    return graph.pous.select("name").distinct()


def search_pous(
    graph: Graph, query: str, pou_type: str | None = None, limit: int | None = 100, **options: bool
) -> DataFrame:
    hits = graph.pous.filter(text.matches("name", query, **options))
    if pou_type:
        hits = hits.filter(F.col("pou_type") == pou_type)
    order = ["file_path", "id"] if pou_type else ["pou_type", "file_path", "id"]
    hits = hits.select("id", "name", "pou_type", "file_path", "start_line").orderBy(*order)
    return hits if not limit else hits.limit(limit)


def search_types(graph: Graph, query: str, limit: int | None = 100, **options: bool) -> DataFrame:
    hits = graph.types.filter(text.matches("name", query, **options))
    hits = hits.select("id", "name", "type_kind", "file_path", "start_line").orderBy("type_kind", "file_path", "id")
    return hits if not limit else hits.limit(limit)


def search_type_definitions(graph: Graph, term: str) -> DataFrame:
    return graph.types.filter(text.contains_text("definition", term)).select("id", "name", "type_kind", "definition")


def fields_of(graph: Graph, parents: DataFrame | str) -> DataFrame:
    return by_keys(graph.fields, "parent_type_id", parents).select(
        "id", "parent_type_id", "name", "field_type", "start_line"
    )


def search_fields(graph: Graph, query: str, limit: int | None = 50, **options: bool) -> DataFrame:
    hits = graph.fields.filter(text.matches("name", query, **options))
    hits = hits.select("id", "parent_type_id", "name", "field_type", "file_path", "start_line").orderBy("name", "id")
    return hits if not limit else hits.limit(limit)


def variables_of(graph: Graph, pous: DataFrame | str) -> DataFrame:
    return by_keys(graph.variables, "pou_id", pous).orderBy("direction", "name", "id")


def variables_by_direction(graph: Graph, direction: str) -> DataFrame:
    return graph.variables.filter(F.col("direction") == direction)


def variables_of_type(graph: Graph, var_types: DataFrame | str) -> DataFrame:
    return by_keys(graph.variables, "var_type", var_types)


def global_variables(graph: Graph, query: str | None = None) -> DataFrame:
    hits = graph.variable_lists.filter("direction = 'VAR_GLOBAL'")
    return hits.filter(text.matches("name", query)) if query else hits


def variable_lists_of(graph: Graph, files: DataFrame | str) -> DataFrame:
    return by_keys(graph.variable_lists, "file_path", files).orderBy("start_line", "id")


def diagnostics_of(graph: Graph, files: DataFrame | str) -> DataFrame:
    return by_keys(graph.diagnostics, "file_path", files).orderBy("severity", "line", "id")


def diagnostics_by_severity(graph: Graph, severity: int) -> DataFrame:
    return graph.diagnostics.filter(F.col("severity") == severity).withColumn(
        "label", text.severity_label("severity")
    )


def search(
    graph: Graph, query: str, entity_type: str | None = None, limit: int | None = 50, **options: bool
) -> DataFrame:
    """Units, types and fields by name, in one shape. Without a limit every hit is returned."""
    pous = graph.pous.filter(text.matches("name", query, **options)).select(
        F.lit(0).alias("rank"), "id", "name", F.col("pou_type").alias("type"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line"), F.col("namespace").alias("parent"), F.col("signature").alias("detail"),
    )
    types = graph.types.filter(text.matches("name", query, **options)).select(
        F.lit(1).alias("rank"), "id", "name", F.col("type_kind").alias("type"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line"), F.lit(None).cast("string").alias("parent"),
        F.col("definition").alias("detail"),
    )
    fields = graph.fields.filter(text.matches("name", query, **options)).select(
        F.lit(2).alias("rank"), "id", "name", F.lit("FIELD").alias("type"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line"), F.col("parent_type_id").alias("parent"),
        F.col("field_type").alias("detail"),
    )
    hits = pous.unionByName(types).unionByName(fields)
    if entity_type:
        hits = hits.filter(F.col("type") == entity_type)
    if not limit:
        return hits.drop("rank")
    return hits.orderBy("rank", "type", "file", "id").limit(limit).drop("rank")


def search_advanced(
    graph: Graph,
    direction: str | None = None,
    var_type: str | None = None,
    pou_type: str | None = None,
    query: str | None = None,
    file_path: str | None = None,
    page_rows: int = LIST_ROWS,
) -> DataFrame:
    """Units with those of their variables that meet the filters; only filters that were given are applied.

    Without a filter on variables a unit needs none; ``query`` is met by the name of the unit or of a variable.
    """
    pous = graph.pous
    if pou_type:
        pous = pous.filter(F.col("pou_type") == pou_type)
    if file_path:
        pous = pous.filter(text.contains_text("file_path", file_path))
    pous = pous.select("id", "name", "pou_type", "file_path", "start_line")
    variables = graph.variables.select(
        "pou_id", F.col("id").alias("var_id"), F.col("name").alias("var_name"), "direction", "var_type",
        "default_value",
    )
    if direction:
        variables = variables.filter(F.col("direction") == direction)
    if var_type:
        variables = variables.filter(text.contains_text("var_type", var_type))
    how = "inner" if direction or var_type else "left"
    rows = pous.join(variables, F.col("id") == F.col("pou_id"), how)
    if query:
        rows = rows.filter(text.contains_text("name", query) | text.contains_text("var_name", query))
    item = F.when(
        F.col("var_id").isNotNull(), F.struct("var_name", "direction", "var_type", "default_value", "var_id")
    )
    carry = ["name", "pou_type", "file_path", "start_line"]
    return paged_lists(rows, ["id"], {"variables": item}, ["var_id"], page_rows, carry)


def resolve_entity(graph: Graph, name: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
    """Exact hits of a kind, or its substring hits where there are none; units come before types."""
    kinds = []
    if entity_type is None or entity_type in POU_KINDS:
        kinds.append(_named(graph.pous, "POU", "pou_type", "signature", name))
    if entity_type is None or entity_type in TYPE_KINDS:
        kinds.append(_named(graph.types, "TYPE", "type_kind", "definition", name))
    if not kinds:
        return _named(graph.pous, "POU", "pou_type", "signature", name).limit(0).drop("rank")
    hits = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])
    # the better rank of a kind is a two-row table; joining it beats a window over all hits of the kind
    best = hits.groupBy("kind").agg(F.min("rank").alias("rank"))
    return hits.join(best, ["kind", "rank"], "left_semi").drop("rank").orderBy("kind", "type", "file", "id").limit(limit)


def _named(table: DataFrame, kind: str, type_column: str, detail: str, name: str) -> DataFrame:
    exact: Column = F.col("name") == name
    return table.filter(exact | text.contains_text("name", name)).select(
        F.lit(kind).alias("kind"), F.when(exact, 0).otherwise(1).alias("rank"), "id", "name",
        F.col(type_column).alias("type"), F.col("file_path").alias("file"), F.col("start_line").alias("line"),
        F.col(detail).alias("description"),
    )


def file_entities(
    graph: Graph, files: DataFrame | str | None = None, kinds: tuple[str, ...] = ("POU", "TYPE", "VAR_GLOBAL")
) -> DataFrame:
    """Units, types and global lists by file; all files unless some are named."""
    shape = lambda df, kind, type_column: df.select(
        F.lit(kind).alias("kind"), "id", "name", F.col(type_column).alias("type"), "file_path",
        F.col("start_line").alias("line"),
    )
    rows = (
        shape(graph.pous, "POU", "pou_type")
        .unionByName(shape(graph.types, "TYPE", "type_kind"))
        .unionByName(shape(graph.variable_lists, "VAR_GLOBAL", "direction"))
        .filter(F.col("kind").isin(*kinds))
    )
    return rows if files is None else by_keys(rows, "file_path", files).orderBy("line", "id")


def entity_snippets(
    graph: Graph, corpus: DataFrame, context: int = 5, kinds: tuple[str, ...] = ("POU", "TYPE"), page_rows: int = 1000,
    names: DataFrame | str | None = None,
) -> DataFrame:
    """Source lines ``start-context .. end+context`` of every entity, or of the named ones, kept inside the file.

    Entities meet their file as lists, so a file's text is joined and split once per list and not once per entity; texts
    of files without a wanted entity are not split. Entities of a file outside the corpus keep a line saying so.
    """
    shape = lambda df, kind, type_column: df.select(
        F.lit(kind).alias("kind"), "id", "name", F.col(type_column).alias("type"), "file_path",
        F.col("start_line").alias("line"), F.coalesce("end_line", "start_line").alias("last"),
    )
    entities = shape(graph.pous, "POU", "pou_type").unionByName(shape(graph.types, "TYPE", "type_kind"))
    entities = entities.filter(F.col("kind").isin(*kinds))
    if names is not None:
        entities = by_keys(entities, "name", names)
    lists = paged_lists(
        entities, ["file_path"], {"entities": F.struct("id", "name", "type", "line", "last")}, ["id"], page_rows
    )
    texts = corpus.select(F.col("path").alias("file_path"), "content")

    def cut(e: Column) -> Column:
        first = F.greatest(F.lit(1), e["line"] - context)
        last = F.least(F.size("lines"), e["last"] + context)
        source = F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")
        missing = F.col("lines").isNull()
        return F.struct(
            e["id"].alias("id"), e["name"].alias("name"), e["type"].alias("type"), e["line"].alias("line"),
            F.when(missing, F.concat(F.lit(NOT_FOUND), "file_path")).otherwise(source).alias("source"),
            F.when(missing, e["line"]).otherwise(first).alias("first_line"),
            F.when(missing, e["last"]).otherwise(last).alias("last_line"), (~missing).alias("found"),
        )

    found = lists.join(texts, "file_path", "left").withColumn("lines", F.split("content", "\n"))
    cuts = found.select("file_path", F.explode(F.transform("entities", cut)).alias("e"))
    return cuts.select("e.*", "file_path")


def variable_flow(graph: Graph, pous: DataFrame | str | None = None, page_rows: int = LIST_ROWS) -> DataFrame:
    """Inputs, outputs and internals (VAR, VAR_TEMP, VAR_IN_OUT) of every unit, or of the named ones.

    The counts are those of the unit and stand on each of its pages. Variables of other units than the named ones are
    left out before anything is sorted.
    """
    units = graph.pous if pous is None else by_keys(graph.pous, "name", pous)
    variables = graph.variables
    if pous is not None:
        variables = variables.join(units.select(F.col("id").alias("pou_id")), "pou_id", "left_semi")
    direction = F.col("direction")
    item = F.struct("name", "var_type", F.col("start_line").alias("line"), "id")
    inner = F.struct("name", "var_type", "direction", F.col("start_line").alias("line"), "id")
    items = {
        "inputs": F.when(direction == "VAR_INPUT", item),
        "outputs": F.when(direction == "VAR_OUTPUT", item),
        "internals": F.when(direction.isin("VAR", "VAR_TEMP", "VAR_IN_OUT"), inner),
    }
    lists = paged_lists(variables, ["pou_id"], items, ["id"], page_rows)
    sizes = list_sizes(variables, ["pou_id"], {f"_{name}": entry for name, entry in items.items()})
    joined = units.select("id", "name", "pou_type", "file_path").join(
        lists.join(sizes, "pou_id"), F.col("id") == F.col("pou_id"), "left"
    )
    size = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return joined.select(
        "id", "name", "pou_type", "file_path", F.coalesce("page", F.lit(0)).alias("page"),
        size(F.col("_inputs")).alias("input_count"), size(F.col("_outputs")).alias("output_count"),
        size(F.col("_internals")).alias("internal_count"), "inputs", "outputs", "internals",
    )


def state_machine_candidates(graph: Graph, name: str | None = None) -> DataFrame:
    units = graph.pous.filter(F.col("pou_type").isin("FUNCTION_BLOCK", "PROGRAM"))
    if name:
        units = units.filter(F.col("name") == name)
    return units.select("id", "name", "pou_type", "file_path", "start_line", "end_line")


def entity_cards(graph: Graph, names: DataFrame | str | None = None, page_rows: int = LIST_ROWS) -> DataFrame:
    """Unit or type, or the named ones, with its variables, calls and callers; long lists continue on further pages."""
    entities = file_entities(graph, kinds=("POU", "TYPE"))
    if names is not None:
        entities = by_keys(entities, "name", names)
    none = F.lit(None).cast("string")
    members = (
        graph.variables.select(
            F.col("pou_id").alias("id"), F.concat_ws(" ", "name", "direction", "var_type").alias("variable"),
            none.alias("call"), none.alias("caller"), F.col("id").alias("member"),
        )
        .unionByName(
            graph.calls.select(
                F.col("from_id").alias("id"), none.alias("variable"), F.col("to_id").alias("call"),
                none.alias("caller"), F.concat(F.lit(">"), "id").alias("member"),
            )
        )
        .unionByName(
            graph.calls.select(
                F.col("to_id").alias("id"), none.alias("variable"), none.alias("call"),
                F.col("from_id").alias("caller"), F.concat(F.lit("<"), "id").alias("member"),
            )
        )
    )
    if names is not None:
        members = members.join(entities.select("id"), "id", "left_semi")
    lists = paged_lists(
        members, ["id"],
        {"variables": F.col("variable"), "calls": F.col("call"), "called_by": F.col("caller")},
        ["member"], page_rows,
    )
    empty = F.array().cast("array<string>")
    return entities.join(lists, "id", "left").select(
        "id", "name", "type", "file_path", "line", F.coalesce("page", F.lit(0)).alias("page"),
        *[F.coalesce(c, empty).alias(c) for c in ("variables", "calls", "called_by")],
    )
