"""Markdown documents of the graph: one per unit and type, and an index.

A document is one row. Lists of a very connected unit would make such a row unbounded, so they go on in numbered
further pages (``Name.2.md`` ...); see :func:`plcatlas.operators.paging.paged_lists`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.graph import Graph
from plcatlas.operators import lookup
from plcatlas.operators.edges import type_usages
from plcatlas.operators.metrics import MERMAID_EDGES
from plcatlas.operators.paging import LIST_ROWS, paged_lists
from plcatlas.session import cut_lineage

SCHEMA_VERSION = 1
DASH, DOT = "–", "·"
INDEX_ID = "index"

# Fixed texts of the documents.
NO_VARIABLES = "_No variables._"
NO_CALLS = "_No outgoing calls._"
NO_CALLERS = "_Nothing calls this POU yet._"
NO_DEFINITION = "_No definition recorded._"
NO_USAGES = "_No usages recorded._"
NONE = "_None._"
VARIABLE_HEAD = "| Direction | Name | Type | Default | Line |\n| --- | --- | --- | --- | --- |"
FIELD_HEAD = "| Field | Type |\n| --- | --- |"
SECTIONS = (
    ("PROGRAM", "Programs"), ("FUNCTION_BLOCK", "Function Blocks"), ("FUNCTION", "Functions"), ("METHOD", "Methods"),
    ("TYPE", "Types"),
)


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(*parts: Column | str) -> Column:
    """Concatenation in which strings are literals and nulls are empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _code(value: Column) -> Column:
    return _text("`", value, "`")


def frontmatter(
    name: Column, type_: Column, file: Column, start: Column, end: Column, variables: Column, dependencies: Column,
    dependents: Column, tags: Column,
) -> Column:
    return _lines(
        "---", _text("name: ", name), _text("type: ", type_), _text("file: ", file), _text("start_line: ", start),
        _text("end_line: ", F.coalesce(end, F.lit(0))), _text("variable_count: ", variables),
        _text("dependencies_count: ", dependencies), _text("dependents_count: ", dependents), _text("tags: ", tags),
        f"schema_version: {SCHEMA_VERSION}", "---",
    )


def _tags(kind: Column, label: str) -> Column:
    return _text('["', F.lower(kind), f'", "{label}"]')


def document_names(entities: DataFrame) -> DataFrame:
    """``(id, doc)``: the file name of each entity. Of several equal names the first keeps it, the others add a key.

    The key comes from the id and not from a rank, so documents keep their names when others come or go, and a name
    borne by very many entities needs no ordering of them.
    """
    slugs = entities.select("id", "file_path", "start_line", text.slugify("name").alias("slug"))
    firsts = slugs.groupBy("slug").agg(F.min_by("id", F.struct("file_path", "start_line", "id")).alias("_first"))
    suffixed = F.concat("slug", F.lit("_"), F.substring(F.sha2("id", 256), 1, 16))
    return slugs.join(firsts, "slug").select("id", F.when(F.col("id") == F.col("_first"), F.col("slug")).otherwise(suffixed).alias("doc"))


def link(doc: Column, file: Column) -> Column:
    return F.when(file.isNull() | (file == ""), _text("[[", doc, "]]")).otherwise(_text("[[", doc, "|", file, "]]"))


def _page_path(folder: str, doc: Column, page: Column) -> Column:
    return _text(f"{folder}/", doc, F.when(page > 0, _text(".", page + 1)), ".md")


def _links(value: Column) -> Column:
    """Sorted links, one per line; :func:`_once` has made them distinct."""
    return F.array_join(F.array_sort(value), "\n")


def _once(members: DataFrame) -> DataFrame:
    """Variables as they are, and each link of a unit once, before the lists are cut into pages."""
    links = members.filter("variable is null").groupBy("id", "call", "caller").agg(F.min("member").alias("member"))
    return members.filter("variable is not null").unionByName(links, allowMissingColumns=True)


def _pou_members(graph: Graph, docs: DataFrame) -> DataFrame:
    """Everything listed on a unit's page: variables, links to callees, links from callers."""
    none = F.lit(None)
    variable = F.struct(
        F.col("direction"), F.col("name"), F.col("id"), F.col("var_type"), F.col("default_value"), F.col("start_line").alias("line")
    )
    shape = variable_type = "struct<direction:string,name:string,id:string,var_type:string,default_value:string,line:int>"
    variables = graph.variables.select(
        F.col("pou_id").alias("id"), variable.cast(variable_type).alias("variable"), none.cast("string").alias("call"),
        none.cast("string").alias("caller"), F.col("id").alias("member"),
    )
    places = graph.pous.select("id", "file_path").join(docs, "id")
    callee = places.select(F.col("id").alias("to_id"), "doc", F.col("file_path").alias("file"))
    caller = places.select(F.col("id").alias("from_id"), "doc", F.col("file_path").alias("file"))
    calls = graph.calls.select("id", "from_id", "to_id")
    outgoing = calls.join(callee, "to_id", "left").select(
        F.col("from_id").alias("id"), none.cast(shape).alias("variable"),
        link(F.coalesce("doc", text.slugify("to_id")), F.col("file")).alias("call"), none.cast("string").alias("caller"),
        F.concat(F.lit(">"), "id").alias("member"),
    )
    incoming = calls.join(caller, "from_id").select(
        F.col("to_id").alias("id"), none.cast(shape).alias("variable"), none.cast("string").alias("call"),
        link(F.col("doc"), F.col("file")).alias("caller"), F.concat(F.lit("<"), "id").alias("member"),
    )
    return variables.unionByName(outgoing).unionByName(incoming)


def _only(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    return rows if ids is None else rows.join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi")


def pou_documents(
    graph: Graph, corpus: DataFrame | None = None, page_rows: int = LIST_ROWS, only: DataFrame | None = None
) -> DataFrame:
    """``(entity_id, page, relpath, body)`` of every unit, or of those whose ids are in ``only``."""
    docs = document_names(graph.pous)
    # read for the counts and for the lists
    members = cut_lineage(_only(_pou_members(graph, docs), only))
    counts = members.groupBy("id").agg(
        F.count("variable").alias("n_variables"), F.count("call").alias("n_calls"), F.count("caller").alias("n_callers")
    )
    lists = paged_lists(
        _once(members), ["id"], {"variables": F.col("variable"), "calls": F.col("call"), "callers": F.col("caller")}, ["member"], page_rows,
        # repeated links are in these counts: at worst a key is ranked that has one page
        counts=counts.select("id", (F.col("n_variables") + F.col("n_calls") + F.col("n_callers")).alias("_n")),
    )
    rows = (
        _only(graph.pous, only).join(docs, "id")
        .join(counts, "id", "left").join(lists, "id", "left")
        .fillna(0, ["n_variables", "n_calls", "n_callers", "page"])
    )
    rows = _with_source(rows, graph, corpus, "POU")
    name, file, kind = F.col("name"), F.col("file_path"), F.col("pou_type")
    last_line = F.coalesce("end_line", "start_line")
    extends = F.when(F.col("extends").isNotNull(), _text(f" {DOT} extends ", _code(F.col("extends"))))
    implements = F.when(F.col("implements").isNotNull(), _text(f" {DOT} implements ", _code(F.to_json("implements"))))
    meta = _lines(
        _text("**Type:** ", kind, extends, implements),
        _text("**File:** ", _code(file), " (lines ", F.col("start_line"), DASH, last_line, ")"), "",
    )
    row = lambda v: _text(
        "| ", v["direction"], " | ", _code(v["name"]), " | ", _code(v["var_type"]), " | ", v["default_value"], " | ", v["line"], " |"
    )
    listed = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    variables = F.when(listed(F.col("variables")), _lines(VARIABLE_HEAD, F.array_join(F.transform("variables", row), "\n")))
    calls = F.when(listed(F.col("calls")), _lines(
        _text("Outgoing CALLS (", F.col("n_calls"), ") from ", link(F.col("doc"), file), ":"), "", _links(F.col("calls"))
    ))
    callers = F.when(listed(F.col("callers")), _lines(
        _text("Incoming CALLS (", F.col("n_callers"), "):"), "", _links(F.col("callers"))
    ))
    first = _lines(
        frontmatter(name, kind, file, F.col("start_line"), F.col("end_line"), F.col("n_variables"), F.col("n_calls"),
                    F.col("n_callers"), _tags(kind, "pou")),
        "", _text("# ", name), "", meta, "## Variables", "", F.coalesce(variables, F.lit(NO_VARIABLES)), "## Calls", "",
        F.coalesce(calls, F.lit(NO_CALLS)), "## Called by", "", F.coalesce(callers, F.lit(NO_CALLERS)), "## Source", "",
        _lines("```st", F.col("source"), "```"), "",
    )
    further = _lines(
        _text("# ", name, " (page ", F.col("page") + 1, ")"), "", "## Variables", "", F.coalesce(variables, F.lit("")), "## Calls", "",
        F.coalesce(calls, F.lit("")), "## Called by", "", F.coalesce(callers, F.lit("")), "",
    )
    return rows.select(
        F.col("id").alias("entity_id"), "page", _page_path("pous", F.col("doc"), F.col("page")).alias("relpath"),
        F.when(F.col("page") == 0, first).otherwise(further).alias("body"),
    )


def _with_source(rows: DataFrame, graph: Graph, corpus: DataFrame | None, kind: str) -> DataFrame:
    """The entity's own lines, or a note that there are none."""
    note = _text("// source not available for ", F.col("name"))
    if corpus is None:
        return rows.withColumn("source", note)
    snippets = lookup.entity_snippets(graph, corpus, context=0, kinds=(kind,)).filter("found AND source <> ''").select("id", "source")
    return rows.join(snippets, "id", "left").withColumn("source", F.coalesce("source", note))


def type_documents(
    graph: Graph, corpus: DataFrame | None = None, page_rows: int = LIST_ROWS, only: DataFrame | None = None
) -> DataFrame:
    """``(entity_id, page, relpath, body)`` of every type, or of those whose ids are in ``only``."""
    docs = document_names(graph.types)
    units = document_names(graph.pous).select(F.col("id").alias("pou_id"), F.col("doc").alias("user"))
    usages = type_usages(graph).join(units, "pou_id").select(
        F.col("type_id").alias("id"), _text("- ", link(F.col("user"), F.col("file"))).alias("usage"), F.col("pou_id").alias("member")
    )
    usages = cut_lineage(_only(usages, only))
    counts = usages.groupBy("id").agg(F.count(F.lit(1)).alias("n_usages"))
    lists = paged_lists(
        usages, ["id"], {"usages": F.col("usage")}, ["member"], page_rows, counts=counts.withColumnRenamed("n_usages", "_n")
    )
    rows = (
        _only(graph.types, only).join(docs, "id").join(counts, "id", "left").join(lists, "id", "left").fillna(0, ["n_usages", "page"])
        .withColumn("_d", text.definition("definition"))
    )
    rows = _with_source(rows, graph, corpus, "TYPE")
    name, file, kind = F.col("name"), F.col("file_path"), F.col("type_kind")
    values, fields = F.col("_d.values"), F.col("_d.fields")
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    enum = _lines(
        _text("**Enum values (", F.size(values), "):**"), "", F.array_join(F.transform(values, lambda v: _text("- `", v, "`")), "\n")
    )
    struct = _lines(
        _text("**Fields (", F.size(fields), "):**"), "", FIELD_HEAD,
        F.array_join(F.transform(fields, lambda f: _text("| ", _code(f["name"]), " | ", _code(f["type"]), " |")), "\n"),
    )
    raw = F.when(F.col("definition").isNotNull() & (F.col("definition") != ""), _lines("```", F.col("definition"), "```"))
    shown = F.when((kind == "ENUM") & filled(values), enum).when(filled(fields), struct).otherwise(F.coalesce(raw, F.lit(NO_DEFINITION)))
    usages_text = F.when(filled(F.col("usages")), F.array_join("usages", "\n"))
    last_line = F.coalesce("end_line", "start_line")
    first = _lines(
        frontmatter(name, kind, file, F.col("start_line"), F.col("end_line"), text.definition_size("definition"), F.lit(0),
                    F.col("n_usages"), _tags(kind, "type")),
        "", _text("# ", name), "",
        _lines(_text("**Kind:** ", kind), _text("**File:** ", _code(file), " (lines ", F.col("start_line"), DASH, last_line, ")"), ""),
        "## Definition", "", shown, "## Used by", "", F.coalesce(usages_text, F.lit(NO_USAGES)), "## Source", "",
        _lines("```st", F.col("source"), "```"), "",
    )
    further = _lines(
        _text("# ", name, " (page ", F.col("page") + 1, ")"), "", "## Used by", "", F.coalesce(usages_text, F.lit("")), "",
    )
    return rows.select(
        F.col("id").alias("entity_id"), "page", _page_path("types", F.col("doc"), F.col("page")).alias("relpath"),
        F.when(F.col("page") == 0, first).otherwise(further).alias("body"),
    )


def call_drawing(graph: Graph, limit: int = MERMAID_EDGES) -> DataFrame:
    """The first calls between units by name, as lines of a drawing; one row, at most ``limit`` lines."""
    names = graph.pous.select("id", "name")
    pairs = (
        graph.calls.select("id", "from_id", "to_id")
        .join(names.select(F.col("id").alias("from_id"), F.col("name").alias("from")), "from_id")
        .join(names.select(F.col("id").alias("to_id"), F.col("name").alias("to")), "to_id")
        .orderBy("from", "to", "id")
        .limit(limit)
    )
    line = _text("  ", text.mermaid_id("from"), " --> ", text.mermaid_id("to"))
    drawn = pairs.agg(F.sort_array(F.collect_list(F.struct("from", "to", "id", line.alias("line")))).alias("edges"))
    lines = F.array_join(F.transform("edges", lambda e: e["line"]), "\n")
    return drawn.select(
        F.when(F.size("edges") > 0, _lines("```mermaid", "graph LR", lines, "```"))
        .otherwise(F.lit("```mermaid\ngraph LR\n  empty[No CALLS relationships]\n```")).alias("drawing")
    )


def index_documents(graph: Graph, mermaid: bool = True, page_rows: int = LIST_ROWS) -> DataFrame:
    """The index: totals, all units by kind, all types, and a drawing of the first calls.

    One page as long as a section has at most ``page_rows`` entries, more pages beyond that.
    """
    units = graph.pous.select(F.col("pou_type").alias("section"), "id", _text("- [[", F.col("name"), "|", F.col("file_path"), "]]").alias("line"))
    types = graph.types.select(
        F.lit("TYPE").alias("section"), "id",
        _text("- [[", F.col("name"), "|", F.col("file_path"), "]] (", F.col("type_kind"), ")").alias("line"),
    )
    kinds = [k for k, _ in SECTIONS]
    entries = units.filter(F.col("section").isin(*[k for k in kinds if k != "TYPE"])).unionByName(types)
    pages = paged_lists(entries, ["section"], {"lines": F.col("line")}, ["id"], page_rows)
    listed = pages.select("page", "section", F.array_join("lines", "\n").alias("text"))
    # totals and drawing are further texts of the first page, which exists even if nothing is listed
    part = lambda df, key: df.select(F.lit(0).alias("page"), F.lit(key).alias("section"), F.col(df.columns[0]).cast("string").alias("text"))
    texts = (
        listed.unionByName(part(graph.pous.agg(F.count(F.lit(1))), "n_pous"))
        .unionByName(part(graph.types.agg(F.count(F.lit(1))), "n_types"))
    )
    if mermaid:
        texts = texts.unionByName(part(call_drawing(graph), "drawing"))
    rows = texts.groupBy("page").agg(
        *[F.max(F.when(F.col("section") == k, F.col("text"))).alias(k) for k in (*kinds, "n_pous", "n_types", "drawing")]
    )
    body = []
    for kind, title in SECTIONS:
        empty = F.when(F.col("page") == 0, F.lit(NONE)).otherwise(F.lit(""))
        body += [f"## {title}", "", F.coalesce(F.col(kind), empty)]
    front = _lines(
        "---", "type: INDEX", f"schema_version: {SCHEMA_VERSION}", _text("pou_count: ", F.col("n_pous")),
        _text("type_count: ", F.col("n_types")), "---", "", "# Code Graph Index", "",
        _text("Total: **", F.col("n_pous"), "** POUs, **", F.col("n_types"), "** types."), "",
    )
    graph_part = _lines("## Graph", "", F.col("drawing"), "") if mermaid else F.lit("")
    first = _lines(front, *body, graph_part)
    further = _lines(_text("# Code Graph Index (page ", F.col("page") + 1, ")"), "", *body, "")
    return rows.select(
        F.concat(F.lit(INDEX_ID), F.when(F.col("page") > 0, _text(":", F.col("page"))).otherwise("")).alias("entity_id"), "page",
        _text("_index", F.when(F.col("page") > 0, _text(".", F.col("page") + 1)), ".md").alias("relpath"),
        F.when(F.col("page") == 0, first).otherwise(further).alias("body"),
    )


# ---- snapshot ----


def snapshot_nodes(graph: Graph) -> DataFrame:
    """Units as nodes of a drawing."""
    shape = F.when(F.col("pou_type") == "FUNCTION_BLOCK", "functionBlock").otherwise("program")
    return graph.pous.select("id", shape.alias("type"), F.struct(F.col("name").alias("label"), F.col("pou_type").alias("type")).alias("data"))


def snapshot_edges(graph: Graph) -> DataFrame:
    named = F.concat_ws("-", "from_id", "to_id", "type")
    return graph.relationships.select(
        F.coalesce(F.nullif("id", F.lit("")), named).alias("id"), F.col("from_id").alias("source"), F.col("to_id").alias("target"),
        F.col("type").alias("label"),
    )
