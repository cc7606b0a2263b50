"""Registered queries of the corpus job: extraction, change detection, validation.

The corpus is the one the graph views describe, so what has to be found in the texts is known from the views.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.operators import extract, lookup, resolve
from plcatlas.plans import index_job
from plcatlas.plans.registry import Registry
from plcatlas.session import cut_lineage
from plcatlas.sources import corpus as sources
from plcatlas.sources import fixtures
from plcatlas.sources import store as tables

registry = Registry()
OPTIONS = index_job.Options(now_ms=1700000000000)
ALL = ("pous", "variables", "relationships")


def corpus(spark, sf):
    """The corpus view, spread over tasks as a folder of files would be."""
    return fixtures.spread(spark, sf, fixtures.view(spark, sf, "corpus"))


def stored_corpus(spark, sf):
    """The corpus view for jobs that read it more than once: as a folder of files would be, it is written and not joined anew at every reading."""
    return fixtures.spread(spark, sf, cut_lineage(fixtures.view(spark, sf, "corpus").select("path", "content")))


def corpus_query(name, operator, sql, *views, source=corpus):
    registry.define(name, lambda spark, sf: operator(source(spark, sf)), fixtures.oracle(sql, *views) if sql else None)


def facts_query(name, operator, sql, *views):
    registry.define(name, lambda spark, sf: operator(extract.extract(corpus(spark, sf), fixtures.file_tasks(spark, sf))), fixtures.oracle(sql, *views))


# Lines of a corpus text in SQL: line 1 is a comment, line 2 the header, then three per variable, then the calls.
_PLACES = """
places AS (SELECT p.id, p.name, concat('src/p', substr(p.id, 5), '.st') AS path, coalesce(v.n, 0) AS vars,
 coalesce(c.n, 0) AS calls, e.base FROM pous p
 LEFT JOIN (SELECT pou_id, count(*) AS n FROM variables GROUP BY pou_id) v ON v.pou_id = p.id
 LEFT JOIN (SELECT from_id, count(*) AS n FROM relationships WHERE type = 'CALLS' GROUP BY from_id) c ON c.from_id = p.id
 LEFT JOIN (SELECT from_id, substr(min(to_id), 5) AS base FROM relationships WHERE type = 'EXTENDS' GROUP BY from_id) e
  ON e.from_id = p.id),
units AS (SELECT concat('st:', path, ':', name) AS id, name, path AS file_path, CAST(2 AS INT) AS start_line,
 CAST(3 + 3 * vars + calls AS INT) AS end_line, CASE WHEN base IS NOT NULL THEN concat('FB_', base) END AS extends, vars FROM places),
declared AS (SELECT concat('st:', l.path, ':', l.name) AS pou_id, v.name, v.direction, v.var_type, l.path AS file_path,
 CAST(1 + 3 * row_number() OVER (PARTITION BY v.pou_id ORDER BY v.name) AS INT) AS start_line
 FROM variables v JOIN places l ON l.id = v.pou_id),
sites AS (SELECT l.path, concat('st:', l.path, ':', l.name) AS pou_id, concat('FB_', substr(r.to_id, 5)) AS callee,
 CAST(2 + 3 * l.vars + row_number() OVER (PARTITION BY r.from_id ORDER BY r.to_id) AS INT) AS line
 FROM relationships r JOIN places l ON l.id = r.from_id WHERE r.type = 'CALLS'),
first AS (SELECT name, arg_min(id, file_path) AS id FROM units GROUP BY name),
edges AS (SELECT 'CALLS' AS type, s.pou_id AS from_id, f.id AS to_id, s.line FROM sites s JOIN first f ON f.name = s.callee
  WHERE s.pou_id <> f.id
 UNION ALL SELECT 'EXTENDS', u.id, f.id, CAST(NULL AS INT) FROM units u JOIN first f ON f.name = u.extends
 UNION ALL SELECT 'REFERENCES', d.pou_id, f.id, d.start_line FROM declared d JOIN first f ON f.name = d.var_type)"""


facts_query("pou_declarations", lambda f: extract.units(f).select("id", "name", "file_path", "start_line", "end_line", "extends"),
            f"WITH {_PLACES} SELECT id, name, file_path, start_line, end_line, extends FROM units", *ALL)
facts_query("var_declarations", lambda f: extract.variables(f).select(
    "pou_id", "name", "direction", "var_type", "default_value", "start_line", "file_path"), f"""WITH {_PLACES}
SELECT pou_id, name, direction, var_type, '0' AS default_value, start_line, file_path FROM declared""", *ALL)
facts_query("call_sites", lambda f: extract.call_sites(f).select("path", "line", "pou_id", "callee"),
            f"WITH {_PLACES} SELECT path, line, pou_id, callee FROM sites", *ALL)
facts_query("header_clauses", lambda f: extract.clauses(f).select("path", "name", "extends"),
            f"WITH {_PLACES} SELECT file_path AS path, name, extends FROM units WHERE extends IS NOT NULL", *ALL)
corpus_query("source_comments", extract.comments, f"""WITH {_PLACES}
SELECT path, CAST(1 AS INT) AS line, concat('unit ', name) AS text FROM places
UNION ALL SELECT file_path, start_line, name FROM declared UNION ALL SELECT path, line, 'call' FROM sites""", *ALL)
corpus_query("comment_density", lambda c: extract.comment_density(c).select("path", "lines", "comments"), f"""
WITH {_PLACES} SELECT path, CAST(4 + 3 * vars + calls AS INT) AS lines, CAST(1 + vars + calls AS INT) AS comments FROM places""", *ALL)
corpus_query("attributed_calls", lambda c: _attributed(extract.extract(c)),
             f"WITH {_PLACES} SELECT path, line, callee, pou_id FROM sites", *ALL)


def _written(facts):
    """The facts of units and calls, written once for the tables that are read off them."""
    columns = ("path", "line", "part", "unit_kind", "unit_name", "end_kind", "scope", "parent", "pou_id", "heads", "calls")
    return cut_lineage(facts.filter("unit_kind IS NOT NULL OR end_kind IS NOT NULL OR heads IS NOT NULL OR size(calls) > 0").select(*columns))


def _attributed(facts):
    facts = _written(facts)
    sites = extract.call_sites(facts).select("path", "line", "callee")
    return extract.attribute_callers(sites, extract.units(facts))


corpus_query("index_edges", lambda c: index_job.build(c, OPTIONS).graph.relationships
             .select("type", "from_id", "to_id", "line"), f"WITH {_PLACES} SELECT type, from_id, to_id, line FROM edges", *ALL)
corpus_query("index_files", lambda c: index_job.build(c, OPTIONS).graph.files, f"""WITH {_PLACES}
SELECT c.path, sha256(c.content) AS hash, 1700000000000 AS last_indexed, CAST(1 AS BIGINT) AS pou_count, l.vars AS var_count
FROM corpus c JOIN places l ON l.path = c.path""", "corpus", source=stored_corpus)
corpus_query("extraction_coverage", lambda c: index_job.coverage_summary(index_job.coverage(extract.extract(c), c)), """
SELECT count(*) AS files, count(*) AS parsed, CAST(0 AS BIGINT) AS failed, CAST(100 AS DOUBLE) AS percent FROM pous""", "pous", source=stored_corpus)


def _stats(c):
    graph = index_job.build(c, OPTIONS).graph
    return index_job.index_stats(graph, c.select("path"), c.select("path"))


corpus_query("index_stats", _stats, f"""WITH {_PLACES}
SELECT p.n AS total_files, p.n AS indexed_files, CAST(0 AS BIGINT) AS skipped_files, p.n AS total_entities, e.n AS total_edges
FROM (SELECT count(*) AS n FROM units) p, (SELECT count(*) AS n FROM edges) e""", *ALL, source=stored_corpus)
corpus_query("entity_snippets", lambda c: _snippets(c), f"""WITH {_PLACES}
SELECT u.id, u.name, 'FUNCTION_BLOCK' AS type, CAST(2 AS INT) AS line, u.file_path, CAST(1 AS INT) AS first_line,
 CAST(u.end_line + 1 AS INT) AS last_line, md5(c.content) AS source_hash FROM units u JOIN corpus c ON c.path = u.file_path""",
             "corpus", source=stored_corpus)


# units that others call, by their names, and a twin of each in a file that is not there
corpus_query("entity_snippets_of_called", lambda c: _called_snippets(c), f"""WITH {_PLACES},
called AS (SELECT * FROM units WHERE name IN (SELECT callee FROM sites))
SELECT u.id, CAST(1 AS INT) AS first_line, CAST(u.end_line + 1 AS INT) AS last_line, TRUE AS found, md5(c.content) AS source_hash
FROM called u JOIN corpus c ON c.path = u.file_path
UNION ALL SELECT concat('gone:', id), start_line, end_line, FALSE, NULL FROM called""", *ALL, "corpus", source=stored_corpus)


def _called_snippets(c):
    from plcatlas.graph import Graph

    facts = _written(extract.extract(c))
    units = extract.units(facts)
    twins = units.withColumns({"id": F.concat(F.lit("gone:"), "id"), "file_path": F.concat(F.lit("gone/"), "file_path")})
    graph = Graph(c.sparkSession, pous=units.unionByName(twins))
    rows = lookup.entity_snippets(graph, c, context=5, names=extract.call_sites(facts).select("callee"))
    return rows.select("id", "first_line", "last_line", "found", F.when(F.col("found"), F.md5("source")).alias("source_hash"))


def _snippets(c):
    from plcatlas.graph import Graph

    graph = Graph(c.sparkSession, pous=extract.units(extract.extract(c)))
    return lookup.entity_snippets(graph, c, context=5).withColumn("source_hash", F.md5("source")).drop("source", "found")


# ---- states: branches of a CASE block over the variables of a unit ----
_CASES = """
cases AS (SELECT p_partkey AS k, concat('src/s', p_partkey, '.st') AS path,
 concat('PROGRAM PRG_', p_partkey, chr(10), 'CASE step OF', chr(10), '  Idle: step := Run_', p_size, ';', chr(10),
  '  Run_', p_size, ', 7:', chr(10), '    IF x THEN step := Idle; END_IF', chr(10), 'END_CASE', chr(10), 'END_PROGRAM') AS content FROM part)"""


def _case_facts(spark, sf):
    parts = fixtures.dealt_parts(spark, sf)
    line = F.lit("\n")
    size = F.col("p_size").cast("string")
    content = F.concat(
        F.lit("PROGRAM PRG_"), F.col("p_partkey").cast("string"), line, F.lit("CASE step OF"), line, F.lit("  Idle: step := Run_"),
        size, F.lit(";"), line, F.lit("  Run_"), size, F.lit(", 7:"), line, F.lit("    IF x THEN step := Idle; END_IF"), line,
        F.lit("END_CASE"), line, F.lit("END_PROGRAM"),
    )
    texts = parts.select(F.concat(F.lit("src/s"), "p_partkey", F.lit(".st")).alias("path"), content.alias("content"))
    return extract.extract(texts, fixtures.file_tasks(spark, sf))


registry.define("states", lambda spark, sf: extract.states(_case_facts(spark, sf))[0].select("path", "selector", "state", "line"), """
SELECT concat('src/s', p_partkey, '.st') AS path, 'step' AS selector, s.state, s.line FROM part,
 LATERAL (SELECT 'Idle' AS state, CAST(3 AS INT) AS line UNION ALL SELECT concat('Run_', p_size), 4 UNION ALL SELECT '7', 4) s""")
registry.define("state_transitions", lambda spark, sf: extract.states(_case_facts(spark, sf))[1].select(
    "path", "selector", "from_state", "to_state", "line"), """
SELECT concat('src/s', p_partkey, '.st') AS path, 'step' AS selector, s.from_state, s.to_state, s.line FROM part,
 LATERAL (SELECT 'Idle' AS from_state, concat('Run_', p_size) AS to_state, CAST(3 AS INT) AS line
  UNION ALL SELECT concat('Run_', p_size), 'Idle', 5 UNION ALL SELECT '7', 'Idle', 5) s""")
registry.define("state_counts", lambda spark, sf: extract.state_counts(*extract.states(_case_facts(spark, sf))), """
SELECT concat('st:src/s', p_partkey, '.st:PRG_', p_partkey) AS pou_id, CAST(3 AS BIGINT) AS total_states,
 CAST(3 AS BIGINT) AS total_transitions FROM part""")

# ---- change detection and validation on the graph views ----


def _registry(files):
    """An older file registry: some files unknown, some with another hash."""
    return files.filter("pou_count % 7 <> 0").withColumn("hash", F.when(F.col("pou_count") % 5 == 0, "x").otherwise(F.col("hash")))


def graph_query(name, operator, sql, *views):
    registry.define(name, lambda spark, sf: operator(fixtures.graph(spark, sf)), fixtures.oracle(sql, *views))


graph_query("changed_files", lambda g: sources.changed(g.files.select("path", "hash"), _registry(g.files)),
            "SELECT path, hash FROM files WHERE pou_count % 7 = 0 OR pou_count % 5 = 0", "files")
graph_query("skipped_files", lambda g: g.files.select("path").join(
    sources.changed(g.files.select("path", "hash"), _registry(g.files)), "path", "left_anti"),
            "SELECT path FROM files WHERE pou_count % 7 <> 0 AND pou_count % 5 <> 0", "files")
graph_query("gone_files", lambda g: sources.stale(g.files, _registry(g.files)).select("path"),
            "SELECT path FROM files WHERE pou_count % 7 = 0", "files")
graph_query("removal_counts", lambda g: tables.removal_counts(g, sources.stale(g.files, _registry(g.files))), """
SELECT 'pous' AS table_name, count(*) AS count FROM pous WHERE file_path IN (SELECT path FROM files WHERE pou_count % 7 = 0)
UNION ALL SELECT 'types', count(*) FROM types WHERE file_path IN (SELECT path FROM files WHERE pou_count % 7 = 0)
UNION ALL SELECT 'fields', count(*) FROM fields WHERE file_path IN (SELECT path FROM files WHERE pou_count % 7 = 0)
UNION ALL SELECT 'variable_lists', count(*) FROM variable_lists WHERE file_path IN (SELECT path FROM files WHERE pou_count % 7 = 0)
UNION ALL SELECT 'files', count(*) FROM files WHERE pou_count % 7 = 0
UNION ALL SELECT 'variables', 0 UNION ALL SELECT 'relationships', 0""", "files", "types", "fields", "variable_lists")
graph_query("file_registry", lambda g: tables.upsert_files(_registry(g.files), g.files.filter("pou_count % 2 = 0").withColumn(
    "last_indexed", F.col("last_indexed") + 1)).select(
        "path", "hash", text.iso_time("last_indexed").alias("last_indexed"), "pou_count"), """
SELECT path, CASE WHEN pou_count % 2 = 0 THEN hash WHEN pou_count % 5 = 0 THEN 'x' ELSE hash END AS hash,
 strftime(make_timestamp((last_indexed + CASE WHEN pou_count % 2 = 0 THEN 1 ELSE 0 END) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_indexed,
 pou_count FROM files WHERE pou_count % 7 <> 0 OR pou_count % 2 = 0""", "files")
graph_query("registry_totals", lambda g: tables.registry_totals(g.files), """
SELECT count(*) AS total_files, CAST(sum(pou_count) AS BIGINT) AS total_pous FROM files""", "files")


_KNOWN = """
known AS (SELECT id FROM pous), kinds AS (SELECT id FROM types),
nodes AS (SELECT id FROM known UNION ALL SELECT id FROM kinds),
rejects AS (SELECT 'variable' AS kind, id, 'unknown unit' AS reason FROM variables WHERE pou_id NOT IN (SELECT id FROM known)
 UNION ALL SELECT 'field', id, 'unknown type' FROM fields WHERE parent_type_id NOT IN (SELECT id FROM kinds)
 UNION ALL SELECT 'relationship', id, CASE WHEN from_id NOT IN (SELECT id FROM nodes) THEN 'unknown source' ELSE 'unknown target' END
 FROM relationships WHERE from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes))"""
_VIEWS = ("pous", "variables", "types", "fields", "relationships")
graph_query("rejects", lambda g: resolve.validate(fixtures.dangling(g))[1],
            fixtures.with_dangling(f"WITH {_KNOWN} SELECT * FROM rejects"), *_VIEWS)
graph_query("rejects_by_reason", lambda g: resolve.rejects_by_reason(resolve.validate(fixtures.dangling(g))[1]),
            fixtures.with_dangling(f"WITH {_KNOWN} SELECT kind, reason, count(*) AS count FROM rejects GROUP BY kind, reason"), *_VIEWS)
graph_query("valid_edges", lambda g: resolve.validate(fixtures.dangling(g))[0].relationships.select("id", "from_id", "to_id", "type"),
            fixtures.with_dangling(f"""
WITH {_KNOWN} SELECT id, from_id, to_id, type FROM relationships WHERE id NOT IN (SELECT id FROM rejects)"""), *_VIEWS)
graph_query("type_removal", lambda g: tables.remove_types(g, g.types.filter("type_kind = 'ENUM'").select("id")).relationships
            .select("id", "from_id", "to_id", "type"), """
SELECT r.id, r.from_id, r.to_id, r.type FROM relationships r
WHERE r.to_id NOT IN (SELECT id FROM types WHERE type_kind = 'ENUM')""", "types", "relationships")
graph_query("pou_update", lambda g: tables.update_pous(g.pous, g.pous.filter("pou_type = 'PROGRAM'").withColumn("name", F.upper("file_path")))
            .select("id", "name", "pou_type"),
            "SELECT id, CASE WHEN pou_type = 'PROGRAM' THEN upper(file_path) ELSE name END AS name, pou_type FROM pous", "pous")
graph_query("file_diagnostics_update", lambda g: tables.upsert_diagnostics(
    g.diagnostics, tables.diagnostic_rows(g.diagnostics.filter("severity = 1 AND line % 3 = 0").withColumn("column", F.lit(4)), 9),
    g.pous.filter("pou_type = 'PROGRAM'").select("file_path")).groupBy("file_path", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line")), """
SELECT file_path, severity, count(*) AS n, max(line) AS last_line FROM (
 SELECT file_path, severity, line FROM diagnostics WHERE file_path NOT IN (SELECT file_path FROM pous WHERE pou_type = 'PROGRAM')
 UNION ALL SELECT file_path, severity, CAST(line + 1 AS INT) FROM (SELECT DISTINCT file_path, severity, line, message FROM diagnostics
  WHERE severity = 1 AND line % 3 = 0) d) x GROUP BY file_path, severity""", "diagnostics", "pous")
graph_query("symbol_kinds", lambda g: g.pous.select(
    "id", text.kind_to_type(F.col("start_line") % 24).alias("by_kind"), text.infer_type(F.concat("name", F.lit(" (X)"))).alias("by_name"),
    text.clean_name(F.concat("name", F.lit(" (X)"))).alias("cleaned"), text.severity_label(F.col("start_line") % 6).alias("severity"),
    text.slugify(F.concat(F.lit("-é."), "file_path")).alias("slug"), text.wikilink("name", "file_path").alias("link"),
    text.mermaid_id("file_path").alias("node"), text.relative_path(F.translate("file_path", "/", "\\"), "src").alias("relative")), """
SELECT id, CASE start_line % 24 WHEN 2 THEN 'PROGRAM' WHEN 5 THEN 'FUNCTION_BLOCK' WHEN 6 THEN 'METHOD' WHEN 7 THEN 'PROPERTY'
  WHEN 8 THEN 'VARIABLE' WHEN 10 THEN 'ENUM' WHEN 11 THEN 'INTERFACE' WHEN 12 THEN 'FUNCTION' WHEN 13 THEN 'VARIABLE'
  WHEN 22 THEN 'ENUM_MEMBER' WHEN 23 THEN 'TYPE' END AS by_kind, 'FUNCTION_BLOCK' AS by_name, name AS cleaned,
 CASE start_line % 6 WHEN 1 THEN 'error' WHEN 2 THEN 'warning' WHEN 4 THEN 'hint' ELSE 'info' END AS severity,
 replace(replace(file_path, '/', '_'), '.', '_') AS slug, concat('[[', name, '|', file_path, ']]') AS link,
 replace(replace(file_path, '/', '_'), '.', '_') AS node, substr(file_path, 5) AS relative FROM pous""", "pous")
