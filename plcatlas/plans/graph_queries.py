"""Registered queries over the graph tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plcatlas.operators import clones, edges, lookup, metrics, near_clones, paging, traverse
from plcatlas.plans.registry import Registry
from plcatlas.sources import fixtures

NOW_MS = 1700300000000  # stands for "now" in the stale-file queries

registry = Registry()
define = registry.define

GRAPH = ("pous", "variables", "types", "relationships")

_METRICS_SQL = """
SELECT p.id, p.name, p.pou_type, p.file_path, coalesce(p.end_line, p.start_line) - p.start_line + 1 AS lines,
 coalesce(v.i, 0) AS input_vars, coalesce(v.o, 0) AS output_vars, coalesce(v.n - v.i - v.o, 0) AS internal_vars,
 coalesce(v.n, 0) AS total_vars, coalesce(c.n, 0) AS calls
FROM pous p
LEFT JOIN (SELECT pou_id, count(*) AS n, count(*) FILTER (direction = 'VAR_INPUT') AS i,
 count(*) FILTER (direction = 'VAR_OUTPUT') AS o FROM variables GROUP BY pou_id) v ON v.pou_id = p.id
LEFT JOIN (SELECT from_id, count(*) AS n FROM relationships WHERE type = 'CALLS' GROUP BY from_id) c ON c.from_id = p.id"""


def graph_query(name, operator, sql, *views):
    define(name, lambda spark, sf: operator(fixtures.graph(spark, sf)), fixtures.oracle(sql, *views) if sql else None)


def joined(column, *parts):
    """Entries of a list of structs as text."""
    return F.array_join(F.transform(column, lambda e: F.concat_ws(" ", *[e[p] for p in parts])), ";")


# ---- metrics ----
graph_query("pou_metrics", metrics.pou_metrics, _METRICS_SQL, "pous", "variables", "relationships")
graph_query("pou_metrics_of_file", lambda g: metrics.pou_metrics(g, file_path="SRC/F1"),
            _METRICS_SQL + " WHERE p.file_path ILIKE '%SRC/F1%'", "pous", "variables", "relationships")
graph_query("counts_by_type", metrics.counts_by_type, """
SELECT 'pou' AS section, pou_type AS type, count(*) AS count FROM pous GROUP BY pou_type
UNION ALL SELECT 'type', type_kind, count(*) FROM types GROUP BY type_kind
UNION ALL SELECT 'edge', type, count(*) FROM relationships GROUP BY type""", *GRAPH)

_HEALTH_SQL = """
SELECT 'entities' AS section, type AS key, CAST(sum(n) AS BIGINT) AS value FROM (
 SELECT pou_type AS type, count(*) AS n FROM pous GROUP BY pou_type
 UNION ALL SELECT type_kind, count(*) FROM types GROUP BY type_kind) e GROUP BY type
UNION ALL SELECT 'edges', type, count(*) FROM relationships GROUP BY type
UNION ALL SELECT 'entities', 'total', (SELECT count(*) FROM pous) + (SELECT count(*) FROM types)
UNION ALL SELECT 'edges', 'total', count(*) FROM relationships
UNION ALL SELECT 'files', 'total', count(*) FROM files
UNION ALL SELECT 'files', 'last_indexed', max(last_indexed) FROM files
UNION ALL SELECT 'status', 'ready', 1"""
graph_query("graph_health", metrics.graph_health, _HEALTH_SQL, *GRAPH, "files")
graph_query("graph_overview", metrics.graph_overview, """
SELECT f.n AS total_files, p.n AS total_pous, t.n AS total_types, v.n AS total_variables, r.n AS total_relationships,
 floor(CAST(v.n AS DOUBLE) / p.n * 100 + 0.5) / 100 AS avg_variables_per_pou
FROM (SELECT count(*) AS n FROM files) f, (SELECT count(*) AS n FROM pous) p, (SELECT count(*) AS n FROM types) t,
 (SELECT count(*) AS n FROM variables) v, (SELECT count(*) AS n FROM relationships) r""", *GRAPH, "files")
_CONNECTED_SQL = """
SELECT n.id, n.name, count(DISTINCT r.from_id) + count(DISTINCT r.to_id) AS connections
FROM (SELECT id, name FROM pous UNION ALL SELECT id, name FROM types) n
JOIN (SELECT from_id, to_id, from_id AS node FROM relationships
 UNION SELECT from_id, to_id, to_id FROM relationships) r ON r.node = n.id
GROUP BY n.id, n.name ORDER BY connections DESC, n.id LIMIT 10"""
graph_query("most_connected", metrics.most_connected, _CONNECTED_SQL, "pous", "types", "relationships")

_HOTSPOT_SQL = """
SELECT * FROM (SELECT p.id, p.name, p.pou_type AS type, p.file_path AS file, coalesce(d.n, 0) AS dependents,
 coalesce(v.n, 0) AS variables, {score} AS score FROM pous p
 LEFT JOIN (SELECT to_id, count(DISTINCT from_id) AS n FROM relationships GROUP BY to_id) d ON d.to_id = p.id
 LEFT JOIN (SELECT pou_id, count(*) AS n FROM variables GROUP BY pou_id) v ON v.pou_id = p.id) h
WHERE {keep} ORDER BY score DESC, id LIMIT 10"""
for metric, score, keep in (
    ("dependents", "coalesce(d.n, 0)", "dependents > 0"),
    ("variables", "coalesce(v.n, 0)", "variables > 0"),
    ("complexity", "coalesce(v.n, 0)", "variables > 0"),
    ("combined", "coalesce(d.n, 0) + coalesce(v.n, 0)", "true"),
):
    graph_query(f"hotspots_{metric}", lambda g, m=metric: metrics.hotspots(g, m),
                _HOTSPOT_SQL.format(score=score, keep=keep), "pous", "variables", "relationships")
graph_query("indegree_top10", metrics.indegree_top, """
SELECT r.id, n.name, r.dependents_count FROM (SELECT to_id AS id, count(*) AS dependents_count FROM relationships
 GROUP BY to_id ORDER BY dependents_count DESC, id LIMIT 10) r
LEFT JOIN (SELECT id, name FROM pous UNION ALL SELECT id, name FROM types) n ON n.id = r.id""",
            "pous", "types", "relationships")
_ISOLATED_SQL = """
SELECT p.id, p.name, p.pou_type, p.file_path FROM pous p
WHERE p.id NOT IN (SELECT from_id FROM relationships UNION SELECT to_id FROM relationships)"""
graph_query("health_score", metrics.health_score, f"""
SELECT CAST(floor((t.n - i.n) / CAST(t.n AS DOUBLE) * 100 + 0.5) AS BIGINT) AS score, t.fb AS fb_count,
 t.prg AS program_count, t.n AS total_nodes, i.n AS isolated_nodes
FROM (SELECT count(*) AS n, count(*) FILTER (pou_type = 'FUNCTION_BLOCK') AS fb,
 count(*) FILTER (pou_type = 'PROGRAM') AS prg FROM pous) t, (SELECT count(*) AS n FROM ({_ISOLATED_SQL}) x) i""",
            "pous", "relationships")
graph_query("isolated", edges.isolated, _ISOLATED_SQL, "pous", "relationships")
graph_query("stale_files", lambda g: metrics.stale_files(g, NOW_MS),
            f"SELECT path, last_indexed FROM files WHERE last_indexed < {NOW_MS} - 86400000", "files")

_ORPHAN_SQL = """
SELECT v.id, v.name, v.pou_id AS place, 'variable' AS type FROM variables v WHERE v.pou_id NOT IN (SELECT id FROM known)
UNION ALL SELECT r.id, r.type, NULL, 'relationship' FROM relationships r
WHERE r.from_id NOT IN (SELECT id FROM known UNION ALL SELECT id FROM types)"""

graph_query("orphans", lambda g: edges.orphans(fixtures.dangling(g)),
            fixtures.with_dangling("WITH known AS (SELECT * FROM pous) " + _ORPHAN_SQL), *GRAPH, "fields")

_WALK_DEPTH_SQL = """
SELECT max(depth) FROM walk_ends"""
_WALK_ENDS = """walk_ends(node, depth) AS (
 SELECT to_id, 1 FROM relationships WHERE type = 'CALLS'
 UNION SELECT r.to_id, w.depth + 1 FROM walk_ends w JOIN relationships r ON r.from_id = w.node AND r.type = 'CALLS'
 WHERE w.depth < 50)"""
graph_query("max_call_depth", traverse.max_call_depth,
            f"WITH RECURSIVE {_WALK_ENDS} SELECT max(depth) AS max_call_depth FROM walk_ends", "relationships")
_STATS_SQL = f"""
SELECT floor(CAST(v.n AS DOUBLE) / p.n * 100 + 0.5) / 100 AS avg_vars_per_pou,
 floor(CAST(c.n AS DOUBLE) / p.n * 100 + 0.5) / 100 AS avg_calls_per_pou,
 CAST((SELECT max(depth) FROM walk_ends) AS BIGINT) AS max_call_depth, s.n AS stale_files, CAST(0 AS BIGINT) AS orphans
FROM (SELECT count(*) AS n FROM variables) v, (SELECT count(*) AS n FROM pous) p,
 (SELECT count(*) AS n FROM relationships WHERE type = 'CALLS') c,
 (SELECT count(*) AS n FROM files WHERE last_indexed < {NOW_MS} - 86400000) s"""
graph_query("extended_stats", lambda g: metrics.extended_stats(g, NOW_MS),
            f"WITH RECURSIVE {_WALK_ENDS} {_STATS_SQL}", *GRAPH, "files")
graph_query("health_report", lambda g: metrics.health_report(g, "full", NOW_MS), f"""
WITH RECURSIVE {_WALK_ENDS}, basic AS ({_HEALTH_SQL}), stats AS ({_STATS_SQL}), connected AS ({_CONNECTED_SQL}),
 numbers AS (SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM pous) AS total_pous,
  (SELECT count(*) FROM types) AS total_types, (SELECT count(*) FROM variables) AS total_variables,
  (SELECT count(*) FROM relationships) AS total_relationships)
SELECT 'basic' AS part, section, key, CAST(value AS VARCHAR) AS value FROM basic
UNION ALL SELECT 'extended', 'stats', 'avg_vars_per_pou', CAST(avg_vars_per_pou AS VARCHAR) FROM stats
UNION ALL SELECT 'extended', 'stats', 'avg_calls_per_pou', CAST(avg_calls_per_pou AS VARCHAR) FROM stats
UNION ALL SELECT 'extended', 'stats', 'max_call_depth', CAST(max_call_depth AS VARCHAR) FROM stats
UNION ALL SELECT 'extended', 'stats', 'stale_files', CAST(stale_files AS VARCHAR) FROM stats
UNION ALL SELECT 'extended', 'stats', 'orphans', CAST(orphans AS VARCHAR) FROM stats
UNION ALL SELECT 'extended', 'stale_file', path, CAST(last_indexed AS VARCHAR) FROM files
 WHERE last_indexed < {NOW_MS} - 86400000
UNION ALL SELECT 'metrics', 'totals', 'total_files', CAST(total_files AS VARCHAR) FROM numbers
UNION ALL SELECT 'metrics', 'totals', 'total_pous', CAST(total_pous AS VARCHAR) FROM numbers
UNION ALL SELECT 'metrics', 'totals', 'total_types', CAST(total_types AS VARCHAR) FROM numbers
UNION ALL SELECT 'metrics', 'totals', 'total_variables', CAST(total_variables AS VARCHAR) FROM numbers
UNION ALL SELECT 'metrics', 'totals', 'total_relationships', CAST(total_relationships AS VARCHAR) FROM numbers
UNION ALL SELECT 'metrics', 'totals', 'avg_variables_per_pou', CAST(avg_vars_per_pou AS VARCHAR) FROM stats
UNION ALL SELECT 'stats', CASE WHEN section = 'edges' THEN 'edge' ELSE section END, key, CAST(value AS VARCHAR) FROM (
 SELECT 'pou' AS section, pou_type AS key, count(*) AS value FROM pous GROUP BY pou_type
 UNION ALL SELECT 'type', type_kind, count(*) FROM types GROUP BY type_kind
 UNION ALL SELECT 'edge', type, count(*) FROM relationships GROUP BY type) c
UNION ALL SELECT 'stats', 'most_connected', id, CAST(connections AS VARCHAR) FROM connected""", *GRAPH, "files")

# ---- clones ----
_CLONES_SQL = """
WITH sig AS (SELECT p.id, p.name, p.pou_type AS type, p.file_path AS file, count(*) AS items,
  string_agg(v.name || ':' || v.var_type, ';' ORDER BY v.name || ':' || v.var_type) AS signature
 FROM pous p JOIN variables v ON v.pou_id = p.id WHERE v.direction IN ('VAR_INPUT', 'VAR_OUTPUT', 'VAR_IN_OUT') {scope}
 GROUP BY p.id, p.name, p.pou_type, p.file_path HAVING count(*) >= 3),
grp AS (SELECT signature, min(id) AS group_id, count(*) AS group_size FROM sig GROUP BY signature HAVING count(*) >= 2)
{select}"""
_MEMBERS = "SELECT g.group_id, g.group_size, s.id, s.name, s.type, s.file, s.items FROM sig s JOIN grp g USING (signature)"
_SUMMARY = """SELECT count(*) AS clone_groups, CAST(coalesce(sum(group_size), 0) AS BIGINT) AS duplicated_entities FROM grp"""
graph_query("pou_clones", clones.pou_clones, _CLONES_SQL.format(scope="", select=_MEMBERS), "pous", "variables")
graph_query("pou_clones_units", lambda g: clones.pou_clones(g, 3, "pou"), _CLONES_SQL.format(
    scope="AND p.pou_type IN ('FUNCTION_BLOCK', 'PROGRAM', 'FUNCTION')", select=_MEMBERS), "pous", "variables")
graph_query("clone_summary", lambda g: clones.clone_summary(clones.pou_clones(g)),
            _CLONES_SQL.format(scope="", select=_SUMMARY), "pous", "variables")
graph_query("clone_signatures", lambda g: clones.signatures_of(g, clones.pou_clones(g)), _CLONES_SQL.format(
    scope="", select="""SELECT v.pou_id AS group_id, v.name || ':' || v.var_type AS item FROM variables v
JOIN grp g ON g.group_id = v.pou_id WHERE v.direction IN ('VAR_INPUT', 'VAR_OUTPUT', 'VAR_IN_OUT')"""), "pous", "variables")
define("near_clones", lambda spark, sf: near_clones.near_clones(fixtures.graph(spark, sf).with_tables(
    variables=fixtures.view(spark, sf, "wide_variables"))), fixtures.oracle("""
WITH items AS (SELECT DISTINCT pou_id AS id, name || ':' || var_type AS item FROM wide_variables
  WHERE direction IN ('VAR_INPUT', 'VAR_OUTPUT', 'VAR_IN_OUT')),
 sets AS (SELECT id, count(*) AS size, string_agg(item, ';' ORDER BY item) AS sig FROM items GROUP BY id HAVING count(*) >= 3),
 shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM items a JOIN items b ON b.item = a.item AND b.id <> a.id GROUP BY a.id, b.id),
 linked AS (SELECT s.a, s.b, y.sig FROM shared s JOIN sets x ON x.id = s.a JOIN sets y ON y.id = s.b WHERE 100 * s.n >= 80 * (x.size + y.size - s.n))
SELECT p.id, p.name, p.file_path, c.class_id, c.class_size, x.size, count(DISTINCT l.sig) FILTER (l.sig <> x.sig) AS near_classes, count(*) AS links
FROM linked l JOIN sets x ON x.id = l.a JOIN pous p ON p.id = l.a JOIN (SELECT sig, min(id) AS class_id, count(*) AS class_size FROM sets GROUP BY sig) c ON c.sig = x.sig
GROUP BY ALL""", "pous", "wide_variables"))
graph_query("type_clones", clones.type_clones, """
WITH sig AS (SELECT id, name, file_path AS file, regexp_extract(definition, 'T_[0-9]+') AS signature FROM types
 WHERE type_kind = 'STRUCT' AND definition IS NOT NULL),
grp AS (SELECT signature, min(id) AS group_id, count(*) AS group_size FROM sig GROUP BY signature HAVING count(*) >= 2)
SELECT g.group_id, g.group_size, s.id, s.name, 'STRUCT' AS type, s.file, CAST(3 AS BIGINT) AS items
FROM sig s JOIN grp g USING (signature)""", "types")

# ---- lookups ----
_FIRST_SQL = "SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM pous GROUP BY name"
graph_query("first_by_name", lambda g: lookup.first_by_name(g.pous), _FIRST_SQL, "pous")
graph_query("pou_names", lookup.names, "SELECT DISTINCT name FROM pous", "pous")
graph_query("pous_by_names", lambda g: lookup.by_keys(g.pous, "name", g.variables.select("var_type"), ignore_case=True)
            .select("id", "name", "pou_type", "file_path"),
            """SELECT id, name, pou_type, file_path FROM pous
WHERE lower(name) IN (SELECT lower(var_type) FROM variables)""", "pous", "variables")
graph_query("search_pous", lambda g: lookup.search_pous(g, "fb_1", None, 100), """
SELECT id, name, pou_type, file_path, start_line FROM pous WHERE name ILIKE 'fb_1'
ORDER BY pou_type, file_path, id LIMIT 100""", "pous")
graph_query("search_pous_all", lambda g: lookup.search_pous(g, "b_1%", None, None).unionByName(
    lookup.search_pous(g, "19", "PROGRAM", None)), """
SELECT id, name, pou_type, file_path, start_line FROM pous WHERE name ILIKE 'b_1%'
UNION ALL SELECT id, name, pou_type, file_path, start_line FROM pous WHERE name ILIKE '%19%' AND pou_type = 'PROGRAM'""",
            "pous")
graph_query("search_pous_regex", lambda g: lookup.search_pous(g, "^fb_[0-9]*7$", None, None, regex=True).unionByName(
    lookup.search_pous(g, "FB_1%", None, None, case_sensitive=True)), """
SELECT id, name, pou_type, file_path, start_line FROM pous WHERE regexp_matches(name, '^FB_[0-9]*7$')
UNION ALL SELECT id, name, pou_type, file_path, start_line FROM pous WHERE name LIKE 'FB_1%'""", "pous")
graph_query("search_types", lambda g: lookup.search_types(g, "st_1%", None), """
SELECT id, name, type_kind, file_path, start_line FROM types WHERE name ILIKE 'st_1%'""", "types")
graph_query("search_type_definitions", lambda g: lookup.search_type_definitions(g, "t_1"), """
SELECT id, name, type_kind, definition FROM types WHERE definition ILIKE '%t_1%'""", "types")
graph_query("type_fields", lambda g: lookup.fields_of(g, g.types.select("id")), """
SELECT f.id, f.parent_type_id, f.name, f.field_type, f.start_line FROM fields f JOIN types t ON t.id = f.parent_type_id""",
            "fields", "types")
graph_query("search_fields", lambda g: lookup.search_fields(g, "A", 50), """
SELECT id, parent_type_id, name, field_type, file_path, start_line FROM fields WHERE name ILIKE '%A%'
ORDER BY name, id LIMIT 50""", "fields")
_VARIABLE = "v.id, v.pou_id, v.name, v.direction, v.var_type, v.start_line"
_VARIABLE_COLUMNS = ["id", "pou_id", "name", "direction", "var_type", "start_line"]
graph_query("pou_variables", lambda g: lookup.variables_of(g, g.pous.filter("pou_type = 'PROGRAM'").select("id"))
            .select(*_VARIABLE_COLUMNS),
            f"SELECT {_VARIABLE} FROM variables v JOIN pous p ON p.id = v.pou_id WHERE p.pou_type = 'PROGRAM'",
            "variables", "pous")
graph_query("variables_by_direction", lambda g: lookup.variables_by_direction(g, "VAR_IN_OUT").select(*_VARIABLE_COLUMNS),
            f"SELECT {_VARIABLE} FROM variables v WHERE direction = 'VAR_IN_OUT'", "variables")
graph_query("variables_of_type", lambda g: lookup.variables_of_type(g, "T_1").select(*_VARIABLE_COLUMNS),
            f"SELECT {_VARIABLE} FROM variables v WHERE var_type = 'T_1'", "variables")
graph_query("global_variables", lambda g: lookup.global_variables(g, "gvl_1%").select("id", "file_path", "name", "start_line"), """
SELECT id, file_path, name, start_line FROM variable_lists WHERE direction = 'VAR_GLOBAL' AND name ILIKE 'gvl_1%'""",
            "variable_lists")
graph_query("file_variable_lists", lambda g: lookup.variable_lists_of(g, g.files.select("path"))
            .select("id", "file_path", "name", "direction", "start_line"),
            "SELECT id, file_path, name, direction, start_line FROM variable_lists WHERE file_path IN (SELECT path FROM files)",
            "variable_lists", "files")
graph_query("file_diagnostics", lambda g: lookup.diagnostics_of(g, g.files.select("path"))
            .select("id", "file_path", "line", "severity", "code", "message"),
            "SELECT id, file_path, line, severity, code, message FROM diagnostics WHERE file_path IN (SELECT path FROM files)",
            "diagnostics", "files")
graph_query("diagnostics_by_severity", lambda g: lookup.diagnostics_by_severity(g, 2)
            .select("id", "file_path", "line", "label", "message"),
            "SELECT id, file_path, line, 'warning' AS label, message FROM diagnostics WHERE severity = 2", "diagnostics")
graph_query("search", lambda g: lookup.search(g, "1", None, None).select("id", "name", "type", "file", "line"), """
SELECT id, name, pou_type AS type, file_path AS file, start_line AS line FROM pous WHERE name ILIKE '%1%'
UNION ALL SELECT id, name, type_kind, file_path, start_line FROM types WHERE name ILIKE '%1%'
UNION ALL SELECT id, name, 'FIELD', file_path, start_line FROM fields WHERE name ILIKE '%1%'""", "pous", "types", "fields")
graph_query("search_limited", lambda g: lookup.search(g, "1", "ENUM", 50).select("id", "name", "type", "file", "line"), """
SELECT id, name, type_kind AS type, file_path AS file, start_line AS line FROM types
WHERE name ILIKE '%1%' AND type_kind = 'ENUM' ORDER BY file_path, id LIMIT 50""", "types")
graph_query("search_advanced", lambda g: lookup.search_advanced(g, direction="VAR_INPUT", var_type="t_1", query="b_1")
            .select("id", "name", "pou_type", "file_path", "start_line", "page",
                    joined("variables", "var_name", "direction", "var_type").alias("variables")), """
SELECT p.id, p.name, p.pou_type, p.file_path, p.start_line, 0 AS page,
 string_agg(v.name || ' ' || v.direction || ' ' || v.var_type, ';' ORDER BY v.name, v.id) AS variables
FROM pous p JOIN variables v ON v.pou_id = p.id WHERE v.direction = 'VAR_INPUT' AND v.var_type ILIKE '%t_1%'
 AND (p.name ILIKE '%b_1%' OR v.name ILIKE '%b_1%')
GROUP BY p.id, p.name, p.pou_type, p.file_path, p.start_line""", "pous", "variables")
graph_query("resolve_entity", lambda g: lookup.resolve_entity(g, "FB_100").unionByName(
    lookup.resolve_entity(g, "t_1", "ENUM", 10)).select("kind", "id", "name", "type", "file", "line"), """
SELECT * FROM (SELECT kind, id, name, type, file, line FROM (
  SELECT 'POU' AS kind, id, name, pou_type AS type, file_path AS file, start_line AS line FROM pous WHERE name = 'FB_100'
  UNION ALL SELECT 'TYPE', id, name, type_kind, file_path, start_line FROM types WHERE name ILIKE '%FB_100%') x
 ORDER BY kind, type, file, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'TYPE', id, name, type_kind, file_path, start_line FROM types WHERE name ILIKE '%t_1%'
 ORDER BY type_kind, file_path, id LIMIT 10)""", "pous", "types")
graph_query("file_entities", lookup.file_entities, """
SELECT 'POU' AS kind, id, name, pou_type AS type, file_path, start_line AS line FROM pous
UNION ALL SELECT 'TYPE', id, name, type_kind, file_path, start_line FROM types
UNION ALL SELECT 'VAR_GLOBAL', id, name, direction, file_path, start_line FROM variable_lists""",
            "pous", "types", "variable_lists")
_LIST = "coalesce(string_agg({item}, ';' ORDER BY v.name, v.var_type) FILTER ({where}), '')"


def flow(rows):
    lists = {"inputs": ("name", "var_type"), "outputs": ("name", "var_type"), "internals": ("name", "var_type", "direction")}
    texts = [F.coalesce(joined(c, *fields), F.lit("")).alias(c) for c, fields in lists.items()]
    return rows.select("id", "name", "page", "input_count", "output_count", "internal_count", *texts)


def cards(rows):
    return rows.select("id", "name", "type", "page", *[F.array_join(c, ";").alias(c) for c in ("variables", "calls", "called_by")])


def base_names(graph):
    """Names of the units that others extend."""
    extended = graph.relationships.filter("type = 'EXTENDS'").select(F.col("to_id").alias("id"))
    return graph.pous.join(extended, "id", "left_semi").select("name")


_BASES = "name IN (SELECT p.name FROM pous p JOIN relationships r ON r.to_id = p.id WHERE r.type = 'EXTENDS')"
_FLOW_SQL = f"""
SELECT p.id, p.name, 0 AS page, CAST(count(*) FILTER (v.direction = 'VAR_INPUT') AS INT) AS input_count,
 CAST(count(*) FILTER (v.direction = 'VAR_OUTPUT') AS INT) AS output_count,
 CAST(count(*) FILTER (v.direction IN ('VAR', 'VAR_TEMP', 'VAR_IN_OUT')) AS INT) AS internal_count,
 {_LIST.format(item="v.name || ' ' || v.var_type", where="v.direction = 'VAR_INPUT'")} AS inputs,
 {_LIST.format(item="v.name || ' ' || v.var_type", where="v.direction = 'VAR_OUTPUT'")} AS outputs,
 {_LIST.format(item="v.name || ' ' || v.var_type || ' ' || v.direction",
               where="v.direction IN ('VAR', 'VAR_TEMP', 'VAR_IN_OUT')")} AS internals
FROM pous p LEFT JOIN variables v ON v.pou_id = p.id GROUP BY p.id, p.name"""
graph_query("variable_flow", lambda g: flow(lookup.variable_flow(g)), _FLOW_SQL, "pous", "variables")
graph_query("variable_flow_of_bases", lambda g: flow(lookup.variable_flow(g, base_names(g))), f"SELECT * FROM ({_FLOW_SQL}) WHERE {_BASES}", *GRAPH)
_KINDS = {"inputs": "v.direction = 'VAR_INPUT'", "outputs": "v.direction = 'VAR_OUTPUT'",
          "internals": "v.direction IN ('VAR', 'VAR_TEMP', 'VAR_IN_OUT')"}
graph_query("variable_flow_pages", lambda g: lookup.variable_flow(g, page_rows=1).select(
    "id", "page", "input_count", "output_count", "internal_count",
    *[F.coalesce(joined(c, "name", "id"), F.lit("")).alias(c) for c in _KINDS]), f"""
WITH ranked AS (SELECT v.pou_id, v.direction, v.name || ' ' || v.id AS entry, CAST(row_number() OVER (PARTITION BY v.pou_id,
  CASE WHEN {_KINDS["inputs"]} THEN 0 WHEN {_KINDS["outputs"]} THEN 1 ELSE 2 END ORDER BY v.name, v.var_type, v.id) - 1 AS INT) AS page
 FROM variables v),
sizes AS (SELECT p.id, CAST(count(*) FILTER ({_KINDS["inputs"]}) AS INT) AS input_count, CAST(count(*) FILTER ({_KINDS["outputs"]}) AS INT) AS output_count,
 CAST(count(*) FILTER ({_KINDS["internals"]}) AS INT) AS internal_count FROM pous p LEFT JOIN variables v ON v.pou_id = p.id GROUP BY p.id)
SELECT s.id, coalesce(v.page, 0) AS page, s.input_count, s.output_count, s.internal_count,
 {", ".join(f"coalesce(max(v.entry) FILTER ({where}), '') AS {name}" for name, where in _KINDS.items())}
FROM sizes s LEFT JOIN ranked v ON v.pou_id = s.id GROUP BY ALL""", "pous", "variables")
graph_query("state_machine_candidates", lookup.state_machine_candidates, """
SELECT id, name, pou_type, file_path, start_line, end_line FROM pous WHERE pou_type IN ('FUNCTION_BLOCK', 'PROGRAM')""", "pous")
_CARDS_SQL = """
SELECT n.id, n.name, n.type, 0 AS page, coalesce(v.l, '') AS variables, coalesce(o.l, '') AS calls,
 coalesce(i.l, '') AS called_by
FROM (SELECT id, name, pou_type AS type FROM pous UNION ALL SELECT id, name, type_kind FROM types) n
LEFT JOIN (SELECT pou_id, string_agg(name || ' ' || direction || ' ' || var_type, ';' ORDER BY name, direction, var_type) AS l
 FROM variables GROUP BY pou_id) v ON v.pou_id = n.id
LEFT JOIN (SELECT from_id, string_agg(to_id, ';' ORDER BY to_id) AS l FROM relationships WHERE type = 'CALLS'
 GROUP BY from_id) o ON o.from_id = n.id
LEFT JOIN (SELECT to_id, string_agg(from_id, ';' ORDER BY from_id) AS l FROM relationships WHERE type = 'CALLS'
 GROUP BY to_id) i ON i.to_id = n.id"""
graph_query("entity_cards", lambda g: cards(lookup.entity_cards(g)), _CARDS_SQL, *GRAPH)
graph_query("entity_cards_of_bases", lambda g: cards(lookup.entity_cards(g, base_names(g))), f"SELECT * FROM ({_CARDS_SQL}) WHERE {_BASES}", *GRAPH)

# ---- joins ----
_INSTANCES_SQL = """
SELECT v.id AS var_id, v.name AS var_name, v.direction, v.var_type, v.start_line AS line, p.name AS pou_name, p.pou_type,
 p.file_path AS file FROM variables v JOIN pous p ON p.id = v.pou_id WHERE v.var_type IN (SELECT name FROM pous)"""
graph_query("fb_instances", edges.fb_instances, _INSTANCES_SQL, "pous", "variables")
graph_query("importers", lambda g: edges.importers(g, "T_1", None), """
SELECT DISTINCT p.name, p.pou_type AS type, p.file_path AS file, v.start_line AS line FROM pous p
JOIN variables v ON v.pou_id = p.id WHERE v.var_type = 'T_1'""", "pous", "variables")
graph_query("references", edges.references, """
SELECT from_id AS entity_id, 'out' AS direction, id, from_id, to_id, type FROM relationships
UNION ALL SELECT to_id, 'in', id, from_id, to_id, type FROM relationships""", "relationships")
graph_query("call_hierarchy", edges.call_hierarchy, """
SELECT c.id, c.pou_id, c.direction, c.other_id, p.name AS other_name, p.file_path AS other_file, CAST(NULL AS INT) AS line
FROM (SELECT id, to_id AS pou_id, 'incoming' AS direction, from_id AS other_id FROM relationships WHERE type = 'CALLS'
 UNION ALL SELECT id, from_id, 'outgoing', to_id FROM relationships WHERE type = 'CALLS') c
LEFT JOIN pous p ON p.id = c.other_id""", "pous", "relationships")
graph_query("implementers", edges.implementers, """
SELECT t.name AS interface, p.id, p.name, p.pou_type, p.file_path FROM relationships r
JOIN types t ON t.id = r.to_id JOIN pous p ON p.id = r.from_id WHERE r.type = 'IMPLEMENTS'""", *GRAPH)
_TARGETS_SQL = """found AS (SELECT n.name, coalesce(p.id, t.id) AS id
 FROM (SELECT name FROM pous UNION SELECT name FROM types) n
 LEFT JOIN (SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM pous GROUP BY name) p ON p.name = n.name
 LEFT JOIN (SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM types GROUP BY name) t ON t.name = n.name)"""
_DIRECT_SQL = """SELECT f.name AS target, r.id AS edge_id, p.id, p.name, p.pou_type, p.file_path, r.type AS rel_type
FROM found f JOIN relationships r ON r.to_id = f.id JOIN pous p ON p.id = r.from_id"""
graph_query("direct_dependents", edges.direct_dependents, f"WITH {_TARGETS_SQL} {_DIRECT_SQL}", *GRAPH)
_FLOW_FROM = """FROM relationships r JOIN pous a ON a.id = r.from_id JOIN pous b ON b.id = r.to_id
JOIN variables o ON o.pou_id = a.id AND o.direction = 'VAR_OUTPUT'
JOIN variables i ON i.pou_id = b.id AND i.direction = 'VAR_INPUT' WHERE r.type = 'CALLS'"""
_FLOW_SQL = f"""SELECT r.id AS edge_id, a.name AS from_pou, o.name AS from_var, b.name AS to_pou, i.name AS to_var {_FLOW_FROM}"""
graph_query("data_flow", edges.data_flow, _FLOW_SQL, *GRAPH)
graph_query("data_flow_by_type", lambda g: edges.data_flow(g, by_type=True), _FLOW_SQL + " AND i.var_type = o.var_type", *GRAPH)
graph_query("data_flow_summary", edges.data_flow_summary, f"""
SELECT r.id AS edge_id, a.name AS from_pou, b.name AS to_pou, count(DISTINCT o.id) AS outputs,
 count(DISTINCT i.id) AS inputs, count(*) AS flows {_FLOW_FROM} GROUP BY r.id, a.name, b.name""", *GRAPH)
graph_query("cross_file_deps", edges.cross_file_dependencies, """
SELECT a.file_path AS from_file, b.file_path AS to_file, r.type, count(*) AS count FROM relationships r
JOIN pous a ON a.id = r.from_id JOIN pous b ON b.id = r.to_id WHERE a.file_path <> b.file_path
GROUP BY a.file_path, b.file_path, r.type""", *GRAPH)
graph_query("call_lists", lambda g: edges.call_lists(g).select(
    "pou_id", "page", joined("calls", "name").alias("calls"), joined("called_by", "name").alias("called_by")), """
SELECT coalesce(o.id, i.id) AS pou_id, 0 AS page, coalesce(o.l, '') AS calls, coalesce(i.l, '') AS called_by
FROM (SELECT r.from_id AS id, string_agg(p.name, ';' ORDER BY p.name) AS l FROM relationships r JOIN pous p ON p.id = r.to_id
 WHERE type = 'CALLS' GROUP BY r.from_id) o
FULL JOIN (SELECT r.to_id AS id, string_agg(p.name, ';' ORDER BY p.name) AS l FROM relationships r
 JOIN pous p ON p.id = r.from_id WHERE type = 'CALLS' GROUP BY r.to_id) i ON i.id = o.id""", *GRAPH)
graph_query("type_usages", edges.type_usages, """
SELECT DISTINCT t.id AS type_id, t.name AS type_name, p.id AS pou_id, p.name, p.file_path AS file FROM relationships r
JOIN types t ON t.id = r.to_id JOIN pous p ON p.id = r.from_id""", *GRAPH)

# ---- traversal ----
_CHAIN_SQL = """
WITH RECURSIVE chain(root, from_id, to_id, depth) AS (
 SELECT from_id, from_id, to_id, 1 FROM relationships WHERE type = 'CALLS'
 UNION ALL SELECT c.root, r.from_id, r.to_id, c.depth + 1 FROM chain c
  JOIN relationships r ON r.from_id = c.to_id AND r.type = 'CALLS' WHERE c.depth < {depth})"""
_FULL_CHAIN_SQL = _CHAIN_SQL.format(depth=traverse.CALL_CHAIN_DEPTH)
graph_query("call_chain", lambda g: traverse.call_chain(g, g.pous.select("id")),
            _FULL_CHAIN_SQL + " SELECT root, from_id, to_id, depth, count(*) AS walks FROM chain GROUP BY ALL", "relationships")
graph_query("call_chain_walks", lambda g: traverse.expand(traverse.call_chain(g, g.pous.select("id"))),
            _FULL_CHAIN_SQL + " SELECT root, from_id, to_id, depth FROM chain", "relationships")
graph_query("calls_view", traverse.calls_view, _CHAIN_SQL.format(depth=traverse.CALLS_VIEW_DEPTH) + """
SELECT p.id, p.name, p.pou_type, p.file_path, coalesce(i.n, 0) AS incoming_count, coalesce(o.n, 0) AS outgoing_count,
 coalesce(c.n, 0) AS chain_size, coalesce(c.d, 0) AS chain_depth FROM pous p
LEFT JOIN (SELECT to_id, count(*) AS n FROM relationships WHERE type = 'CALLS' GROUP BY to_id) i ON i.to_id = p.id
LEFT JOIN (SELECT from_id, count(*) AS n FROM relationships WHERE type = 'CALLS' GROUP BY from_id) o ON o.from_id = p.id
LEFT JOIN (SELECT root, count(*) AS n, max(depth) AS d FROM chain GROUP BY root) c ON c.root = p.id""", "pous", "relationships")
_TREE_SQL = """
WITH RECURSIVE tree(root, id, depth) AS (
 SELECT r.{a}, p.id, 1 FROM relationships r JOIN pous p ON p.id = r.{b} WHERE r.type = 'EXTENDS'
 UNION ALL SELECT t.root, p.id, t.depth + 1 FROM tree t JOIN relationships r ON r.{a} = t.id AND r.type = 'EXTENDS'
  JOIN pous p ON p.id = r.{b} WHERE t.depth < 20)
SELECT t.root, t.id, p.name, p.file_path, t.depth, count(*) AS walks FROM tree t JOIN pous p ON p.id = t.id GROUP BY ALL"""
graph_query("ancestors", traverse.ancestors, _TREE_SQL.format(a="from_id", b="to_id"), "pous", "relationships")
graph_query("descendants", traverse.descendants, _TREE_SQL.format(a="to_id", b="from_id"), "pous", "relationships")
_DEPENDENTS_SQL = """
WITH RECURSIVE dep(root, id, rel_type, depth{visited}) AS (
 SELECT r.to_id, r.from_id, r.type, 1{first} FROM relationships r JOIN pous p ON p.id = r.from_id
  WHERE r.to_id IN (SELECT id FROM {roots})
 UNION SELECT d.root, r.from_id, r.type, d.depth + 1{append} FROM dep d JOIN relationships r ON r.to_id = d.id
  JOIN pous p ON p.id = r.from_id WHERE r.type <> 'CONTAINS' AND d.depth < {depth}{simple})"""
_SHORTEST = dict(visited="", first="", append="", simple="")
_PATHS = dict(visited=", visited", first=", [r.from_id]", append=", list_append(d.visited, r.from_id)",
              simple=" AND NOT list_contains(d.visited, r.from_id)")
_SHORTEST_ROWS = """(SELECT DISTINCT d.root, d.id, d.rel_type, d.depth FROM dep d
 JOIN (SELECT root, id, min(depth) AS depth FROM dep GROUP BY root, id) m
 ON m.root = d.root AND m.id = d.id AND m.depth = d.depth)"""
_ALL_DEPENDENTS_SQL = _DEPENDENTS_SQL.format(roots="pous", depth=traverse.DEPENDENTS_DEPTH, **_SHORTEST)
graph_query("transitive_dependents", lambda g: traverse.transitive_dependents(g, g.pous.select("id")), f"""{_ALL_DEPENDENTS_SQL}
SELECT d.root, p.id, p.name, p.pou_type, p.file_path, d.rel_type, d.depth FROM {_SHORTEST_ROWS} d JOIN pous p ON p.id = d.id""",
            "pous", "relationships")
graph_query("impact_reach", lambda g: traverse.impact_reach(g, g.pous.select("id")), f"""{_ALL_DEPENDENTS_SQL}
SELECT p.id, p.name, p.pou_type, p.file_path, count(DISTINCT d.root) AS n_roots, min(d.depth) AS min_depth
FROM dep d JOIN pous p ON p.id = d.id GROUP BY ALL""", "pous", "relationships")
graph_query("dependent_paths", lambda g: traverse.transitive_dependents(g, g.pous.select("id"), mode="paths"),
            _DEPENDENTS_SQL.format(roots="pous", depth=traverse.DEPENDENTS_DEPTH, **_PATHS) + """
SELECT DISTINCT d.root, p.id, p.name, p.pou_type, p.file_path, d.rel_type, d.depth FROM dep d JOIN pous p ON p.id = d.id""",
            "pous", "relationships")
_IMPACT_SQL = _DEPENDENTS_SQL.format(roots="found", depth=traverse.DEPENDENTS_DEPTH, **_SHORTEST).replace(
    "WITH RECURSIVE ", f"WITH RECURSIVE {_TARGETS_SQL}, ")
_IMPACT_ROWS = f"""SELECT target, 'direct' AS scope, id, name, pou_type, file_path, rel_type, 1 AS depth FROM ({_DIRECT_SQL}) x
UNION ALL SELECT f.name, 'transitive', p.id, p.name, p.pou_type, p.file_path, d.rel_type, d.depth
FROM {_SHORTEST_ROWS} d JOIN found f ON f.id = d.root JOIN pous p ON p.id = d.id"""
graph_query("impact", traverse.impact, f"{_IMPACT_SQL} {_IMPACT_ROWS}", *GRAPH)
graph_query("impact_summary", lambda g: traverse.impact_summary(traverse.impact(g)), f"""{_IMPACT_SQL}
SELECT target, count(*) FILTER (scope = 'direct') AS direct_count, count(*) FILTER (scope = 'transitive') AS transitive_count,
 max(depth) AS max_depth FROM ({_IMPACT_ROWS}) i GROUP BY target""", *GRAPH)
graph_query("strong_components", traverse.strong_components, """
WITH RECURSIVE link AS (SELECT DISTINCT from_id, to_id FROM relationships),
 ways(a, b) AS (SELECT from_id, to_id FROM link UNION SELECT w.a, l.to_id FROM ways w JOIN link l ON l.from_id = w.b),
 node AS (SELECT from_id AS id FROM link UNION SELECT to_id FROM link)
SELECT n.id AS node, least(n.id, coalesce(min(o.a), n.id)) AS component FROM node n
LEFT JOIN (SELECT x.a, x.b FROM ways x JOIN ways y ON y.a = x.b AND y.b = x.a) o ON o.b = n.id GROUP BY n.id""", "relationships")
graph_query("cyclic_core", lambda g: traverse.cyclic_core(g.relationships), """
WITH RECURSIVE link AS (SELECT DISTINCT from_id, to_id FROM relationships),
 fwd(node, depth) AS (SELECT to_id, 1 FROM link UNION SELECT l.to_id, f.depth + 1 FROM fwd f JOIN link l ON l.from_id = f.node
  WHERE f.depth < 64),
 back(node, depth) AS (SELECT from_id, 1 FROM link UNION SELECT l.from_id, b.depth + 1 FROM back b
  JOIN link l ON l.to_id = b.node WHERE b.depth < 64)
SELECT l.from_id, l.to_id FROM link l
WHERE l.from_id IN (SELECT node FROM fwd WHERE depth = 64) AND l.from_id IN (SELECT node FROM back WHERE depth = 64)
 AND l.to_id IN (SELECT node FROM fwd WHERE depth = 64) AND l.to_id IN (SELECT node FROM back WHERE depth = 64)""",
            "relationships")

# ---- pages ----
_NODES = """SELECT 'POU' AS kind, id, name, pou_type AS type, file_path AS file, start_line AS line FROM pous
UNION ALL SELECT 'TYPE', id, name, type_kind, file_path, start_line FROM types"""
_AFTER = ("POU", "src/f20.st", 500, "pou:0")
_PAGE_SQL = f"""SELECT * FROM ({_NODES}) n WHERE (kind, file, line, id) > ('POU', 'src/f20.st', 500, 'pou:0')
ORDER BY kind, file, line, id LIMIT 100"""
graph_query("graph_nodes", paging.graph_nodes, _NODES, "pous", "types")
graph_query("graph_page", lambda g: paging.graph_page(g, 100, _AFTER), _PAGE_SQL, "pous", "types")
graph_query("graph_page_edges", lambda g: paging.graph_page_edges(g, paging.graph_page(g, 100, _AFTER)), f"""
SELECT id, from_id AS source, to_id AS target, type FROM relationships WHERE from_id IN (SELECT id FROM ({_PAGE_SQL}) p)""",
            "pous", "types", "relationships")
graph_query("result_totals", lambda g: paging.counted(lookup.search(g, "FB", None, None)), """
SELECT (SELECT count(*) FROM pous WHERE name ILIKE '%FB%') + (SELECT count(*) FROM types WHERE name ILIKE '%FB%') +
 (SELECT count(*) FROM fields WHERE name ILIKE '%FB%') AS total_count""", "pous", "types", "fields")
