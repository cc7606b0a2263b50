"""Graph-shaped views over the star-schema test tables.

Each view is one SQL text that Spark and DuckDB both run; the oracle SQL uses the same texts as WITH clauses.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from plcatlas.graph import Graph

BASE_TABLES = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

FILES_PER_TASK = 5000

# A file with every form of declaration, one SQL expression a line; k is the number of the file, b and c those of two others.
PLANT = (
    "concat('TYPE ST_', k, ' : STRUCT')",
    "'  a, b : INT := 3;'",
    "'  pos :'",
    "'    ARRAY[0..3] OF REAL; name : STRING;'",
    "'END_STRUCT; END_TYPE'",
    "concat('TYPE E_', k, ' : (Off_', k, ', On := 2, Hold); END_TYPE')",
    "concat('TYPE A_', k, ' : ARRAY[0..', n, '] OF ST_', k, '; END_TYPE')",
    "'VAR_GLOBAL CONSTANT'",
    "concat('  g_', k, ',')",
    "concat('  h_', k, ' : INT := 1;')",
    "'END_VAR'",
    "concat('INTERFACE I_', k, ' EXTENDS I_', b, ', lib.I_X')",
    "'METHOD Start : BOOL'",
    "'END_METHOD'",
    "'END_INTERFACE'",
    "concat('FUNCTION_BLOCK FBX_', k, ' EXTENDS FBX_', b)",
    "concat('  IMPLEMENTS lib.I_X, I_', k, ', I_', c)",
    "'VAR_INPUT (* several on a line *) u : INT; v : LREAL := 0.5; END_VAR'",
    "concat('VAR_IN_OUT io : ST_', k, '; END_VAR')",
    "'VAR_OUTPUT done,'",
    "'  failed : BOOL := TRUE; mode // wrapped'",
    "concat('  : E_', k, '; last : STRING := ', chr(39), 'x;y : z', chr(39), '; END_VAR')",
    "'VAR_TEMP t : REAL; END_VAR'",
    "'VAR_EXTERNAL x : DINT; END_VAR'",
    "'VAR_CONSTANT limit_ : INT := 5; END_VAR'",
    "'VAR'",
    "concat('  inst : FBX_', b, ';')",
    "concat('  p AT %IX0.0 : POINTER TO ST_', k, ';')",
    "'END_VAR'",
    "'METHOD PUBLIC Run : BOOL'",
    "'VAR_INPUT w : INT; END_VAR'",
    "concat('  FBX_', c, '(u := w); ABS(w); INT_TO_REAL(w);')",
    "'END_METHOD'",
    "'inst(u := 1); TON(IN := TRUE);'",
    "'CASE mode OF'",
    "concat('  Off_', k, ': mode := On; 7: mode := Hold;')",
    "'  On, Hold: // both'",
    "concat('    IF done THEN mode := Off_', k, '; END_IF')",
    "'END_CASE'",
    "'END_FUNCTION_BLOCK'",
    "concat('PROGRAM PRGX_', k, ' FBX_', k, '(); END_PROGRAM')",
)

VIEWS = {
    "plant": f"""
SELECT k, b, c, n, concat('lib/x', k, '.st') AS path, concat_ws(chr(10), {", ".join(PLANT)}) AS content FROM (
 SELECT p_partkey AS k, CAST(floor(p_partkey / 2.0) AS BIGINT) AS b, CAST(floor(p_partkey / 3.0) AS BIGINT) AS c,
  p_size AS n FROM part) x""",
    "pous": """
SELECT concat('pou:', p_partkey) AS id,
 concat('FB_', CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 1 ELSE p_partkey END) AS name,
 CASE p_type WHEN 'ECONOMY' THEN 'PROGRAM' WHEN 'SMALL' THEN 'METHOD' WHEN 'LARGE' THEN 'FUNCTION'
  ELSE 'FUNCTION_BLOCK' END AS pou_type,
 concat('src/f', p_size, '.st') AS file_path, CAST(p_partkey % 997 + 1 AS INT) AS start_line,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey % 997 + 1 + p_size AS INT) END AS end_line
FROM part""",
    "variables": """
SELECT concat('var:', l_partkey, ':v', l_linenumber) AS id, concat('pou:', l_partkey) AS pou_id,
 concat('v', l_linenumber) AS name,
 CASE l_linenumber % 5 WHEN 1 THEN 'VAR_INPUT' WHEN 2 THEN 'VAR_OUTPUT' WHEN 3 THEN 'VAR_IN_OUT'
  WHEN 4 THEN 'VAR' ELSE 'VAR_TEMP' END AS direction,
 CASE WHEN l_linenumber = 7 THEN concat('FB_', min(l_suppkey)) ELSE concat('T_', min(l_suppkey) % 3) END AS var_type,
 CAST(min(l_orderkey) % 500 AS INT) AS start_line
FROM lineitem WHERE l_quantity < 10 GROUP BY l_partkey, l_linenumber""",
    "wide_variables": """
SELECT DISTINCT concat('var:', p.p_partkey, ':', l.l_linenumber, ':', l.l_suppkey) AS id, concat('pou:', p.p_partkey) AS pou_id,
 concat('v', l.l_linenumber) AS name, concat('FB_', l.l_suppkey) AS var_type,
 CASE l.l_linenumber % 4 WHEN 0 THEN 'VAR_INPUT' WHEN 1 THEN 'VAR_OUTPUT' WHEN 2 THEN 'VAR_IN_OUT' ELSE 'VAR' END AS direction
FROM part p JOIN (SELECT * FROM lineitem) l ON l.l_partkey = p.p_partkey - p.p_partkey % 5
WHERE p.p_partkey % 5 < 2 OR (l.l_orderkey + p.p_partkey) % 11 > 0""",
    "types": """
SELECT concat('type:', s_suppkey) AS id, concat('ST_', s_suppkey) AS name,
 CASE s_nationkey % 3 WHEN 0 THEN 'STRUCT' WHEN 1 THEN 'ENUM' ELSE 'TYPE' END AS type_kind,
 concat('src/f', s_nationkey + 1, '.st') AS file_path, CAST(s_suppkey % 100 + 1 AS INT) AS start_line,
 CASE WHEN s_nationkey % 3 = 0 THEN concat('{"kind":"struct","fields":[{"name":"b","type":"INT"},{"name":"a","type":"T_',
  s_nationkey, '"},{"name":"c","type":"REAL"}]}') END AS definition
FROM supplier""",
    "fields": """
SELECT concat('field:', s_suppkey, ':', name) AS id, concat('type:', s_suppkey) AS parent_type_id, name, field_type,
 CAST(s_suppkey % 100 + k AS INT) AS start_line, concat('src/f', s_nationkey + 1, '.st') AS file_path FROM (
 SELECT s_suppkey, s_nationkey, 'b' AS name, 'INT' AS field_type, 2 AS k FROM supplier
 UNION ALL SELECT s_suppkey, s_nationkey, 'a', concat('T_', s_nationkey), 3 FROM supplier
 UNION ALL SELECT s_suppkey, s_nationkey, 'c', 'REAL', 4 FROM supplier) f WHERE s_nationkey % 3 = 0""",
    "variable_lists": """
SELECT concat('list:', p_partkey) AS id, concat('src/f', p_size, '.st') AS file_path,
 concat('GVL_', p_partkey) AS name, CASE WHEN p_partkey % 80 = 0 THEN 'VAR_EXTERNAL' ELSE 'VAR_GLOBAL' END AS direction,
 CAST(p_partkey % 997 + 1 AS INT) AS start_line FROM part WHERE p_partkey % 16 = 0""",
    "relationships": """
SELECT concat(type, ':', from_id, '>', to_id) AS id, from_id, to_id, type FROM (
 SELECT concat('pou:', p_partkey) AS from_id, concat('pou:', CAST(floor(p_partkey / 2.0) AS BIGINT)) AS to_id,
  'CALLS' AS type FROM part WHERE p_partkey > 0
 UNION ALL SELECT concat('pou:', p_partkey), concat('pou:', 2 * p_partkey + 1), 'CALLS' FROM part
  WHERE p_partkey % 10 = 3 AND 2 * p_partkey + 1 < (SELECT count(*) FROM part)
 UNION ALL SELECT concat('pou:', p_partkey), concat('pou:', CAST(floor(p_partkey / 10.0) AS BIGINT)), 'EXTENDS'
  FROM part WHERE p_partkey > 0 AND p_partkey % 3 = 0
 UNION ALL SELECT concat('pou:', p_partkey), concat('type:', p_partkey % (SELECT count(*) FROM supplier)), 'IMPLEMENTS'
  FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT concat('pou:', p_partkey), concat('pou:', p_partkey + 1), 'CONTAINS' FROM part WHERE p_partkey % 20 = 0
 UNION ALL SELECT DISTINCT concat('pou:', l_partkey), concat('type:', l_suppkey), 'USES' FROM lineitem
  WHERE l_quantity = 1) e""",
    "files": """
SELECT path, sha_src AS hash, last_indexed, pou_count FROM (
 SELECT file_path AS path, md5(file_path) AS sha_src, 1700000000000 + count(*) * 3600000 AS last_indexed,
  count(*) AS pou_count FROM pous GROUP BY file_path) f""",
    "diagnostics": """
SELECT concat('diag:', event_id) AS id, concat('src/f', user_id % 50 + 1, '.st') AS file_path,
 CAST(event_id % 1000 + 1 AS INT) AS line, CAST(event_id % 4 + 1 AS INT) AS severity, concat('E', user_id % 10) AS code,
 concat('message ', event_id % 25) AS message FROM events WHERE event_type = 'error'""",
    "telemetry": """
SELECT event_id AS id, ts, concat('c', CAST(floor(event_id / 2.0) AS BIGINT)) AS call_id, user_id AS workspace,
 CASE event_type WHEN 'signup' THEN 'index_started' WHEN 'purchase' THEN 'index_done'
  WHEN 'error' THEN 'index_file_failed' WHEN 'click' THEN 'index_file_done' ELSE 'lsp_progress' END AS kind,
 CASE WHEN event_type IN ('click','view') THEN 'tool_started' WHEN event_type = 'error' THEN 'tool_failed'
  ELSE 'tool_completed' END AS tool_kind, value, props FROM events""",
    "event_log": """
SELECT event_id AS id, ts,
 CASE event_type WHEN 'signup' THEN 'index_started'
  WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'index_completed' ELSE 'index_done' END
  WHEN 'error' THEN 'index_file_failed' WHEN 'click' THEN 'index_file_done'
  ELSE CASE WHEN event_id % 5 = 0 THEN 'sqlite_stats' WHEN event_id % 7 = 0 THEN 'ws_client_connected'
   ELSE 'lsp_progress' END END AS kind,
 concat('w', user_id) AS workspace, concat('src/f', user_id % 50 + 1, '.st') AS file,
 CAST(floor(value) AS INT) AS entities, CAST(floor(value) AS INT) % 7 AS edges, CAST(floor(value) AS BIGINT) AS durationMs,
 CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS INT) % 100 END AS totalFiles,
 CASE WHEN event_id % 4 < 2 THEN CAST(floor(value) AS INT) % 50 END AS indexedFiles,
 CASE WHEN event_id % 5 < 3 THEN CAST(floor(value) AS INT) % 10 END AS skippedFiles,
 CASE WHEN event_id % 6 < 4 THEN CAST(floor(value) AS INT) END AS totalEntities,
 CASE WHEN event_id % 7 < 4 THEN CAST(floor(value) AS INT) END AS totalEdges,
 CASE WHEN event_id % 8 < 6 THEN CAST(floor(value) AS BIGINT) END AS totalTimeMs, CAST(event_id % 1000 AS BIGINT) AS duration,
 CASE event_id % 11 WHEN 0 THEN 'preparing' WHEN 1 THEN 'lsp_open' WHEN 2 THEN 'parsing' WHEN 3 THEN 'extracting'
  WHEN 4 THEN 'building_edges' WHEN 5 THEN 'resolving' WHEN 6 THEN 'persisting' WHEN 7 THEN 'cleanup'
  WHEN 8 THEN 'done' END AS stage,
 CAST(event_id % 100 AS INT) AS pous, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 90 AS INT) END AS variables,
 CAST(event_id % 80 AS INT) AS types, CAST(event_id % 70 AS INT) AS relationships,
 CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 60 AS INT) END AS files, event_id AS dbBytes FROM events""",
    "call_log": """
SELECT event_id AS id, ts,
 CASE WHEN event_type IN ('click','view') THEN 'tool_started' WHEN event_type = 'error' THEN 'tool_failed'
  ELSE 'tool_completed' END AS kind,
 concat('c', CAST(floor(event_id / 3.0) AS BIGINT)) AS callId,
 CASE WHEN event_id % 17 > 0 THEN concat('t', user_id % 5) END AS tool,
 CASE WHEN event_id % 2 = 0 THEN props END AS argsPreview,
 CASE WHEN event_id % 6 > 0 THEN CAST(floor(value) AS BIGINT) END AS durationMs,
 CASE WHEN event_id % 5 > 0 THEN props END AS error FROM events""",
    "corpus": """
SELECT p.id, concat('src/p', substr(p.id, 5), '.st') AS path,
 concat('// unit ', p.name, chr(10), 'FUNCTION_BLOCK ', p.name,
  CASE WHEN e.base IS NULL THEN '' ELSE concat(' EXTENDS FB_', e.base) END, chr(10), coalesce(v.body, ''),
  coalesce(c.body, ''), 'END_FUNCTION_BLOCK', chr(10)) AS content
FROM pous p
LEFT JOIN (SELECT from_id, substr(min(to_id), 5) AS base FROM relationships WHERE type = 'EXTENDS' GROUP BY from_id) e
 ON e.from_id = p.id
LEFT JOIN (SELECT pou_id, string_agg(concat(direction, chr(10), '  ', name, ' : ', var_type, ' := 0; (* ', name, ' *)',
  chr(10), 'END_VAR', chr(10)), '') WITHIN GROUP (ORDER BY name) AS body FROM variables GROUP BY pou_id) v
 ON v.pou_id = p.id
LEFT JOIN (SELECT from_id, string_agg(concat('  FB_', substr(to_id, 5), '(x := 1); // call', chr(10)), '')
  WITHIN GROUP (ORDER BY to_id) AS body FROM relationships WHERE type = 'CALLS' GROUP BY from_id) c
 ON c.from_id = p.id""",
}

# The log as jobs write it: only starts and ends of runs name their workspace.
VIEWS["bare_log"] = VIEWS["event_log"].replace(
    "concat('w', user_id) AS workspace", "CASE WHEN event_type IN ('signup', 'purchase') THEN concat('w', user_id) END AS workspace"
)

# Rows without their unit, type or end, besides all rows of a view; both engines run these texts.
DANGLING = {
    "variables": """
SELECT concat('gone:', id) AS id, concat('gone:', pou_id) AS pou_id, name, direction, var_type, start_line
 FROM variables WHERE start_line % 9 = 0""",
    "fields": """
SELECT concat('gone:', id) AS id, concat('gone:', parent_type_id) AS parent_type_id, name, field_type, start_line, file_path
 FROM fields WHERE start_line % 11 = 0""",
    "relationships": """
SELECT concat('gone:', id) AS id, CASE WHEN type = 'CALLS' THEN from_id ELSE concat('gone:', from_id) END AS from_id,
 concat('gone:', to_id) AS to_id, type FROM relationships WHERE from_id LIKE '%5'""",
}

# Views that read other views.
_NEEDS = {"files": ("pous",), "corpus": ("pous", "variables", "relationships")}


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(BASE_TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **tables: DataFrame) -> DataFrame:
    """One view as a DataFrame, over other ``tables`` if given; nothing is registered in the session's catalog by name."""
    text = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in _NEEDS.get(name, ())) if name in _NEEDS else ""
    text = f"{text} SELECT * FROM ({VIEWS[name]}) AS view"
    # spark.sql takes the base tables as named arguments: "FROM part" becomes "FROM {part}"
    text = text.replace("{", "{{").replace("}", "}}")
    used = {t: tables[t] if t in tables else base(spark, sf_dir, t) for t in BASE_TABLES if f"FROM {t}" in text}
    for table in used:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(text, **used)


def file_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks of some ``FILES_PER_TASK`` files each, for texts of which there is one a row of ``part``."""
    return max(spark.sparkContext.defaultParallelism, -(-base(spark, sf_dir, "part").count() // FILES_PER_TASK))


def dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` dealt to tasks before texts are made of it: its scan is small, and one task whatever the texts weigh."""
    return base(spark, sf_dir, "part").repartition(file_tasks(spark, sf_dir), "p_partkey")


def spread(spark: SparkSession, sf_dir: str, texts: DataFrame) -> DataFrame:
    """Texts that come out of joins, dealt by path to tasks."""
    return texts.select("path", "content").repartition(file_tasks(spark, sf_dir), "path")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    names = ("pous", "variables", "variable_lists", "types", "fields", "relationships", "files", "diagnostics")
    return Graph(spark, **{name: partial(view, spark, sf_dir, name) for name in names})


def dangling(graph: Graph) -> Graph:
    """The whole graph and the rows of ``DANGLING``."""
    more = {}
    for name, text in DANGLING.items():
        rows = getattr(graph, name)
        more[name] = rows.unionByName(graph.spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=rows), allowMissingColumns=True)
    return graph.with_tables(**more)


def with_dangling(body: str) -> str:
    """An oracle's body (``WITH ...``) that reads the tables of :func:`dangling` instead of the views."""
    for name in DANGLING:
        body = body.replace(f"FROM {name} ", f"FROM all_{name} ")
    clauses = [f"all_{name} AS (SELECT * FROM {name} UNION ALL BY NAME ({text}))" for name, text in DANGLING.items()]
    return _join_with(clauses, body)


def oracle(body: str, *views: str) -> str:
    """``body`` with the views it names in front, in DuckDB's spelling."""
    wanted: list[str] = []
    for name in views:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in wanted:
                wanted.append(needed)
    clauses = [f"{n} AS ({_duckdb(VIEWS[n])})" for n in wanted]
    return _join_with(clauses, body)


def _join_with(clauses: list[str], body: str) -> str:
    """Put the view clauses in front of a body that may have WITH clauses of its own."""
    text = body.strip()
    upper = text.upper()
    if upper.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(clauses) + ", " + text[len("WITH RECURSIVE ") :]
    if upper.startswith("WITH "):
        return "WITH " + ", ".join(clauses) + ", " + text[len("WITH ") :]
    return "WITH " + ", ".join(clauses) + " " + text


def _duckdb(text: str) -> str:
    return (
        text.replace("'') WITHIN GROUP (ORDER BY name)", "'' ORDER BY name)")
        .replace("'')\n  WITHIN GROUP (ORDER BY to_id)", "'' ORDER BY to_id)")
        .replace("'') WITHIN GROUP (ORDER BY to_id)", "'' ORDER BY to_id)")
    )
