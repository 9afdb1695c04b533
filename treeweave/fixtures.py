"""Index tables derived from the star schema: one SQL text for each, valid in Spark and in DuckDB.

``{name}`` stands for a table or another fixture. Customers are files, orders are symbols, line items are calls.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import cut, shared_dir

EXTENSIONS = [(".ts", "typescript"), (".tsx", "tsx"), (".js", "javascript"), (".py", "python"), (".java", "java"), (".cs", "csharp"), (".go", "go"), (".rs", "rust"), (".h", "c"), (".cpp", "cpp"), (".rb", "ruby"), (".php", "php")]
NAMES = ["parse_", "Load", "get%", "Évaluer", "LOAD_"]


def pick(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def text(key: str) -> str:
    return f"CAST({key} AS VARCHAR(20))"


def name_of(key: str) -> str:
    return f"{pick(key, NAMES)} || {text(f'{key} % 499')}"


FIRST = "file_path, start_line, start_col, end_line DESC, end_col DESC, id"
CALLEE = f"CASE WHEN l_suppkey % 10 = 0 THEN 'ext_' || {text('l_partkey')} ELSE {name_of('l_partkey')} END"

SQL: dict[str, str] = {
    "fx_files": f"""
SELECT 'r' || {text('c_custkey % 3')} AS repo, 'src/m' || {text('c_custkey % 17')} || '/f' || {text('c_custkey')} || {pick('c_custkey', [e for e, _ in EXTENSIONS])} AS file_path,
       c_name AS hash, {pick('c_custkey', [lang for _, lang in EXTENSIONS])} AS language, CAST(1704067200000 + c_custkey * 1000 AS BIGINT) AS last_indexed, COALESCE(n, 0) AS node_count, c_custkey AS fx_key
FROM {{customer}} LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM {{orders}} GROUP BY o_custkey) t ON o_custkey = c_custkey""",
    "fx_nodes": f"""
SELECT f.repo, f.file_path, o_orderkey + 1 AS id, {name_of('o_orderkey')} AS name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'function' WHEN '2-HIGH' THEN 'method' WHEN '3-MEDIUM' THEN 'class' WHEN '4-NOT SPECIFIED' THEN 'import' ELSE 'interface' END AS type,
       'sig ' || {text('o_orderkey')} AS signature, CAST(1 + o_orderkey % 400 AS INT) AS start_line, CAST(1 + o_orderkey % 400 + o_orderkey % 37 AS INT) AS end_line,
       CAST(o_orderkey % 8 AS INT) AS start_col, CAST(1 + o_orderkey % 60 AS INT) AS end_col, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey > 0 THEN o_orderkey ELSE NULL END AS parent_id,
       f.language, 'body ' || o_orderstatus || ' ' || o_orderpriority AS body_text
FROM {{orders}} JOIN {{fx_files}} f ON f.fx_key = o_custkey""",
    "fx_edges": f"""
SELECT n.repo, n.file_path, n.id AS caller_id, CAST(NULL AS BIGINT) AS callee_id, {CALLEE} AS callee_name, CAST(n.start_line + l_linenumber AS INT) AS line
FROM {{lineitem}} JOIN {{fx_nodes}} n ON n.id = l_orderkey + 1""",
    "fx_first": f"""
SELECT repo, name, id FROM (SELECT repo, name, id, ROW_NUMBER() OVER (PARTITION BY repo, name ORDER BY {FIRST}) AS rn FROM {{fx_nodes}}) t WHERE rn = 1""",
    "fx_resolved": """
SELECT e.repo, e.file_path, e.caller_id, COALESCE(e.callee_id, d.id) AS callee_id, e.callee_name, e.line
FROM {fx_edges} e LEFT JOIN {fx_first} d ON d.repo = e.repo AND d.name = e.callee_name""",
    "fx_comments": """
SELECT repo, id AS node_id, 'doc for ' || name AS text, 'original' AS source, CAST(NULL AS BIGINT) AS generated_at FROM {fx_nodes} WHERE id % 3 = 0
UNION ALL
SELECT repo, id AS node_id, 'made for ' || name AS text, 'generated' AS source, CAST(1704067200000 + id AS BIGINT) AS generated_at FROM {fx_nodes} WHERE id % 4 = 0""",
    "fx_events": f"""
SELECT 'r0' AS repo, 'src/u' || {text('user_id')} || {pick('user_id', ['.py', '.ts', '.PY', '.txt'])} AS file_path,
       CASE event_type WHEN 'error' THEN 'unlink' WHEN 'signup' THEN 'add' ELSE 'change' END AS kind, ts, event_id AS seq FROM {{events}}""",
    # requests
    "rq_names": """
SELECT DISTINCT repo, callee_name AS name FROM {fx_edges} UNION ALL SELECT 'r0' AS repo, 'nowhere' AS name""",
    "rq_ids": """
SELECT DISTINCT repo, callee_id AS id FROM {fx_resolved} WHERE callee_id IS NOT NULL""",
    "rq_paths": """
SELECT repo, CASE WHEN fx_key % 2 = 0 THEN replace(file_path, '/', chr(92)) ELSE file_path END AS file_path FROM {fx_files} UNION ALL SELECT 'r0' AS repo, 'src/nowhere.ts' AS file_path""",
    "rq_search": """
SELECT repo, query, type, CAST(n AS INT) AS "limit" FROM (SELECT DISTINCT repo FROM {fx_files}) r CROSS JOIN (
  SELECT 'load_' AS query, CAST(NULL AS VARCHAR(20)) AS type, 20 AS n UNION ALL SELECT 'get%', 'class', 5 UNION ALL SELECT 'éval', NULL, 20 UNION ALL SELECT 'Éval', NULL, 20 UNION ALL SELECT chr(92), NULL, 20) q""",
    # files that changed: every file whose key leaves 1 by 3 has another hash now, and as many new ones come
    "fx_sources": f"""
SELECT repo, file_path, CASE WHEN fx_key % 3 = 1 THEN 'new text of ' || hash ELSE hash END AS source FROM {{fx_files}}
UNION ALL SELECT repo, 'new/' || file_path AS file_path, hash AS source FROM {{fx_files}} WHERE fx_key % 3 = 1""",
    # syntax trees
    "fx_calls": f"""
SELECT l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, {CALLEE} AS callee, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS member,
       COALESCE(SUM(CASE WHEN l_suppkey % 3 = 0 THEN 3 ELSE 2 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
       CASE WHEN l_suppkey % 3 = 0 THEN 3 ELSE 2 END AS size
FROM {{lineitem}}""",
    "fx_decls": f"""
SELECT f.repo, f.file_path, f.language, f.fx_key, k, w, p, size, ordinal, CAST(1 + 2 * w + before AS BIGINT) AS node_id,
       CASE k % 5 WHEN 0 THEN 'function_definition' WHEN 1 THEN 'class_declaration' WHEN 2 THEN 'import_statement' WHEN 3 THEN 'export_statement' ELSE 'arrow_function' END AS kind,
       CASE k % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'name' WHEN 2 THEN 'source' WHEN 3 THEN CASE WHEN k % 2 = 1 THEN 'declaration' ELSE 'other' END ELSE 'parameter' END AS field,
       CASE k % 5 WHEN 0 THEN 'f' || {text('k')} WHEN 1 THEN 'C' || {text('k')} WHEN 2 THEN '''lib' || {text('k')} || '''' ELSE 'x' END AS child,
       CASE WHEN k % 11 = 0 THEN 'decl ' || {text('k')} || ' ' || repeat('x', 250) WHEN k % 13 = 0 THEN '  def' || {text('k')} || '(a) ' || chr(123) || ' ' || repeat('y', 2100) || chr(125)
            WHEN k % 3 = 0 THEN 'go' || {text('k')} || '(a, b) -> c' ELSE 'decl ' || {text('k')} || ' ' || chr(123) || ' return ' || {text('k')} || '; ' || chr(125) END AS text
FROM (SELECT o_custkey, o_orderkey AS k, 1 - o_custkey % 2 AS w, (1 - o_custkey % 2) AS p, size,
             COALESCE(SUM(size) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal
      FROM (SELECT o_custkey, o_orderkey, 2 + COALESCE(n, 0) AS size FROM {{orders}} LEFT JOIN (SELECT l_orderkey, SUM(size) AS n FROM {{fx_calls}} GROUP BY l_orderkey) s ON l_orderkey = o_orderkey) o) d
JOIN {{fx_files}} f ON f.fx_key = o_custkey""",
    "fx_syntax": """
SELECT repo, file_path, language, CAST(0 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent_node_id, 0 AS child_index, 'program' AS kind, CAST(NULL AS VARCHAR(20)) AS field,
       0 AS start_row, 0 AS start_col, 9999 AS end_row, 0 AS end_col, CAST(999999999 AS BIGINT) AS last_desc, 'file' AS text FROM {fx_files}
UNION ALL
SELECT repo, file_path, language, 1, 0, 0, 'class_declaration', NULL, 0, 0, 9998, 0, 999999999, 'class W' FROM {fx_files} WHERE fx_key % 2 = 0
UNION ALL
SELECT repo, file_path, language, 2, 1, 0, 'identifier', 'name', 0, 6, 0, 9, 2, 'W' || CAST(fx_key AS VARCHAR(20)) FROM {fx_files} WHERE fx_key % 2 = 0
UNION ALL
SELECT repo, file_path, language, node_id, p, CAST(ordinal AS INT), kind, NULL, CAST(20 * ordinal AS INT), 2, CAST(20 * ordinal + 19 AS INT), 1, CAST(node_id + size - 1 AS BIGINT), text FROM {fx_decls}
UNION ALL
SELECT repo, file_path, language, node_id + 1, node_id, 0, 'identifier', field, CAST(20 * ordinal AS INT), 4, CAST(20 * ordinal AS INT), 8, node_id + 1, child FROM {fx_decls}
UNION ALL
SELECT repo, file_path, language, CAST(node_id + 2 + before AS BIGINT), node_id, CAST(i AS INT), 'call_expression', NULL, CAST(20 * ordinal + i AS INT), 4, CAST(20 * ordinal + i AS INT), 40, CAST(node_id + 1 + before + c.size AS BIGINT), callee || '()'
FROM {fx_decls} d JOIN {fx_calls} c ON l_orderkey = k
UNION ALL
SELECT repo, file_path, language, CAST(node_id + 3 + before AS BIGINT), CAST(node_id + 2 + before AS BIGINT), 0, CASE member WHEN 1 THEN 'member_expression' ELSE 'identifier' END, 'function', CAST(20 * ordinal + i AS INT), 4, CAST(20 * ordinal + i AS INT), 30,
       CAST(node_id + 3 + before + member AS BIGINT), CASE member WHEN 1 THEN 'obj.' || callee ELSE callee END FROM {fx_decls} d JOIN {fx_calls} c ON l_orderkey = k
UNION ALL
SELECT repo, file_path, language, CAST(node_id + 4 + before AS BIGINT), CAST(node_id + 3 + before AS BIGINT), 0, 'property_identifier', 'property', CAST(20 * ordinal + i AS INT), 8, CAST(20 * ordinal + i AS INT), 30, CAST(node_id + 4 + before AS BIGINT), callee
FROM {fx_decls} d JOIN {fx_calls} c ON l_orderkey = k WHERE member = 1""",
    # source text: for each order a comment line or none, a blank line or none, a header and its calls
    "fx_pieces": """
SELECT f.repo, f.file_path, f.language, o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END AS noted, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS blank, COALESCE(n, 0) AS n,
       COALESCE(SUM(CASE WHEN o_orderkey % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + 2 + COALESCE(n, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM {orders} JOIN {fx_files} f ON f.fx_key = o_custkey LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM {lineitem} GROUP BY l_orderkey) t ON l_orderkey = o_orderkey""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Fixtures that many queries start from: written once for a folder of tables in an application, then read.
WRITTEN = ("fx_files", "fx_nodes", "fx_edges", "fx_first", "fx_resolved", "fx_comments", "fx_calls", "fx_decls", "fx_syntax", "fx_pieces")
_PLACES: dict[tuple[str, str, str, str], DataFrame] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or fixture as a DataFrame."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    place = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, name)
    if place not in _PLACES:
        text_ = SQL[name].replace('"limit"', "`limit`")
        found = spark.sql(text_, **{n: frame(spark, sf_dir, n) for n in needs(text_)})
        if name not in WRITTEN:
            return found
        _PLACES[place] = cut(found, name)
    return _PLACES[place]


def duck(sql: str) -> str:
    """A query over ``{name}`` with the fixtures it needs as common table expressions, for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in SQL and name not in order:
            for n in needs(SQL[name]):
                visit(n)
            order.append(name)

    for n in needs(sql):
        visit(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = ", ".join(f"{n} AS ({plain(SQL[n])})" for n in order)
    body = plain(sql).strip()
    if not order:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
