"""Registered queries of the library's own operators, each with the SQL that states its result.

All read the given tables, whole, through the fixtures' derivations. Nullable numbers are returned as text and lists as joined
text, so that results compare value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CALLEE, FIRST, duck, frame
from .functions.text import extension
from .jobs import indexing
from .operators import comments, describe, extract, graph, lookup, maintain, reports
from .schemas import COMMENTS, EDGES, FILES, NODES, Index
from .sources import files as source_files
from .sources.parse import parse_sources
from .streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = duck(sql)
        return f

    return add


def index_of(spark: SparkSession, d: str, resolved: bool = True) -> Index:
    return Index(frame(spark, d, "fx_files").drop("fx_key"), frame(spark, d, "fx_nodes"), frame(spark, d, "fx_resolved" if resolved else "fx_edges"), frame(spark, d, "fx_comments"))


def string(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def joined(list_: str, *fields: str) -> Column:
    """A list of structs as text: fields by colons, elements by semicolons; empty for null."""
    return F.coalesce(F.array_join(F.transform(F.col(list_), lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ";"), F.lit("")).alias(list_)


# --- sources ---

EXT = "lower(regexp_extract(file_path, '[^/](\\.[^./]*)$', 1))"
LANG = "CASE " + " ".join(f"WHEN {EXT} IN ({', '.join(repr(e) for e in exts)}) THEN '{lang}'" for lang, exts in source_files.LANGUAGE_EXTENSIONS.items()) + " END"


@query(f"SELECT repo, {LANG} AS language, COUNT(*) AS n FROM {{fx_sources}} GROUP BY repo, {LANG}")
def language_counts(spark, d):
    return frame(spark, d, "fx_sources").groupBy("repo", source_files.language_of(F.col("file_path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


MESSY = """
SELECT repo, CASE fx_key % 9 WHEN 0 THEN 'node_modules/' || file_path WHEN 1 THEN file_path WHEN 2 THEN '.hid/' || file_path WHEN 3 THEN 'a/dist' WHEN 4 THEN upper(file_path)
       WHEN 5 THEN 'build.ts/' || file_path WHEN 6 THEN repeat('d/', 15 + CAST(fx_key % 11 AS INT)) || file_path WHEN 7 THEN 'x/.env.ts' ELSE 'venv/y.py' END AS file_path FROM {fx_files}"""


def messy_paths(spark, d):
    return spark.sql(MESSY, fx_files=frame(spark, d, "fx_files"))


ENABLED = ", ".join(repr(e) for lang in source_files.DEFAULT_LANGUAGES for e in source_files.LANGUAGE_EXTENSIONS[lang])
IGNORED = "|".join(n.replace(".", "\\.") for n in source_files.DEFAULT_IGNORED)


@query(
    f"SELECT repo, file_path FROM ({MESSY}) p WHERE NOT regexp_matches('/' || file_path || '/', '/({IGNORED})/') AND NOT regexp_matches('/' || file_path, '/\\.') AND length(file_path) - length(replace(file_path, '/', '')) <= 20 AND regexp_extract(file_path, '[^/](\\.[^./]*)$', 1) IN ({ENABLED})"
)
def kept_paths(spark, d):
    return messy_paths(spark, d).filter(source_files.keep_path(F.col("file_path")))


IGNORE_LINES = """
SELECT repo, fx_key AS line_no, CASE fx_key % 7 WHEN 0 THEN '# note' WHEN 1 THEN '  m' || CAST(fx_key % 5 AS VARCHAR(20)) || '  ' WHEN 2 THEN '' WHEN 3 THEN '!kept' WHEN 4 THEN '*.php' WHEN 5 THEN 'src/m1*/**' ELSE 'dist' END AS line FROM {fx_files}"""
PATTERNS = f"""
SELECT repo, pattern, MIN(place) AS place FROM (
  SELECT repo, trim(line) AS pattern, CAST(line_no AS BIGINT) AS place FROM ({IGNORE_LINES}) l WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%' AND trim(line) NOT LIKE '!%'
  UNION ALL SELECT DISTINCT repo, 'dist' AS pattern, CAST(-2 AS BIGINT) AS place FROM {{fx_files}} UNION ALL SELECT DISTINCT repo, 'out' AS pattern, CAST(-1 AS BIGINT) AS place FROM {{fx_files}}) u GROUP BY repo, pattern"""


@query(PATTERNS)
def ignore_patterns(spark, d):
    return source_files.ignore_patterns(spark.sql(IGNORE_LINES, fx_files=frame(spark, d, "fx_files")), ["dist", "out"])


@query(
    f"""WITH pats AS ({PATTERNS}) SELECT DISTINCT f.repo, f.file_path FROM {{fx_files}} f WHERE NOT EXISTS (SELECT 1 FROM pats p WHERE p.repo = f.repo AND
CASE WHEN strpos(pattern, '*') = 0 AND strpos(pattern, '/') = 0 THEN strpos('/' || file_path || '/', '/' || pattern || '/') > 0
     WHEN pattern = '*.php' THEN regexp_matches(file_path, '^[^/]*\\.php$') ELSE regexp_matches(file_path, '^src/m1[^/]*(/.*)?$') END)"""
)
def watch_ignored_paths(spark, d):
    f = frame(spark, d, "fx_files")
    return source_files.watch_kept(f.select("repo", "file_path"), ignore_patterns(spark, d))


# --- extraction ---


@query("SELECT s.repo, s.file_path, sha256(s.source) AS hash FROM {fx_sources} s LEFT JOIN {fx_files} f ON f.repo = s.repo AND f.file_path = s.file_path WHERE f.file_path IS NULL OR sha256(f.hash) <> sha256(s.source)")
def changed_files(spark, d):
    known = frame(spark, d, "fx_files").withColumn("hash", F.sha2("hash", 256))
    return maintain.changed_files(frame(spark, d, "fx_sources"), known).select("repo", "file_path", "hash")


@query(
    "SELECT repo, kind, CASE kind WHEN 'function_definition' THEN 'function' WHEN 'arrow_function' THEN 'function' WHEN 'class_declaration' THEN 'class' WHEN 'import_statement' THEN 'import' WHEN 'export_statement' THEN 'export' END AS type, COUNT(*) AS n FROM {fx_syntax} GROUP BY repo, kind"
)
def classify_kinds(spark, d):
    return frame(spark, d, "fx_syntax").groupBy("repo", "kind", extract.classify(F.col("kind")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


WRAPPERS = "SELECT repo, file_path, CAST(1 AS BIGINT) AS node_id, fx_key FROM {fx_files} WHERE fx_key % 2 = 0"
KEY = "CAST(k AS VARCHAR(20))"


@query(
    f"""SELECT repo, file_path, node_id, CASE k % 5 WHEN 0 THEN 'f' || {KEY} WHEN 1 THEN 'C' || {KEY} WHEN 2 THEN 'lib' || {KEY} WHEN 3 THEN CASE WHEN k % 2 = 1 THEN '<anonymous>' ELSE '<export>' END
  ELSE CASE WHEN fx_key % 2 = 0 THEN 'W' || CAST(fx_key AS VARCHAR(20)) ELSE '<anonymous>' END END AS name FROM {{fx_decls}} UNION ALL SELECT repo, file_path, node_id, 'W' || CAST(fx_key AS VARCHAR(20)) FROM ({WRAPPERS}) w"""
)
def symbol_names(spark, d):
    return extract.symbol_names(frame(spark, d, "fx_syntax")).select("repo", "file_path", "node_id", "name")


HEAD = "CASE WHEN strpos(text, chr(123)) > 1 THEN substr(text, 1, strpos(text, chr(123)) - 1) WHEN strpos(text, ')') > 1 THEN substr(text, 1, strpos(text, ')')) ELSE text END"


@query(f"SELECT repo, file_path, node_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END AS signature FROM (SELECT repo, file_path, node_id, trim({HEAD}) AS s FROM {{fx_decls}}) t")
def symbol_signatures(spark, d):
    return frame(spark, d, "fx_decls").select("repo", "file_path", "node_id", extract.symbol_signature(F.col("text")).alias("signature"))


@query("SELECT repo, file_path, node_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS body_text FROM {fx_decls}")
def symbol_bodies(spark, d):
    return frame(spark, d, "fx_decls").select("repo", "file_path", "node_id", extract.symbol_body(F.col("text")).alias("body_text"))


TYPE = "CASE k % 5 WHEN 1 THEN 'class' WHEN 2 THEN 'import' WHEN 3 THEN 'export' ELSE CASE WHEN fx_key % 2 = 0 THEN 'method' ELSE 'function' END END"


@query(f"SELECT repo, file_path, node_id, {TYPE} AS type FROM {{fx_decls}} UNION ALL SELECT repo, file_path, node_id, 'class' FROM ({WRAPPERS}) w")
def method_typing(spark, d):
    return extract.symbol_types(frame(spark, d, "fx_syntax")).select("repo", "file_path", "node_id", "type")


@query("SELECT repo, file_path, node_id AS caller, callee AS callee_name, CAST(20 * ordinal + i + 1 AS INT) AS line FROM {fx_decls} JOIN {fx_calls} ON l_orderkey = k WHERE k % 5 IN (0, 4)")
def extracted_edges(spark, d):
    syntax = frame(spark, d, "fx_syntax")
    hashes = frame(spark, d, "fx_files").select("repo", "file_path", "hash")
    nodes = extract.symbols(syntax, hashes)
    edges = extract.call_edges(syntax, nodes)
    return edges.join(nodes.select("repo", F.col("id").alias("caller_id"), F.col("node_id").alias("caller")), ["repo", "caller_id"]).select("repo", "file_path", "caller", "callee_name", "line")


def source_texts(spark, d):
    """Each file's text out of its pieces: a comment, a blank line, a header and calls for each order."""
    pieces = frame(spark, d, "fx_pieces")
    mark = F.when(F.col("language") == "python", "#").otherwise("//")
    lines = F.concat(
        F.when(F.col("noted") == 1, F.concat(mark, F.lit(" note "), F.col("k").cast("string"), F.lit("\n"))).otherwise(""),
        F.when(F.col("blank") == 1, "\n").otherwise(""),
        F.lit("def h"),
        F.col("k").cast("string"),
        F.lit("():\n    'doc'\n"),
        F.repeat(F.lit("    call()\n"), F.col("n").cast("int")),
    )
    chunks = pieces.groupBy("repo", "file_path").agg(F.array_sort(F.collect_list(F.struct("k", lines.alias("x")))).alias("c"))
    return chunks.select("repo", "file_path", F.array_join(F.transform("c", lambda c: c["x"]), "").alias("source"))


HEADER = "CAST(before + noted + blank AS INT)"


@query(f"SELECT repo, file_path, {HEADER} AS start_row, CASE WHEN noted = 1 THEN 'note ' || CAST(k AS VARCHAR(20)) END AS preceding FROM {{fx_pieces}}")
def preceding_comments(spark, d):
    places = frame(spark, d, "fx_pieces").select("repo", "file_path", F.expr(HEADER).alias("start_row"))
    return comments.comment_lines(source_texts(spark, d), places).select("repo", "file_path", "start_row", "preceding")


@query(
    "SELECT repo, file_path, 'h' || CAST(k AS VARCHAR(20)) AS name, CAST(before + noted + blank + 1 AS INT) AS start_line, CAST(before + noted + blank + 2 + n AS INT) AS end_line, 'function' AS type FROM {fx_pieces} WHERE language = 'python'"
)
def parse_python_sources(spark, d):
    texts = source_texts(spark, d).withColumn("source", F.replace("source", F.lit("'doc'\n"), F.lit("0\n")))
    syntax = parse_sources(texts.filter(F.col("file_path").endswith(".py")))
    hashes = texts.select("repo", "file_path", F.sha2("source", 256).alias("hash"))
    return extract.symbols(syntax, hashes).select("repo", "file_path", "name", "start_line", "end_line", "type")


@query("SELECT repo, file_path, CAST(before + noted + blank + 1 AS INT) AS line, 'doc' AS docstring FROM {fx_pieces} WHERE language = 'python'")
def docstrings(spark, d):
    texts = source_texts(spark, d).withColumn("source", F.replace("source", F.lit("'doc'"), F.lit('""" doc """')))
    syntax = parse_sources(texts.filter(F.col("file_path").endswith(".py")))
    found = comments.docstrings(syntax).join(syntax.select("repo", "file_path", "node_id", "start_row"), ["repo", "file_path", "node_id"])
    return found.select("repo", "file_path", (F.col("start_row") + 1).alias("line"), "docstring")


@query("SELECT repo, file_path, hash, language, CAST(7 AS BIGINT) AS last_indexed, CAST(node_count AS BIGINT) AS node_count FROM {fx_files}")
def file_records(spark, d):
    return extract.file_records(frame(spark, d, "fx_files"), frame(spark, d, "fx_nodes"), 7)


# --- maintenance ---

CHANGED = "SELECT repo, file_path FROM {fx_files} WHERE language IN ('python', 'go', 'rust')"


def some_changed(spark, d):
    return spark.sql(CHANGED, fx_files=frame(spark, d, "fx_files"))


@query(
    f"""WITH gone AS (SELECT n.repo, n.id FROM {{fx_nodes}} n JOIN ({CHANGED}) c ON c.repo = n.repo AND c.file_path = n.file_path)
SELECT repo, file_path, CAST(caller_id AS VARCHAR) AS caller_id, CAST(CASE WHEN callee_id NOT IN (SELECT id FROM gone) THEN callee_id END AS VARCHAR) AS callee_id, callee_name, line FROM {{fx_resolved}} WHERE caller_id NOT IN (SELECT id FROM gone)"""
)
def replace_file_edges(spark, d):
    index = index_of(spark, d)
    none = Index(index.files.limit(0), index.nodes.limit(0), index.edges.limit(0), index.comments.limit(0))
    edges = maintain.replace_file_rows(index, some_changed(spark, d), none).edges
    return edges.select("repo", "file_path", *string("caller_id", "callee_id"), "callee_name", "line")


@query(
    "SELECT s.repo, s.file_path, s.source AS hash, f.language FROM {fx_sources} s LEFT JOIN {fx_files} f ON f.repo = s.repo AND f.file_path = s.file_path"
)
def upsert_files(spark, d):
    index = index_of(spark, d)
    sources = frame(spark, d, "fx_sources").join(index.files.select("repo", "file_path", "language"), ["repo", "file_path"], "left")
    records = sources.select("repo", "file_path", F.col("source").alias("hash"), "language", F.lit(1).cast("bigint").alias("last_indexed"), F.lit(0).cast("bigint").alias("node_count"))
    return maintain.upsert_files(index.files, records).select("repo", "file_path", "hash", "language")


@query(
    f"""WITH gone AS (SELECT n.repo, n.id FROM {{fx_nodes}} n JOIN ({CHANGED}) c ON c.repo = n.repo AND c.file_path = n.file_path)
SELECT repo, file_path, CAST(caller_id AS VARCHAR) AS caller_id, CAST(callee_id AS VARCHAR) AS callee_id, callee_name, line FROM {{fx_resolved}} WHERE caller_id NOT IN (SELECT id FROM gone) AND (callee_id IS NULL OR callee_id NOT IN (SELECT id FROM gone))"""
)
def delete_files_edges(spark, d):
    edges = maintain.delete_files(index_of(spark, d), some_changed(spark, d)).edges
    return edges.select("repo", "file_path", *string("caller_id", "callee_id"), "callee_name", "line")


def without_changed(spark, d):
    index = index_of(spark, d)
    none = Index(index.files.limit(0), index.nodes.limit(0), index.edges.limit(0), index.comments.limit(0))
    return maintain.replace_file_rows(index, some_changed(spark, d), none)


LEFT_NODES = f"SELECT n.repo, n.file_path, n.id, n.name FROM {{fx_nodes}} n WHERE NOT EXISTS (SELECT 1 FROM ({CHANGED}) c WHERE c.repo = n.repo AND c.file_path = n.file_path)"
LEFT_COMMENTS = f"SELECT c.repo, c.node_id, c.text, c.source FROM {{fx_comments}} c JOIN ({LEFT_NODES}) n ON n.repo = c.repo AND n.id = c.node_id"


@query(LEFT_NODES)
def replace_file_nodes(spark, d):
    return without_changed(spark, d).nodes.select("repo", "file_path", "id", "name")


@query(LEFT_COMMENTS)
def replace_file_comments(spark, d):
    return without_changed(spark, d).comments.select("repo", "node_id", "text", "source")


@query(LEFT_NODES)
def delete_files_nodes(spark, d):
    return maintain.delete_files(index_of(spark, d), some_changed(spark, d)).nodes.select("repo", "file_path", "id", "name")


@query(LEFT_COMMENTS)
def delete_files_comments(spark, d):
    return maintain.delete_files(index_of(spark, d), some_changed(spark, d)).comments.select("repo", "node_id", "text", "source")


@query("SELECT repo, file_path, CAST(caller_id AS VARCHAR) AS caller_id, CAST(callee_id AS VARCHAR) AS callee_id, callee_name, line FROM {fx_resolved}")
def resolve_edges(spark, d):
    index = index_of(spark, d, False)
    return maintain.resolve_edges(index.edges, index.nodes).select("repo", "file_path", *string("caller_id", "callee_id"), "callee_name", "line")


@query(
    f"""WITH near AS (SELECT repo, file_path, name, id FROM (SELECT repo, file_path, name, id, ROW_NUMBER() OVER (PARTITION BY repo, file_path, name ORDER BY {FIRST}) AS rn FROM {{fx_nodes}}) t WHERE rn = 1)
SELECT e.repo, e.file_path, CAST(e.caller_id AS VARCHAR) AS caller_id, CAST(COALESCE(n.id, a.id) AS VARCHAR) AS callee_id, e.callee_name, e.line FROM {{fx_edges}} e
LEFT JOIN near n ON n.repo = e.repo AND n.file_path = e.file_path AND n.name = e.callee_name LEFT JOIN {{fx_first}} a ON a.repo = e.repo AND a.name = e.callee_name"""
)
def resolve_edges_same_file(spark, d):
    index = index_of(spark, d, False)
    return maintain.resolve_edges(index.edges, index.nodes, True).select("repo", "file_path", *string("caller_id", "callee_id"), "callee_name", "line")


@query(
    """SELECT repo, CAST(node_id AS VARCHAR) AS node_id, text, source, CAST(generated_at AS VARCHAR) AS generated_at FROM {fx_comments} WHERE NOT (source = 'generated' AND node_id % 8 = 0)
UNION ALL SELECT repo, CAST(id AS VARCHAR), 'again ' || name, 'generated', '9' FROM {fx_nodes} WHERE id % 8 = 0"""
)
def replace_generated(spark, d):
    new = frame(spark, d, "fx_nodes").filter("id % 8 = 0").select("repo", F.col("id").alias("node_id"), F.concat(F.lit("again "), "name").alias("text"), F.lit(9).cast("bigint").alias("generated_at"))
    return maintain.replace_generated(frame(spark, d, "fx_comments"), new).select("repo", *string("node_id"), "text", "source", *string("generated_at"))


# --- lookups ---


@query("SELECT n.repo, n.id, n.name, n.type FROM {fx_nodes} n JOIN {rq_ids} r ON r.repo = n.repo AND r.id = n.id")
def nodes_by_id(spark, d):
    return lookup.nodes_by_id(frame(spark, d, "fx_nodes"), frame(spark, d, "rq_ids")).select("repo", "id", "name", "type")


@query("SELECT n.repo, n.name, n.id, n.file_path, n.start_line FROM {fx_nodes} n JOIN {rq_names} r ON r.repo = n.repo AND r.name = n.name")
def nodes_by_name(spark, d):
    return lookup.nodes_by_name(frame(spark, d, "fx_nodes"), frame(spark, d, "rq_names")).select("repo", "name", "id", "file_path", "start_line")


@query("SELECT n.repo, n.file_path, n.id, n.name, n.start_line FROM {fx_nodes} n JOIN (SELECT repo, replace(file_path, chr(92), '/') AS file_path FROM {rq_paths}) r ON r.repo = n.repo AND r.file_path = n.file_path")
def nodes_by_file(spark, d):
    return lookup.nodes_by_file(frame(spark, d, "fx_nodes"), frame(spark, d, "rq_paths")).select("repo", "file_path", "id", "name", "start_line")


FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SEARCH = f"""SELECT r.repo, query, r.type AS type_wanted, r."limit", CAST(ROW_NUMBER() OVER (PARTITION BY r.repo, query, r.type, r."limit" ORDER BY {FIRST}) AS INT) AS rank, n.name, n.type, n.file_path, n.start_line, n.end_line, n.signature, n.language, n.id
FROM {{rq_search}} r JOIN {{fx_nodes}} n ON n.repo = r.repo AND {FOLD.format('n.name')} LIKE '%' || {FOLD.format('query')} || '%' AND (r.type IS NULL OR r.type = n.type)"""


@query(f'SELECT repo, query, rank, id, name FROM ({SEARCH}) s WHERE rank <= "limit"')
def search_nodes(spark, d):
    return lookup.search_nodes(frame(spark, d, "fx_nodes"), frame(spark, d, "rq_search")).select("repo", "query", "rank", "id", "name")


@query(f'SELECT repo, query, type_wanted, "limit", rank, name, type, file_path, start_line, end_line, signature, language FROM ({SEARCH}) s WHERE rank <= "limit"')
def search_report(spark, d):
    return reports.search_report(frame(spark, d, "fx_nodes"), frame(spark, d, "rq_search"))


@query(
    """SELECT e.repo, e.file_path, e.callee_name, e.line, r.id AS node_id, 'outgoing' AS direction FROM {fx_resolved} e JOIN {rq_ids} r ON r.repo = e.repo AND r.id = e.caller_id
UNION ALL SELECT e.repo, e.file_path, e.callee_name, e.line, r.id, 'incoming' FROM {fx_resolved} e JOIN {rq_ids} r ON r.repo = e.repo AND r.id = e.callee_id"""
)
def edges_of(spark, d):
    return lookup.edges_of(frame(spark, d, "fx_resolved"), frame(spark, d, "rq_ids")).select("repo", "file_path", "callee_name", "line", "node_id", "direction")


@query("SELECT c.repo, c.node_id, c.text, c.source FROM {fx_comments} c JOIN {rq_ids} r ON r.repo = c.repo AND r.id = c.node_id")
def comments_of(spark, d):
    return lookup.comments_of(frame(spark, d, "fx_comments"), frame(spark, d, "rq_ids")).select("repo", "node_id", "text", "source")


@query("SELECT DISTINCT s.repo, s.file_path, f.hash FROM {fx_sources} s LEFT JOIN {fx_files} f ON f.repo = s.repo AND f.file_path = s.file_path")
def file_hashes(spark, d):
    return lookup.file_hashes(frame(spark, d, "fx_files"), frame(spark, d, "fx_sources"))


BARE = "FROM {fx_nodes} n WHERE type IN ('function', 'method', 'class', 'interface', 'struct', 'trait') AND NOT EXISTS (SELECT 1 FROM {fx_comments} c WHERE c.repo = n.repo AND c.node_id = n.id)"


@query(f"SELECT repo, id, name, type {BARE}")
def nodes_without_comments(spark, d):
    return lookup.nodes_without_comments(frame(spark, d, "fx_nodes"), frame(spark, d, "fx_comments"), None).select("repo", "id", "name", "type")


@query(f"SELECT repo, id, name, type FROM (SELECT repo, id, name, type, ROW_NUMBER() OVER (PARTITION BY repo ORDER BY {FIRST}) AS rn {BARE}) t WHERE rn <= 100")
def generation_targets(spark, d):
    return describe.generation_targets(frame(spark, d, "fx_nodes"), frame(spark, d, "fx_comments")).select("repo", "id", "name", "type")


# --- graph ---

NODE = "n.id, n.name, n.file_path, n.start_line"
GRAPH = {
    "callers_by_name": ("SELECT repo, callee_name, caller_id, 1 FROM {fx_resolved} WHERE callee_name IS NOT NULL", "e.caller_id", "e.callee_id"),
    "callers_by_id": ("SELECT repo, callee_id, caller_id, 1 FROM {fx_resolved} WHERE callee_id IS NOT NULL", "e.caller_id", "e.callee_id"),
    "callees_by_name": ("SELECT e.repo, n.name, e.callee_id, 1 FROM {fx_nodes} n JOIN {fx_resolved} e ON e.repo = n.repo AND e.caller_id = n.id WHERE e.callee_id IS NOT NULL", "e.callee_id", "e.caller_id"),
    "callees_by_id": ("SELECT repo, caller_id, callee_id, 1 FROM {fx_resolved} WHERE callee_id IS NOT NULL", "e.callee_id", "e.caller_id"),
}


def reach_sql(name: str, depth: int) -> str:
    first, to, at = GRAPH[name]
    return f"""WITH RECURSIVE r(repo, seed, id, depth) AS ({first} UNION SELECT r.repo, r.seed, {to}, depth + 1 FROM r JOIN {{fx_resolved}} e ON e.repo = r.repo AND {at} = r.id WHERE depth < {depth} AND {to} IS NOT NULL)
SELECT DISTINCT r.repo, r.seed, {NODE} FROM r JOIN {{fx_nodes}} n ON n.repo = r.repo AND n.id = r.id"""


def seeds_of(frame_: DataFrame, column: str) -> DataFrame:
    return frame_.filter(F.col(column).isNotNull()).select("repo", F.col(column).alias("seed")).distinct()


GRAPH_COLUMNS = ("repo", "seed", "id", "name", "file_path", "start_line")


@query(reach_sql("callers_by_name", 2))
def callers_by_name(spark, d):
    index = index_of(spark, d)
    return graph.callers_of_names(index.nodes, index.edges, seeds_of(index.edges, "callee_name"), 2).select(*GRAPH_COLUMNS)


@query(reach_sql("callers_by_id", 2))
def callers_by_id(spark, d):
    index = index_of(spark, d)
    return graph.callers_of_ids(index.nodes, index.edges, seeds_of(index.edges, "callee_id"), 2).select(*GRAPH_COLUMNS)


@query(reach_sql("callees_by_name", 2))
def callees_by_name(spark, d):
    index = index_of(spark, d)
    return graph.callees_of_names(index.nodes, index.edges, seeds_of(index.nodes, "name"), 2).select(*GRAPH_COLUMNS)


@query(reach_sql("callees_by_id", 3))
def callees_by_id(spark, d):
    index = index_of(spark, d)
    return graph.callees_of_ids(index.nodes, index.edges, seeds_of(index.edges, "caller_id"), 3).select(*GRAPH_COLUMNS)


# --- reports ---


STATUS = """SELECT f.repo, f.files, n.nodes, e.edges, c.comments, strftime(make_timestamp(f.last * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS last_indexed FROM (SELECT repo, COUNT(*) AS files, MAX(last_indexed) AS last FROM {fx_files} GROUP BY repo) f
JOIN (SELECT repo, COUNT(*) AS nodes FROM {fx_nodes} GROUP BY repo) n ON n.repo = f.repo JOIN (SELECT repo, COUNT(*) AS edges FROM {fx_edges} GROUP BY repo) e ON e.repo = f.repo JOIN (SELECT repo, COUNT(*) AS comments FROM {fx_comments} GROUP BY repo) c ON c.repo = f.repo"""


@query(STATUS)
def index_status(spark, d):
    return reports.index_status(index_of(spark, d))


@query(
    """SELECT p.repo, p.file_path, f.language, COUNT(*) OVER (PARTITION BY p.repo, p.file_path) AS total_symbols, n.type, n.name, n.signature, n.start_line, n.end_line FROM (SELECT repo, replace(file_path, chr(92), '/') AS file_path FROM {rq_paths}) p
JOIN {fx_files} f ON f.repo = p.repo AND f.file_path = p.file_path JOIN {fx_nodes} n ON n.repo = p.repo AND n.file_path = p.file_path"""
)
def file_summary(spark, d):
    found = reports.file_summary(index_of(spark, d), frame(spark, d, "rq_paths"))
    flat = found.select("repo", "file_path", "language", "total_symbols", F.explode("symbols").alias("type", "list")).withColumn("s", F.explode("list"))
    return flat.select("repo", "file_path", "language", F.col("total_symbols").cast("bigint").alias("total_symbols"), "type", "s.name", "s.signature", "s.start_line", "s.end_line")


@query("SELECT repo, COUNT(*) FILTER (WHERE callee_id IS NULL) AS unresolved, COUNT(*) AS edges FROM {fx_resolved} GROUP BY repo")
def unresolved_counts(spark, d):
    return maintain.unresolved_counts(frame(spark, d, "fx_resolved"))


def list_sql(name: str, depth: int, alias: str) -> str:
    """A name's nodes as text, from the recursion's result."""
    return f"(SELECT repo, seed, string_agg(file_path || ':' || start_line || ':' || name, ';' ORDER BY file_path, start_line, name, type, signature) AS {alias} FROM (SELECT DISTINCT r.repo, r.seed, n.* EXCLUDE (repo) FROM {name} r JOIN {{fx_nodes}} n ON n.repo = r.repo AND n.id = r.id) x GROUP BY repo, seed)"


def both_ways(depth: int) -> str:
    parts = []
    for alias, name in (("up", "callers_by_name"), ("down", "callees_by_name")):
        first, to, at = GRAPH[name]
        parts.append(f"{alias}(repo, seed, id, depth) AS ({first} UNION SELECT r.repo, r.seed, {to}, depth + 1 FROM {alias} r JOIN {{fx_resolved}} e ON e.repo = r.repo AND {at} = r.id WHERE depth < {depth} AND {to} IS NOT NULL)")
    return "WITH RECURSIVE " + ", ".join(parts)


@query(
    both_ways(2)
    + f""" SELECT q.repo, q.name AS name_asked, CAST(p.id AS VARCHAR) AS symbol_id, COALESCE(u.callers, '') AS callers, COALESCE(w.callees, '') AS callees, COALESCE(o.outgoing, '') AS outgoing, COALESCE(i.incoming, '') AS incoming, CASE WHEN p.id IS NULL THEN '{reports.UNKNOWN_NAME}' END AS error
FROM {{rq_names}} q LEFT JOIN {{fx_first}} p ON p.repo = q.repo AND p.name = q.name
LEFT JOIN {list_sql('up', 2, 'callers')} u ON u.repo = q.repo AND u.seed = q.name LEFT JOIN {list_sql('down', 2, 'callees')} w ON w.repo = q.repo AND w.seed = q.name
LEFT JOIN (SELECT repo, caller_id, string_agg(line || ':' || callee_name || ':' || CASE WHEN callee_id IS NULL THEN 'false' ELSE 'true' END, ';' ORDER BY line, callee_name, callee_id IS NOT NULL) AS outgoing FROM {{fx_resolved}} GROUP BY repo, caller_id) o ON o.repo = p.repo AND o.caller_id = p.id
LEFT JOIN (SELECT repo, callee_id, string_agg(line || ':' || caller_id, ';' ORDER BY line, caller_id) AS incoming FROM {{fx_resolved}} GROUP BY repo, callee_id) i ON i.repo = p.repo AND i.callee_id = p.id"""
)
def call_graph_report(spark, d):
    found = reports.call_graph_report(index_of(spark, d), frame(spark, d, "rq_names"), 2)
    return found.select(
        "repo", "name_asked", F.col("symbol.id").cast("string").alias("symbol_id"), joined("callers", "file_path", "line", "name"), joined("callees", "file_path", "line", "name"),
        joined("outgoing", "line", "callee_name", "resolved"), joined("incoming", "line", "caller_id"), "error",
    )


TEXTS = "SELECT repo, node_id, MIN(CASE WHEN source = 'original' THEN text END) AS original, MIN(CASE WHEN source = 'generated' THEN text END) AS made FROM {fx_comments} GROUP BY repo, node_id"


@query(
    both_ways(2)
    + """, parts AS (SELECT q.repo, q.name AS name_asked, 'symbol' AS part, p.id, CAST(NULL AS INT) AS line, CAST(NULL AS VARCHAR) AS callee_name, CAST(NULL AS VARCHAR) AS resolved, CAST(NULL AS VARCHAR) AS error FROM {rq_names} q JOIN {fx_first} p ON p.repo = q.repo AND p.name = q.name
UNION ALL SELECT DISTINCT q.repo, q.name, 'callers', u.id, NULL, NULL, NULL, NULL FROM {rq_names} q JOIN up u ON u.repo = q.repo AND u.seed = q.name
UNION ALL SELECT DISTINCT q.repo, q.name, 'callees', w.id, NULL, NULL, NULL, NULL FROM {rq_names} q JOIN down w ON w.repo = q.repo AND w.seed = q.name
UNION ALL SELECT q.repo, q.name, 'outgoing', NULL, e.line, e.callee_name, CASE WHEN e.callee_id IS NULL THEN 'false' ELSE 'true' END, NULL FROM {rq_names} q JOIN {fx_first} p ON p.repo = q.repo AND p.name = q.name JOIN {fx_resolved} e ON e.repo = p.repo AND e.caller_id = p.id
UNION ALL SELECT q.repo, q.name, 'incoming', e.caller_id, e.line, NULL, NULL, NULL FROM {rq_names} q JOIN {fx_first} p ON p.repo = q.repo AND p.name = q.name JOIN {fx_resolved} e ON e.repo = p.repo AND e.callee_id = p.id
UNION ALL SELECT q.repo, q.name, 'error', NULL, NULL, NULL, NULL, '"""
    + reports.UNKNOWN_NAME
    + """' FROM {rq_names} q WHERE NOT EXISTS (SELECT 1 FROM {fx_first} p WHERE p.repo = q.repo AND p.name = q.name))
SELECT repo, name_asked, part, CAST(id AS VARCHAR) AS id, CAST(line AS VARCHAR) AS line, callee_name, resolved, error FROM parts"""
)
def call_graph_rows(spark, d):
    found = reports.call_graph_rows(index_of(spark, d), frame(spark, d, "rq_names"), 2)
    return found.select("repo", "name_asked", "part", *string("id", "line"), "callee_name", *string("resolved"), "error")


@query(
    f"""SELECT q.repo, q.name, CAST(n.id AS VARCHAR) AS id, n.type, n.file_path, CAST(n.start_line AS VARCHAR) AS start_line, n.file_path || ':' || n.start_line || '-' || n.end_line AS location, n.signature, n.language, c.original AS comment, CASE WHEN c.original IS NOT NULL THEN 'original' END AS comment_source, c.made AS generated_description,
p.name AS parent_class, p.type AS parent_type, p.file_path AS parent_path, CAST(p.start_line AS VARCHAR) AS parent_line, CASE WHEN n.id IS NULL THEN '{reports.UNKNOWN_NAME}' END AS error FROM {{rq_names}} q LEFT JOIN {{fx_nodes}} n ON n.repo = q.repo AND n.name = q.name LEFT JOIN ({TEXTS}) c ON c.repo = n.repo AND c.node_id = n.id
LEFT JOIN {{fx_nodes}} p ON p.repo = n.repo AND p.id = n.parent_id"""
)
def context_report(spark, d):
    found = reports.context_report(index_of(spark, d), frame(spark, d, "rq_names"))
    return found.select("repo", "name", *string("id"), "type", "file_path", *string("start_line"), "location", "signature", "language", "comment", "comment_source", "generated_description", "parent_class", "parent_type", "parent_path", *string("parent_line"), "error")


@query(
    """SELECT DISTINCT e.repo, e.callee_name AS name_asked, 'callers' AS direction, n.id, n.name, n.file_path FROM {rq_names} q JOIN {fx_resolved} e ON e.repo = q.repo AND e.callee_name = q.name JOIN {fx_nodes} n ON n.repo = e.repo AND n.id = e.caller_id
UNION ALL SELECT DISTINCT q.repo, q.name, 'callees', n.id, n.name, n.file_path FROM {rq_names} q JOIN {fx_nodes} o ON o.repo = q.repo AND o.name = q.name JOIN {fx_resolved} e ON e.repo = o.repo AND e.caller_id = o.id JOIN {fx_nodes} n ON n.repo = e.repo AND n.id = e.callee_id"""
)
def context_neighbours(spark, d):
    return reports.context_neighbours(index_of(spark, d), frame(spark, d, "rq_names")).select("repo", "name_asked", "direction", "id", "name", "file_path")


@query(
    f"SELECT q.repo, q.name, CAST(n.id AS VARCHAR) AS id, n.file_path, CAST(n.start_line AS VARCHAR) AS start_line, COALESCE(c.original, c.made) AS comment, CASE WHEN c.original IS NOT NULL THEN 'original' WHEN c.made IS NOT NULL THEN 'generated' END AS comment_source, CASE WHEN n.id IS NULL THEN '{reports.UNKNOWN_NAME}' END AS error FROM {{rq_names}} q LEFT JOIN {{fx_nodes}} n ON n.repo = q.repo AND n.name = q.name LEFT JOIN ({TEXTS}) c ON c.repo = n.repo AND c.node_id = n.id"
)
def comment_report(spark, d):
    return reports.comment_report(index_of(spark, d), frame(spark, d, "rq_names")).select("repo", "name", *string("id"), "file_path", *string("start_line"), "comment", "comment_source", "error")


# --- comment generation ---

STYLE = "CASE n.language " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in describe.STYLE_EXAMPLES.items()) + " END"
NL = " || chr(10) || "


def system_sql(what: str) -> str:
    return f"'Write a short documentation comment for this {what}, one to three sentences, in the manner of ' || n.language || '. Answer with the comment''s text only.'"


@query(
    f"SELECT n.repo, n.id, {system_sql('function')} AS system, 'Language: ' || n.language{NL}'Style: ' || {STYLE}{NL}''{NL}'Signature:'{NL}n.signature{NL}''{NL}'Body:'{NL}substr(n.body_text, 1, 1500) AS \"user\" FROM {{fx_nodes}} n WHERE type IN ('function', 'method')"
)
def function_prompts(spark, d):
    return describe.function_prompts(frame(spark, d, "fx_nodes"))


CLASSES = "n.type IN ('class', 'interface', 'struct', 'trait')"
METHOD_ORDER = "file_path, start_line, start_col, end_line DESC, end_col DESC, id"


def class_sql(methods: str) -> str:
    return f"""SELECT n.repo, n.id, {system_sql('class')} AS system, 'Language: ' || n.language{NL}'Style: ' || {STYLE}{NL}''{NL}'Class: ' || n.name{NL}'Signature: ' || n.signature{NL}'Methods: ' || COALESCE(m.names, 'none') AS "user"
FROM {{fx_nodes}} n LEFT JOIN ({methods}) m ON m.repo = n.repo AND m.class_id = n.id WHERE {CLASSES}"""


@query(
    class_sql(
        f"""SELECT c.repo, c.id AS class_id, string_agg(h.name, ', ' ORDER BY h.file_path, h.start_line, h.start_col, h.end_line DESC, h.end_col DESC, h.id) AS names FROM {{fx_nodes}} c JOIN (SELECT k.class_name, f.*, ROW_NUMBER() OVER (PARTITION BY f.repo, k.class_name ORDER BY {METHOD_ORDER}) AS rn
FROM (SELECT DISTINCT repo, name AS class_name FROM {{fx_nodes}} n WHERE {CLASSES}) k JOIN {{fx_nodes}} f ON f.repo = k.repo AND f.type = 'method' AND {FOLD.format('f.name')} LIKE '%' || {FOLD.format('k.class_name')} || '%') h
ON h.repo = c.repo AND h.class_name = c.name AND h.file_path = c.file_path AND h.rn <= 50 WHERE c.type IN ('class', 'interface', 'struct', 'trait') GROUP BY c.repo, c.id"""
    )
)
def class_prompts(spark, d):
    return describe.class_prompts(frame(spark, d, "fx_nodes"))


@query(
    class_sql(
        "SELECT c.repo, c.id AS class_id, string_agg(h.name, ', ' ORDER BY h.start_line, h.start_col, h.end_line DESC, h.end_col DESC, h.id) AS names FROM {fx_nodes} c JOIN {fx_nodes} h ON h.repo = c.repo AND h.file_path = c.file_path AND h.type = 'method' AND h.start_line >= c.start_line AND h.end_line <= c.end_line WHERE c.type IN ('class', 'interface', 'struct', 'trait') GROUP BY c.repo, c.id"
    )
)
def class_prompts_contained(spark, d):
    return describe.class_prompts(frame(spark, d, "fx_nodes"), "contained")


def stand_in() -> Callable[[str, str, float, int, float], str]:
    """A model's stand-in: answers with the prompt's length, nothing for some lengths, fails for others."""

    def call(system: str, user: str, temperature: float, max_tokens: int, timeout: float) -> str:
        if len(user) % 7 == 0:
            raise TimeoutError
        return "" if len(user) % 5 == 0 else f" length {len(user)} "

    return call


PROMPTED = f"SELECT n.repo, n.id, length('Language: ' || n.language || 'Style: ' || {STYLE} || 'Signature:' || n.signature || 'Body:' || substr(n.body_text, 1, 1500)) + 7 AS size FROM {{fx_nodes}} n WHERE n.type IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM {{fx_comments}} c WHERE c.repo = n.repo AND c.node_id = n.id AND c.source = 'original')"


@query(
    f"""SELECT c.repo, CAST(c.node_id AS VARCHAR) AS node_id, c.text, c.source FROM {{fx_comments}} c LEFT JOIN ({PROMPTED}) p ON p.repo = c.repo AND p.id = c.node_id AND size % 7 <> 0 AND size % 5 <> 0 WHERE c.source = 'original' OR p.id IS NULL
UNION ALL SELECT repo, CAST(id AS VARCHAR), 'length ' || size, 'generated' FROM ({PROMPTED}) p WHERE size % 7 <> 0 AND size % 5 <> 0"""
)
def generate_comments(spark, d):
    notes = frame(spark, d, "fx_comments")
    prompts = describe.to_generate(describe.function_prompts(frame(spark, d, "fx_nodes")), notes)
    return describe.write_back(notes, describe.generate_comments(prompts, stand_in), 9).select("repo", *string("node_id"), "text", "source")


@query(f"SELECT repo, COUNT(*) FILTER (WHERE size % 7 <> 0 AND size % 5 <> 0) AS success, COUNT(*) FILTER (WHERE size % 7 = 0 OR size % 5 = 0) AS skipped, COUNT(*) FILTER (WHERE size % 7 = 0) AS errors FROM ({PROMPTED}) p GROUP BY repo")
def generation_outcomes(spark, d):
    prompts = describe.to_generate(describe.function_prompts(frame(spark, d, "fx_nodes")), frame(spark, d, "fx_comments"))
    return describe.outcome_counts(describe.generate_comments(prompts, stand_in))


# --- events ---

GAP_MS = 6 * 3600 * 1000
LAGGED = "SELECT *, epoch_us(ts) - LAG(epoch_us(ts)) OVER (PARTITION BY repo, file_path ORDER BY ts, seq) AS since, LEAD(epoch_us(ts)) OVER (PARTITION BY repo, file_path ORDER BY ts, seq) - epoch_us(ts) AS until FROM {fx_events}"
SESSIONS = f"""SELECT repo, file_path, bool_or(kind = 'unlink') AS removed, arg_max(kind, (ts, seq)) <> 'unlink' AS upsert, epoch_us(MAX(ts)) AS last_us, COUNT(*) AS events
FROM (SELECT *, SUM(CASE WHEN since < {GAP_MS * 1000} THEN 0 ELSE 1 END) OVER (PARTITION BY repo, file_path ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM ({LAGGED}) e) t GROUP BY repo, file_path, s"""


def events(spark, d):
    return frame(spark, d, "fx_events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(SESSIONS, "debounce")
def debounce(spark, d):
    found = watch.batch_sessions(events(spark, d), GAP_MS, True)
    return found.select("repo", "file_path", "removed", "upsert", F.unix_micros("last_ts").alias("last_us"), "events")


@query(f"SELECT repo, seq, kind = 'unlink' OR until IS NULL OR until >= {GAP_MS * 1000} AS fires FROM ({LAGGED}) e")
def fired_events(spark, d):
    return watch.fired_events(events(spark, d), GAP_MS, True).select("repo", "seq", "fires")


PENDING = f"""WITH moment AS (SELECT MAX(ts) - INTERVAL 10 DAY AS t FROM {{fx_events}}),
e AS (SELECT v.*, epoch_us(t) AS now, LEAD(epoch_us(ts)) OVER w AS nxt, LEAD(kind) OVER w AS next_kind FROM {{fx_events}} v, moment WHERE ts <= t WINDOW w AS (PARTITION BY repo, file_path ORDER BY ts, seq)),
f AS (SELECT *, kind <> 'unlink' AND COALESCE(nxt, now) - epoch_us(ts) >= {GAP_MS * 1000} AS fired FROM e)
SELECT repo, COUNT(*) FILTER (WHERE kind <> 'unlink' AND nxt IS NULL AND NOT fired) AS pending,
COUNT(*) FILTER (WHERE kind <> 'unlink') - COUNT(*) FILTER (WHERE fired) - COUNT(*) FILTER (WHERE kind <> 'unlink' AND NOT fired AND next_kind = 'unlink') AS raw_counter FROM f GROUP BY repo"""


@query(PENDING)
def pending_files(spark, d):
    e = events(spark, d)
    last = e.agg(F.max("ts")).first()[0]
    return watch.pending_files(e, F.lit(last) - F.expr("INTERVAL 10 DAYS"), GAP_MS, True)


@query(f"SELECT s.*, COALESCE(p.pending, 0) AS pending FROM ({STATUS}) s LEFT JOIN ({PENDING}) p ON p.repo = s.repo")
def status_report(spark, d):
    return reports.status_report(index_of(spark, d), pending_files(spark, d))


WATCHED = "regexp_matches(file_path, '\\.(py|ts)$')"


@query(f"SELECT repo, file_path, seq FROM {{fx_events}} WHERE {WATCHED} AND NOT regexp_matches(file_path, '^src/u1[^/]*$')")
def watched_events(spark, d):
    e = events(spark, d)
    kept = e.filter(watch.event_filter(F.col("file_path")))
    return source_files.watch_kept(kept, e.select("repo").distinct().withColumn("pattern", F.lit("src/u1*"))).select("repo", "file_path", "seq")


@query(
    f"""SELECT repo, file_path, 'u_' || seq AS name FROM (SELECT repo, file_path, arg_max(kind, (ts, seq)) AS kind, arg_max(seq, (ts, seq)) AS seq FROM {{fx_events}} WHERE {WATCHED} GROUP BY repo, file_path) e WHERE kind <> 'unlink'"""
)
def applied_events(spark, d):
    """All sessions of the events table applied to an index on disk as one micro-batch, and once more as after a failure."""
    import uuid

    from .schemas import empty_index
    from .sources import store
    from .tables import shared_dir

    e = events(spark, d).filter(watch.event_filter(F.col("file_path")))
    code = F.when(F.col("file_path").endswith(".py"), F.concat(F.lit("def u_"), F.col("seq").cast("string"), F.lit("():\n    0\n"))).otherwise(F.concat(F.lit("function u_"), F.col("seq").cast("string"), F.lit("() {\n}\n")))
    last = e.groupBy("repo", "file_path").agg(F.max_by(code, F.struct("ts", "seq")).alias("source"))
    batch = watch.batch_sessions(e, GAP_MS, True).join(last, ["repo", "file_path"])
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    store.write_index(empty_index(spark), path, resolved=True)
    apply = watch.apply_batch(path, now_ms=7)
    apply(batch.filter("pmod(hash(file_path), 2) = 0"), 0)
    for _ in range(2):
        apply(batch.filter("pmod(hash(file_path), 2) = 1"), 1)
    apply(batch.withColumn("source", F.lit("def never():\n    0\n")), 0)  # a batch that is in the index already is passed over
    return store.read_index(spark, path).nodes.select("repo", "file_path", "name")


def fired_stream(spark, d) -> tuple[DataFrame, str]:
    """What fired of the events table, brought to a running stream in four parts by time, and the stream's checkpoint. Nothing closes the stream, so late changes still wait."""
    import uuid

    from .tables import cut, shared_dir

    e = cut(events(spark, d).withColumn("source", F.lit(None).cast("string")), "events")
    folder, out = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("events", "fired"))
    bounds = e.agg(F.percentile(F.unix_micros("ts"), [0.25, 0.5, 0.75]).alias("b")).first()["b"]
    e.limit(0).write.parquet(folder)
    fired = watch.debounced(spark.readStream.schema(e.schema).parquet(folder), GAP_MS, "30 days", True)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        us = F.unix_micros("ts")
        e.filter((F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high)).write.mode("append").parquet(folder)
        fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return cut(spark.read.schema(fired.schema).parquet(out), "fired"), f"{out}-state"


#: How far the watermark is in the end.
PASSED = "(SELECT epoch_ms(MAX(ts)) * 1000 - 30::BIGINT * 86400000000 FROM {fx_events})"


@query(f"SELECT repo, file_path, kind, epoch_us(ts) AS us, seq FROM ({LAGGED}) e WHERE kind = 'unlink' OR ((until IS NULL OR until >= {GAP_MS * 1000}) AND epoch_us(ts) + {GAP_MS * 1000} <= {PASSED})")
def stream_fired_events(spark, d):
    """Deletes at once, also those that the watermark hasn't reached; changes when it has passed their quiet time."""
    return fired_stream(spark, d)[0].select("repo", "file_path", "kind", F.unix_micros("ts").alias("us"), "seq")


@query(
    f"""SELECT s.*, COALESCE(p.pending, 0) AS pending FROM ({STATUS}) s LEFT JOIN (SELECT repo, COUNT(*) AS pending FROM ({LAGGED}) e
WHERE kind <> 'unlink' AND (until IS NULL OR until >= {GAP_MS * 1000}) AND epoch_us(ts) + {GAP_MS * 1000} > {PASSED} GROUP BY repo) p ON p.repo = s.repo"""
)
def live_status_report(spark, d):
    """The status with the changes that wait in a stream's state."""
    return reports.status_report(index_of(spark, d), watch.waiting_files(spark, fired_stream(spark, d)[1]))


def streamed(spark, d, late: bool) -> DataFrame:
    """The stream's sessions, run to their end over the events table, with one event far in the future to close them; then, if ``late``, all events again."""
    import uuid

    from .tables import cut, shared_dir

    e = events(spark, d).withColumn("source", F.lit(None).cast("string"))
    end = e.agg(F.lit("~end").alias("repo"), F.lit("~.py").alias("file_path"), F.lit("change").alias("kind"), (F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.max("seq").alias("seq"), F.lit(None).cast("string").alias("source"))
    folder, out = (f"{shared_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("events", "sessions"))
    e.write.parquet(folder)
    stream = spark.readStream.schema(e.schema).parquet(folder)
    writer = watch.sessions(stream, GAP_MS, "30 days", True).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
    writer.start().awaitTermination()
    end.select(*e.columns).write.mode("append").parquet(folder)
    writer.start().awaitTermination()
    if late:
        e.write.mode("append").parquet(folder)
        writer.start().awaitTermination()
    return cut(spark.read.parquet(out), "streamed").filter("repo <> '~end'").select("repo", "file_path", "removed", "upsert", F.unix_micros("last_ts").alias("last_us"), "events")


@query(SESSIONS)
def stream_debounce(spark, d):
    return streamed(spark, d, False)


@query(SESSIONS)
def stream_late_events(spark, d):
    """Events older than the watermark change nothing."""
    return streamed(spark, d, True)


# --- trees ---


@query("SELECT 't' AS repo, repo || '/' || file_path AS file_path, hash AS source, false AS failed FROM {fx_files} WHERE language <> 'tsx' UNION ALL SELECT 't', 'lost/' || repo || '.ts', NULL, true FROM (SELECT DISTINCT repo FROM {fx_files}) r")
def scanned_tree(spark, d):
    """A folder with a file for each of the fixtures' files, read whole; of files that go between listing and reading it is told that they can't be read."""
    import uuid

    from .tables import cut, shared_dir

    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"

    def write(batches):
        system, base = source_files.file_system(root)
        for x in batches:
            for repo, path, text in x.itertuples(index=False):
                place = f"{base}/{repo}/{path}"
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as f:
                    f.write(text.encode())
            yield x[["file_path"]]

    cut(frame(spark, d, "fx_files").select("repo", "file_path", "hash").mapInPandas(write, "file_path string"), "tree")
    system, base = source_files.file_system(root)
    system.create_dir(f"{base}/lost")
    lost = [f"{base}/lost/{r[0]}.ts" for r in frame(spark, d, "fx_files").select("repo").distinct().collect()]
    for place in lost:
        with system.open_output_stream(place) as f:
            f.write(b"lost")
    found = source_files.scan_source_tree(spark, root, "t")
    for place in lost:
        system.delete_file(place)
    return found.select("repo", "file_path", "source", F.col("error").isNotNull().alias("failed"))


# --- jobs ---


def program_texts(spark, d):
    """(repo, file_path, language, fx_key, source): an import, and a function for each order that calls one for each line item's part.

    Files named as Ruby's hold the same text, in which Ruby's parser finds no symbol.
    """
    calls = frame(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("calls"))
    owners = frame(spark, d, "fx_files").select("repo", "file_path", "language", "fx_key")
    orders = frame(spark, d, "orders").select(F.col("o_custkey").alias("fx_key"), F.col("o_orderkey").alias("k")).join(calls, "k", "left")
    python = F.col("language") == "python"
    number = F.col("k").cast("string")
    line = lambda text: F.concat(F.when(python, "    ").otherwise("  "), text, F.when(python, "\n").otherwise(";\n"))
    called = F.transform(F.coalesce("calls", F.array().cast(orders.schema["calls"].dataType)), lambda c: line(F.concat(F.lit("h"), c["l_partkey"].cast("string"), F.lit("()"))))
    function = F.concat(
        F.when(F.col("k") % 3 < 2, F.concat(F.when(python, "# about ").otherwise("// about "), number, F.lit("\n"))).otherwise(""),
        F.when(python, F.concat(F.lit("def h"), number, F.lit("():\n"))).otherwise(F.concat(F.lit("function h"), number, F.lit("() {\n"))),
        F.when(python & (F.col("k") % 4 == 0), F.concat(F.lit('    """ does '), number, F.lit(' """\n'))).otherwise(""),
        F.array_join(called, ""),
        F.when(python, "    0\n").otherwise("}\n"),
    )
    chunks = orders.join(owners, "fx_key").groupBy("fx_key").agg(F.array_sort(F.collect_list(F.struct("k", function.alias("x")))).alias("c"))
    head = F.concat(F.lit("import m"), F.col("fx_key").cast("string"), F.when(python, "\n").otherwise(";\n"))
    body = F.array_join(F.transform(F.coalesce("c", F.array().cast(chunks.schema["c"].dataType)), lambda c: c["x"]), "")
    return owners.join(chunks, "fx_key", "left").select("repo", "file_path", "language", "fx_key", F.concat(head, body).alias("source"))


_PROGRAMS: dict[tuple[str, str, str], tuple[Index, DataFrame]] = {}


def program_index(spark, d) -> tuple[Index, DataFrame]:
    """The full index of ``program_texts`` and its summary, written once for a folder of tables in an application."""
    from .schemas import empty_index
    from .tables import cut, shared_dir

    place = (spark.sparkContext.applicationId, shared_dir(spark), d)
    if place not in _PROGRAMS:
        index, summary = indexing.full_index(empty_index(spark), program_texts(spark, d).select("repo", "file_path", "source"), now_ms=7)
        _PROGRAMS[place] = Index(**{name: cut(t, f"program-{name}") for name, t in index.tables().items()}), cut(summary, "summary")
    return _PROGRAMS[place]


PARSED = "(SELECT f.repo, f.file_path, f.language, f.fx_key, o_orderkey AS k FROM {orders} JOIN {fx_files} f ON f.fx_key = o_custkey WHERE f.language <> 'ruby')"
CALLS = f"(SELECT c.repo, c.file_path, c.fx_key, c.k, l_partkey AS p, t.k AS target, t.fx_key AS target_key FROM {{lineitem}} JOIN {PARSED} c ON c.k = l_orderkey LEFT JOIN {PARSED} t ON t.repo = c.repo AND t.k = l_partkey WHERE c.language <> 'python')"  # Python's kind of call isn't among the kinds that make edges


@query(
    f"""SELECT (SELECT COUNT(*) FROM {{fx_files}}) AS files_processed, (SELECT COUNT(*) FROM {PARSED} p) + (SELECT COUNT(*) FROM {{fx_files}} WHERE language <> 'ruby') AS nodes_found,
(SELECT COUNT(*) FROM {CALLS} c WHERE target IS NOT NULL) AS edges_resolved"""
)
def full_index_summary(spark, d):
    return program_index(spark, d)[1]


@query(f"SELECT repo, file_path, 'h' || k AS caller, 'h' || p AS callee_name, CASE WHEN target IS NULL THEN 'open' ELSE 'h' || target END AS callee FROM {CALLS} c")
def full_index_edges(spark, d):
    index, _ = program_index(spark, d)
    named = lambda c, a: index.nodes.select("repo", F.col("id").alias(c), F.col("name").alias(a))
    edges = index.edges.join(named("caller_id", "caller"), ["repo", "caller_id"]).join(named("callee_id", "callee"), ["repo", "callee_id"], "left")
    return edges.select("repo", "file_path", "caller", "callee_name", F.coalesce("callee", F.lit("open")).alias("callee"))


@query("SELECT repo, file_path, 'import m' || fx_key || CASE WHEN language = 'python' THEN '' ELSE ';' END AS name, 'import' AS type, 'import m' || fx_key || CASE WHEN language = 'python' THEN '' ELSE ';' END AS signature, '' AS body_text FROM {fx_files} WHERE language <> 'ruby'")
def import_rows(spark, d):
    return program_index(spark, d)[0].nodes.filter("type = 'import'").select("repo", "file_path", "name", "type", "signature", "body_text")


@query(f"SELECT * FROM (SELECT repo, file_path, 'h' || k AS name, CASE WHEN language = 'python' AND k % 4 = 0 THEN 'does ' || k WHEN k % 3 < 2 THEN 'about ' || k END AS text, 'original' AS source FROM {PARSED} p) t WHERE text IS NOT NULL")
def original_comments(spark, d):
    index, _ = program_index(spark, d)
    return index.comments.join(index.nodes.select("repo", F.col("id").alias("node_id"), "file_path", "name"), ["repo", "node_id"]).select("repo", "file_path", "name", "text", "source")


def script_texts(spark, d):
    """(repo, file_path, source) of Ruby and of the script languages: for each order a definition whose body calls one function for each line item, among texts that look like code."""
    calls = frame(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("calls"))
    owners = frame(spark, d, "fx_files").filter(F.col("language").isin("ruby", "typescript", "javascript")).select("repo", "file_path", "language", "fx_key")
    orders = frame(spark, d, "orders").select(F.col("o_custkey").alias("fx_key"), F.col("o_orderkey").alias("k")).join(calls, "k", "left").join(owners, "fx_key")
    k = F.col("k").cast("string")
    parts = F.transform(F.coalesce("calls", F.array().cast(calls.schema["calls"].dataType)), lambda c: F.concat(F.lit("h"), c["l_partkey"].cast("string"), F.lit("(1)")))
    body = lambda indent, end: F.concat(F.array_join(F.transform(parts, lambda c: F.concat(F.lit(indent), c, F.lit(end))), ""))
    text = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    ruby = text("class K", k, "\n  # end of h", k, "\n  def h", k, "(a)\n    s = <<~TEXT\n      def none\n    TEXT\n    unless a\n", body("      ", "\n"), "    end\n    s if a\n  end\nend\n")
    script = (
        F.when(F.col("k") % 3 == 0, text("export function h", k, "() {\n  const t = `a ${1} { no(1)`;\n", body("  ", ";\n"), "}\n"))
        .when(F.col("k") % 3 == 1, text("export const h", k, " = (a) => {\n  if (/[\"}{]/) {}\n", body("  ", ";\n"), "};\n"))
        .otherwise(text("let h", k, " = async a => [\n", body("  ", ",\n"), "];\n"))
    )
    pieces = orders.withColumn("x", F.when(F.col("language") == "ruby", ruby).otherwise(script)).groupBy("repo", "file_path").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("x"))
    return pieces.select("repo", "file_path", F.array_join(F.transform("x", lambda p: p["x"]), "").alias("source"))


_SCRIPTS: dict[tuple[str, str, str], Index] = {}


def script_index(spark, d) -> Index:
    from .schemas import empty_index
    from .tables import cut, shared_dir

    place = (spark.sparkContext.applicationId, shared_dir(spark), d)
    if place not in _SCRIPTS:
        index, _ = indexing.full_index(empty_index(spark), script_texts(spark, d), now_ms=7)
        _SCRIPTS[place] = Index(**{name: cut(t, f"scripts-{name}") for name, t in index.tables().items()})
    return _SCRIPTS[place]


SCRIPTED = "(SELECT f.repo, f.file_path, f.language, o_orderkey AS k FROM {orders} JOIN {fx_files} f ON f.fx_key = o_custkey WHERE f.language IN ('ruby', 'typescript', 'javascript'))"


@query(
    f"""SELECT repo, file_path, 'h' || k AS name, CASE WHEN language = 'ruby' THEN 'method' ELSE 'function' END AS type FROM {SCRIPTED} s
UNION ALL SELECT repo, file_path, 'K' || k, 'class' FROM {SCRIPTED} s WHERE language = 'ruby'
UNION ALL SELECT repo, file_path, CASE k % 3 WHEN 0 THEN 'h' || k ELSE '<anonymous>' END, 'export' FROM {SCRIPTED} s WHERE language <> 'ruby' AND k % 3 < 2"""
)
def script_symbols(spark, d):
    """Ruby's classes and methods, exports, and arrow functions, by the library's own parsers."""
    return script_index(spark, d).nodes.select("repo", "file_path", "name", "type")


@query(f"SELECT s.repo, s.file_path, 'h' || s.k AS caller, 'h' || l_partkey AS callee_name FROM {{lineitem}} JOIN {SCRIPTED} s ON s.k = l_orderkey")
def script_edges(spark, d):
    index = script_index(spark, d)
    return index.edges.join(index.nodes.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("caller")), ["repo", "caller_id"]).select("repo", "file_path", "caller", "callee_name")


def edited_texts(spark, d):
    """``program_texts`` with every file whose key leaves 1 by 3 rewritten to one function."""
    key = F.col("fx_key").cast("string")
    code = F.when(F.col("language") == "python", F.concat(F.lit("def new"), key, F.lit("():\n    0\n"))).otherwise(F.concat(F.lit("function new"), key, F.lit("() {\n}\n")))
    return program_texts(spark, d).withColumn("source", F.when(F.col("fx_key") % 3 == 1, code).otherwise(F.col("source"))).select("repo", "file_path", "source")


@query(
    f"""SELECT repo, file_path, 'h' || k AS name, 'function' AS type FROM {PARSED} p WHERE fx_key % 3 <> 1 UNION ALL SELECT repo, file_path, 'import m' || fx_key || CASE WHEN language = 'python' THEN '' ELSE ';' END, 'import' FROM {{fx_files}} WHERE language <> 'ruby' AND fx_key % 3 <> 1
UNION ALL SELECT repo, file_path, 'new' || fx_key, 'function' FROM {{fx_files}} WHERE language <> 'ruby' AND fx_key % 3 = 1"""
)
def incremental_nodes(spark, d):
    return indexing.incremental_update(program_index(spark, d)[0], edited_texts(spark, d), now_ms=8)[0].nodes.select("repo", "file_path", "name", "type")


@query(f"SELECT repo, file_path, 'h' || p AS callee_name, CASE WHEN target IS NULL OR target_key % 3 = 1 THEN 'open' ELSE 'resolved' END AS state FROM {CALLS} c WHERE fx_key % 3 <> 1")
def incremental_edges(spark, d):
    edges = indexing.incremental_update(program_index(spark, d)[0], edited_texts(spark, d), now_ms=8)[0].edges
    return edges.select("repo", "file_path", "callee_name", F.when(F.col("callee_id").isNull(), "open").otherwise("resolved").alias("state"))


@query("SELECT repo, file_path, fx_key % 3 = 1 AS reindexed, CASE WHEN fx_key % 3 = 1 THEN 'indexed anew' ELSE 'unchanged, or no parser takes it' END AS message FROM {fx_files}")
def reindex_report(spark, d):
    return indexing.reindex_report(program_index(spark, d)[0], edited_texts(spark, d), now_ms=8)[1]


def stored_edits(spark, d) -> Index:
    """The program index on disk, brought up to date with ``edited_texts`` there, half of the files at a time."""
    import uuid

    from .sources import store
    from .tables import shared_dir

    path, index = f"{shared_dir(spark)}/programs-{uuid.uuid4().hex}", program_index(spark, d)[0]
    store.write_index(index, path, resolved=True)
    edits = edited_texts(spark, d)
    for part in range(2):
        indexing.update_stored(path, edits.filter(F.pmod(F.hash("file_path"), F.lit(2)) == part), now_ms=8)
    return store.read_index(spark, path)


@query(f"SELECT repo, file_path, 'h' || p AS callee_name, CASE WHEN target IS NULL OR target_key % 3 = 1 THEN 'open' ELSE 'resolved' END AS state FROM {CALLS} c WHERE fx_key % 3 <> 1")
def stored_edges(spark, d):
    return stored_edits(spark, d).edges.select("repo", "file_path", "callee_name", F.when(F.col("callee_id").isNull(), "open").otherwise("resolved").alias("state"))


def typed(index: Index) -> Index:
    """The fixtures' index with ids as text, as an index on disk has them."""
    kinds = {"files": FILES, "nodes": NODES, "edges": EDGES, "comments": COMMENTS}
    return Index(**{name: t.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds[name])) for name, t in index.tables().items()})


@query("SELECT repo, CAST(id AS VARCHAR) AS id, name FROM {fx_nodes} WHERE repo <> 'r1' OR id % 2 = 0")
def stored_index(spark, d):
    """An index written to a folder, one repo of it replaced, then read again."""
    import uuid

    from .sources import store
    from .tables import shared_dir

    path, index = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", typed(index_of(spark, d))
    store.write_index(index, path)
    even = Index(**{name: t.filter("repo = 'r1'") for name, t in store.read_index(spark, path).tables().items()})
    store.write_index(even.with_(nodes=even.nodes.filter("CAST(id AS BIGINT) % 2 = 0")), path)
    return store.read_index(spark, path).nodes.select("repo", "id", "name")


@query("SELECT repo, CAST(id AS VARCHAR) AS id, name FROM {fx_nodes}")
def appended_rows(spark, d):
    """Rows added to an index on disk, all or none: a table with one bad row adds nothing, then the same table without it is added whole."""
    import uuid

    from .sources import store
    from .tables import shared_dir

    path, index = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", typed(index_of(spark, d))
    store.write_index(index.with_(nodes=index.nodes.filter("CAST(id AS BIGINT) % 2 = 0")), path)
    none = Index(index.files.limit(0), index.nodes, index.edges.limit(0), index.comments.limit(0))
    more = index.nodes.filter("CAST(id AS BIGINT) % 2 = 1")
    try:
        store.add_rows(path, none.with_(nodes=more.withColumn("id", F.when(F.rand(5) < 0.5, F.col("id")))))
    except ValueError:
        pass
    store.add_rows(path, none.with_(nodes=more))
    return store.read_index(spark, path).nodes.select("repo", "id", "name")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Resolve all calls, then report the call graph of every called name."""
    return call_graph_report(spark, d)
