"""One case for each clause of the rules, on literal inputs."""

import pytest
from pyspark.sql import functions as F

from treeweave.functions.text import extension, iso_millis, like_anywhere, trim
from treeweave.operators import comments, extract, lookup, maintain
from treeweave.schemas import NODES, SYNTAX, Index
from treeweave.sources.files import glob_regex, keep_path, language_of


def values(spark, rows, *exprs, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(*exprs).collect()]


def one(spark, rows, expr, schema="x string"):
    return [r[0] for r in values(spark, rows, expr, schema=schema)]


def tree(spark, rows):
    """Rows of (node_id, parent, child_index, kind, field, last_desc, text[, start_row]) of one file."""
    full = [("r", "a.ts", "typescript", n, p, i, k, f, (rest[0] if rest else n), 0, (rest[0] if rest else n), 9, last, t) for n, p, i, k, f, last, t, *rest in rows]
    return spark.createDataFrame(full, SYNTAX)


def test_extension_and_language(spark):
    paths = ["a/b.TS", "a/.ts", "a/b", "a.b/c", "x.d.ts", "y.HXX", "noext.", "b.mjs"]
    assert one(spark, paths, extension(F.col("x"))) == [".TS", "", "", "", ".ts", ".HXX", ".", ".mjs"]
    assert one(spark, paths, language_of(F.col("x"))) == ["typescript", None, None, None, "typescript", "cpp", None, "javascript"]


def test_keep_path(spark):
    cases = {"a/b.ts": True, "a/b.TS": False, "a/b.tsx": False, "dist/a.ts": False, "a/dist": False, ".x/a.ts": False, "a/.x.ts": False, "distant/a.ts": True, "d/" * 20 + "a.ts": True, "d/" * 21 + "a.ts": False}
    assert one(spark, [*cases], keep_path(F.col("x"))) == [*cases.values()]


def test_globs(spark):
    df = spark.createDataFrame([("out", "a/out/b"), ("out", "out"), ("out", "outer"), ("*.log", "a.log"), ("*.log", "b/a.log"), ("**/x/*", "a/b/x/c"), ("a/**", "a"), ("a/**", "a/b/c"), ("a.b", "aXb")], "p string, x string")
    assert [r[0] for r in df.select(F.rlike("x", glob_regex(F.col("p")))).collect()] == [True, True, False, True, False, True, True, True, False]


def test_trim_and_time(spark):
    assert one(spark, ["  ﻿ a b\t"], trim(F.col("x"))) == ["a b"]
    assert one(spark, [1704067200123], iso_millis(F.col("x")), "x bigint") == ["2024-01-01T00:00:00.123Z"]


def test_like(spark):
    df = spark.createDataFrame([("LOAD_a", "load_"), ("loadxa", "load_"), ("Éa", "é"), ("Éa", "É"), ("a\\b", "\\"), ("ab", "\\"), ("get%", "t%"), ("a\x01b", "\x01b"), (None, "a")], "n string, q string")
    assert [r[0] for r in df.select(like_anywhere(F.col("n"), F.col("q"))).collect()] == [True, True, False, True, True, False, True, True, None]


def test_signature_and_body(spark):
    texts = ["f(a) { x }", "{ x }", "f(a) -> b", "plain", ") x", "  f() ", "g" * 250]
    assert one(spark, texts, extract.symbol_signature(F.col("x"))) == ["f(a)", "{ x }", "f(a)", "plain", ") x", "f()", "g" * 200 + "..."]
    assert one(spark, ["a" * 100, "a" * 101], extract.symbol_body(F.col("x"), 100)) == ["a" * 100, "a" * 100 + "..."]
    with pytest.raises(ValueError):
        extract.symbol_body(F.col("x"), 99)


def test_names(spark):
    found = extract.symbol_names(
        tree(
            spark,
            [
                (0, None, 0, "program", None, 99, ""),
                (1, 0, 0, "function_declaration", None, 2, "f"),
                (2, 1, 0, "identifier", "name", 2, "plain"),
                (3, 0, 1, "function_definition", None, 5, "c"),
                (4, 3, 0, "function_declarator", "declarator", 5, "decl(int)"),
                (5, 4, 0, "identifier", "name", 5, "inner"),
                (6, 0, 2, "function_definition", None, 7, "c"),
                (7, 6, 0, "function_declarator", "declarator", 7, "whole(int)"),
                (8, 0, 3, "variable_declarator", None, 10, "v"),
                (9, 8, 0, "identifier", "name", 9, "arrow"),
                (10, 8, 1, "arrow_function", None, 10, "() => 1"),
                (11, 0, 4, "export_statement", None, 13, "export"),
                (12, 11, 0, "class_declaration", "declaration", 13, "class X"),
                (13, 12, 0, "identifier", "name", 13, "X"),
                (14, 0, 5, "export_statement", None, 14, "export *"),
                (15, 0, 6, "import_statement", None, 16, "import a"),
                (16, 15, 0, "string", "source", 16, "'a\"b'"),
                (17, 0, 7, "import_statement", None, 17, "i" * 100),
                (18, 0, 8, "function_expression", None, 18, "function"),
            ],
        )
    )
    names = {r["node_id"]: r["name"] for r in found.collect()}
    assert names == {1: "plain", 3: "inner", 6: "whole(int)", 10: "arrow", 11: "X", 12: "X", 14: "<export>", 15: "ab", 17: "i" * 80, 18: "<anonymous>"}


def test_methods_and_calls(spark):
    syntax = tree(
        spark,
        [
            (0, None, 0, "program", None, 99, ""),
            (1, 0, 0, "class_declaration", None, 12, "class"),
            (2, 1, 0, "method_definition", None, 9, "m"),
            (3, 2, 0, "call_expression", None, 4, "f()"),
            (4, 3, 0, "identifier", "function", 4, "f"),
            (5, 2, 1, "arrow_function", None, 9, "() =>"),
            (6, 5, 0, "call_expression", None, 8, "a.b()"),
            (7, 6, 0, "member_expression", "function", 8, "a.b"),
            (8, 7, 0, "identifier", "property", 8, "b"),
            (9, 5, 1, "new_expression", None, 9, "new X()"),
            (10, 1, 1, "call_expression", None, 11, "loose()"),
            (11, 10, 0, "identifier", "function", 11, "loose"),
            (20, 0, 1, "function_item", None, 25, "fn"),
            (21, 20, 0, "method_invocation", None, 22, "o.m()"),
            (22, 21, 0, "identifier", "object", 22, "o"),
            (23, 20, 1, "call", None, 24, "p()"),
            (24, 23, 0, "identifier", "function", 24, "p"),
        ],
    )
    types = {r["node_id"]: r["type"] for r in extract.symbol_types(syntax).collect()}
    assert types == {1: "class", 2: "method", 5: "method", 20: "function"}
    hashes = spark.createDataFrame([("r", "a.ts", "h")], "repo string, file_path string, hash string")
    nodes = extract.symbols(syntax, hashes)
    by_id = {r["id"]: r["node_id"] for r in nodes.collect()}
    edges = {(by_id[r["caller_id"]], r["callee_name"]) for r in extract.call_edges(syntax, nodes).collect()}
    assert edges == {(2, "f"), (5, "b"), (20, "o")}  # a new_expression without children has no callee; the class's own call no caller
    assert ("p") in {r["callee_name"] for r in extract.call_edges(syntax, nodes, ["call"]).collect()}


@pytest.mark.parametrize(
    ("source", "row", "expected"),
    [
        ("// a\n/// b\nf", 2, "a\nb"),
        ("/** a\n * b\n */\nf", 3, "a\nb"),
        ("# a\n\n\nf", 3, "a"),
        ("# a\n\n# b\nf", 3, "b"),
        ("x\nf", 1, None),
        ("// \nf", 1, None),
        ("#include <a>\nf", 1, "include <a>"),
        ("f", 0, None),
        ("/* one */\nf", 1, "one */"),
    ],
)
def test_preceding_comment(spark, source, row, expected):
    assert one(spark, [(source, row)], comments.preceding_comment(F.split("x", "\n"), F.col("r")), "x string, r int") == [expected]


def test_docstring_before_comment(spark):
    from treeweave.sources.parse import parse_sources

    files = spark.createDataFrame(
        [("r", "a.py", '# above\ndef f():\n    """ doc """\n    g()\n\n# above g\ndef g():\n    pass\n\n# lost\ndef h():\n    """"""\n')], "repo string, file_path string, source string"
    )
    syntax = parse_sources(files)
    nodes = extract.symbols(syntax, files.withColumn("hash", F.sha2("source", 256)))
    found = comments.original_comments(syntax, files, nodes).join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    assert {(r["name"], r["text"]) for r in found.collect()} == {("f", "doc"), ("g", "above g")}


def small_index(spark):
    n = [("r", f, i, nm, "function", "s", 1, 2, 0, 0, None, "python", "b") for f, i, nm in (("a.py", "1", "f"), ("a.py", "2", "g"), ("b.py", "3", "f"), ("c.py", "4", "h"))]
    e = [("r", "a.py", "1", "3", "f", 1), ("r", "b.py", "3", "1", "f", 1), ("r", "b.py", "3", "4", "h", 2), ("r", "c.py", "4", None, "zz", 3)]
    c = [("r", "1", "t", "original", None), ("r", "3", "t", "generated", 5)]
    return Index(
        spark.createDataFrame([("r", f, "x", "python", 1, 1) for f in ("a.py", "b.py", "c.py")], "repo string, file_path string, hash string, language string, last_indexed bigint, node_count bigint"),
        spark.createDataFrame(n, NODES),
        spark.createDataFrame(e, "repo string, file_path string, caller_id string, callee_id string, callee_name string, line int"),
        spark.createDataFrame(c, "repo string, node_id string, text string, source string, generated_at bigint"),
    )


def edge_set(df):
    return {(r["caller_id"], r["callee_id"], r["callee_name"]) for r in df.collect()}


def test_replace_sets_null_and_delete_drops(spark):
    index = small_index(spark)
    paths = spark.createDataFrame([("r", "a.py")], "repo string, file_path string")
    none = Index(*(t.limit(0) for t in index.tables().values()))
    replaced = maintain.replace_file_rows(index, paths, none)
    assert edge_set(replaced.edges) == {("3", None, "f"), ("3", "4", "h"), ("4", None, "zz")}
    assert {r["node_id"] for r in replaced.comments.collect()} == {"3"}
    deleted = maintain.delete_files(index, paths)
    assert edge_set(deleted.edges) == {("3", "4", "h"), ("4", None, "zz")}
    assert {r["file_path"] for r in deleted.files.collect()} == {"b.py", "c.py"}


def test_resolve(spark):
    index = small_index(spark)
    edges = spark.createDataFrame([("r", "b.py", "3", None, "f", 1), ("r", "b.py", "3", "9", "f", 1), ("r", "b.py", "3", None, "no", 1), ("q", "b.py", "3", None, "f", 1)], index.edges.schema)
    assert sorted(map(str, (r["callee_id"] for r in maintain.resolve_edges(edges, index.nodes).collect()))) == ["1", "9", "None", "None"]
    assert sorted(map(str, (r["callee_id"] for r in maintain.resolve_edges(edges, index.nodes, True).collect()))) == ["3", "9", "None", "None"]


def test_limits_are_checked(spark):
    index = small_index(spark)
    asked = spark.createDataFrame([("r", "f", None, 101)], "repo string, query string, type string, limit int")
    with pytest.raises(ValueError):
        lookup.search_nodes(index.nodes, asked)


def test_innermost_of_nested_symbols(spark):
    # class 1-9 holds function 2-6, which holds function 3-4 and call 5; call 7; function 8-8; call 10 is outside of all
    nodes = {1: ("class_declaration", 9), 2: ("function_declaration", 6), 3: ("function_declaration", 4), 4: ("call_expression", 4), 5: ("call_expression", 5), 6: ("call_expression", 6), 7: ("call_expression", 7), 8: ("function_declaration", 8), 10: ("call_expression", 10)}
    rows = [("r", "f", "x", n, None, 0, kind, None, 0, 0, 0, 0, last, "") for n, (kind, last) in nodes.items()] + [("r", "g", "x", 4, None, 0, "call_expression", None, 0, 0, 0, 0, 4, "")]
    syntax = spark.createDataFrame(rows, SYNTAX)

    def inside(types, kind):
        return {(r["file_path"], r["node_id"]): r["outer_id"] for r in extract.enclosing(syntax, syntax.filter(F.col("kind") == kind), types).collect()}

    assert inside(["function"], "call_expression") == {("f", 4): 3, ("f", 5): 2, ("f", 6): 2}
    assert inside(["function", "class"], "call_expression") == {("f", 4): 3, ("f", 5): 2, ("f", 6): 2, ("f", 7): 1}
    assert inside(["function", "class"], "function_declaration") == {("f", 2): 1, ("f", 3): 2, ("f", 8): 1}
