"""What large tables ask of the operators: cost that follows the rows, with the same results."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from treeweave import tables
from treeweave.operators import comments, extract, graph
from treeweave.schemas import SYNTAX
from treeweave.sources.scripts import SCRIPT_TOKEN, masked_script

FILE_TEXT = "repo string, file_path string, source string"


@pytest.mark.parametrize("depth", [0, 3])
def test_comments_of_odd_files(spark, depth):
    """The same as reading up from each symbol by itself, also within a run of comment lines, past the end, and without a file."""
    dice = random.Random(3)
    lines = ["", "  ", "// a", "# b", " * c", "/* d */", "*/", "x()", "  /// e  ", "#", "*foo() {"]
    files = [("r", f"f{i}", "\n".join(dice.choice(lines) for _ in range(dice.randint(0, 12)))) for i in range(60)] + [("r", "null", None)]
    places = [("r", path, row) for path in [*(f[1] for f in files), "none"] for row in range(14)]
    texts, asked = spark.createDataFrame(files, FILE_TEXT), spark.createDataFrame(places, "repo string, file_path string, start_row int")
    all_lines = F.split("source", "\n")
    first = F.greatest(F.col("start_row") - depth, F.lit(0)) if depth else F.lit(0)
    each = asked.join(texts, ["repo", "file_path"], "left").withColumn("preceding", comments.preceding_comment(F.slice(all_lines, first + 1, F.greatest(F.size(all_lines), F.lit(0))), F.col("start_row") - first))
    found = sorted(map(str, comments.comment_lines(texts, asked, depth).collect()))
    assert found == sorted(map(str, each.select("repo", "file_path", "start_row", "preceding").collect()))


def test_comments_of_a_long_file(spark):
    """A file of 8,000 symbols costs its lines, not its lines for each symbol."""
    text = "\n".join(f"// c{i}\n\nf{i}() {{\n}}" for i in range(8000))
    places = spark.range(8000).selectExpr("'r' AS repo", "'f' AS file_path", "CAST(4 * id + 2 AS INT) AS start_row")
    start = time.time()
    found = comments.comment_lines(spark.createDataFrame([("r", "f", text)], FILE_TEXT), places)
    assert found.filter("preceding = concat('c', (start_row - 2) DIV 4)").count() == 8000
    assert time.time() - start < 60


def test_calls_are_shuffled_few_times(spark):
    """Names and calls out of syntax trees in few exchanges (before: 21), with the same results."""
    row = lambda k, up, i, kind, role, last, text: ("r", "f", "go", k, up, i, kind, role, k, 0, k, 9, last, text)
    rows = [
        row(0, None, 0, "program", None, 8, "all"),
        row(1, 0, 0, "function_item", None, 8, "fn a() { x.b(); c() }"),
        row(2, 1, 0, "identifier", "name", 2, "a"),
        row(3, 1, 1, "call_expression", None, 6, "x.b()"),
        row(4, 3, 0, "member_expression", "function", 6, "x.b"),
        row(5, 4, 0, "identifier", "object", 5, "x"),
        row(6, 4, 1, "property_identifier", "property", 6, "b"),
        row(7, 1, 2, "call_expression", None, 8, "c()"),
        row(8, 7, 0, "identifier", None, 8, "c"),
    ]
    syntax = spark.createDataFrame(rows, SYNTAX)
    nodes = extract.symbols(syntax, spark.createDataFrame([("r", "f", "h")], "repo string, file_path string, hash string"))
    edges = extract.call_edges(syntax, nodes)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 12
    own = {r["id"]: r["name"] for r in nodes.collect()}
    assert sorted((own[r["caller_id"]], r["callee_name"], r["line"]) for r in edges.collect()) == [("a", "b", 4), ("a", "c", 8)]


def test_scanner_reads_a_long_text_by_its_marks():
    """Plain code costs the scanner little: tokens are looked at only where something may have to be masked."""
    text = "return /* why */ /[`{]/.test(a) ? b / c : d;\n" + "a = b + (c, d) * e;\n" * 20_000
    assert masked_script(text).count("`") == 0
    assert len(SCRIPT_TOKEN.findall(text)) < 10


@pytest.mark.parametrize("small", [100_000, 20, 0])
def test_searches_shuffle_what_they_meet_once(spark, monkeypatch, small):
    """Steps to few nodes are taken where a block's seeds are, without a shuffle for each level; steps to many nodes find the same."""
    monkeypatch.setattr(tables, "SMALL", small)
    nodes = spark.range(60).selectExpr("'p' AS repo", "id", "concat('n', id) AS name")
    edges = spark.range(60).selectExpr("'p' AS repo", "id AS caller_id", "(id * 7) % 5 AS callee_id")
    found = graph.callees_of_ids(nodes, edges, spark.range(60).selectExpr("'p' AS repo", "id AS seed"), 3)
    if small > 60:
        assert not re.search(r"Exchange hashpartitioning\(repo#\d+, (?:id|to)#\d+L, block", found._jdf.queryExecution().executedPlan().toString())
    step = {k: k * 7 % 5 for k in range(60)}
    assert sorted((r["seed"], r["id"]) for r in found.collect()) == sorted({(k, t) for k in range(60) for t in (step[k], step[step[k]], step[step[step[k]]])})
