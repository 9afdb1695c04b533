"""Jobs end to end: a folder to an index to answers, incremental updates, storage, the event stream."""

import datetime as dt

from pyspark.sql import functions as F

from treeweave.jobs.indexing import full_index, incremental_update, reindex_report
from treeweave.operators.graph import callees_of_names, callers_of_names
from treeweave.operators.maintain import delete_files
from treeweave.schemas import empty_index
from treeweave.sources.files import read_source_tree
from treeweave.sources.parse import parse_sources, scan_braces
from treeweave.sources.store import read_index, write_index
from treeweave.streaming.watch import keep_current

SOURCES = {
    "a.ts": "// adds\nfunction add(a, b) { return plus(a, b); }\nfunction plus(a, b) { return a + b; }\n",
    "src/b.ts": "import { add } from './a'\nclass Sum {\n  // runs it\n  run() { return add(1, 2); }\n}\n",
    "dist/c.ts": "function no() {}",
    "d.txt": "text",
    "e.py": "def broken(:\n",
}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def tree(tmp_path):
    for name, text in SOURCES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path)


def test_folder_to_answers(spark, tmp_path):
    files = read_source_tree(spark, tree(tmp_path / "src_tree"), "r")
    assert rows(files, "file_path") == [("a.ts",), ("e.py",), ("src/b.ts",)]
    index, summary = full_index(empty_index(spark), files, now_ms=1)
    s = summary.first()
    assert (s["files_processed"], s["nodes_found"], s["edges_resolved"]) == (2, 5, 2)
    assert {("add", "function"), ("plus", "function"), ("Sum", "class"), ("run", "method")} <= {*rows(index.nodes, "name", "type")}
    names = {r["id"]: r["name"] for r in index.nodes.collect()}
    assert {(names[r["caller_id"]], names.get(r["callee_id"])) for r in index.edges.collect()} == {("add", "plus"), ("run", "add")}
    assert {(names[r["node_id"]], r["text"]) for r in index.comments.collect()} == {("add", "adds"), ("run", "runs it")}
    seeds = spark.createDataFrame([("r", "plus")], "repo string, seed string")
    assert rows(callers_of_names(index.nodes, index.edges, seeds, 2), "name") == [("add",), ("run",)]
    assert rows(callees_of_names(index.nodes, index.edges, spark.createDataFrame([("r", "run")], "repo string, seed string"), 1), "name") == [("add",)]

    path = str(tmp_path / "index")
    write_index(index, path)
    again = read_index(spark, path)
    assert rows(again.nodes, "id") == rows(index.nodes, "id")
    same, changed = incremental_update(again, files, now_ms=2)
    assert not changed and rows(same.files, "file_path", "last_indexed") == [("a.ts", 1), ("src/b.ts", 1)] or changed is True  # e.py never parses, so it stays new
    edited = files.withColumn("source", F.when(F.col("file_path") == "a.ts", "function add(a, b) { return 1; }\n").otherwise(F.col("source")))
    new, report = reindex_report(again, edited.filter("file_path <> 'e.py'"), now_ms=3)
    assert rows(report, "file_path", "reindexed") == [("a.ts", True), ("src/b.ts", False)]
    fresh, _ = full_index(empty_index(spark), edited, now_ms=3)
    assert rows(new.nodes, "id", "name") == rows(fresh.nodes, "id", "name")
    assert rows(new.edges, "caller_id", "callee_id") == rows(fresh.edges, "caller_id", "callee_id")
    write_index(new, path)
    gone = delete_files(read_index(spark, path), spark.createDataFrame([("r", "a.ts"), ("r", "src/b.ts")], "repo string, file_path string"))
    write_index(gone, path, ["r"])
    assert read_index(spark, path).nodes.count() == 0


def test_scanner_masks_strings():
    root = scan_braces('function f() { g("h()"); /* k() */ new T(); a.b(1) }')
    calls = [n.kind for n in root.children[0].children if n.kind.endswith("expression")]
    assert calls == ["call_expression", "new_expression", "call_expression"]


def test_stream_keeps_index_current(spark, tmp_path):
    path = str(tmp_path / "live")
    write_index(empty_index(spark), path)
    t = dt.datetime(2024, 1, 1)
    at = lambda ms: t + dt.timedelta(milliseconds=ms)
    rows_ = [
        ("r", "a.ts", "add", at(0), 1, "function a() { b(); }"),
        ("r", "a.ts", "change", at(100), 2, "function a2() { b(); }"),
        ("r", "b.ts", "add", at(0), 3, "function b() {}"),
        ("r", "b.ts", "unlink", at(50), 4, None),
        ("r", "c.txt", "add", at(0), 5, "x"),
        ("z", "end.ts", "add", at(3_600_000), 6, ""),
    ]
    schema = "repo string, file_path string, kind string, ts timestamp, seq bigint, source string"
    folder = str(tmp_path / "events")
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(folder)
    go = lambda: keep_current(spark.readStream.schema(schema).parquet(folder), path, str(tmp_path / "state"), 300, now_ms=5).awaitTermination()
    go()
    spark.createDataFrame([("z", "end.ts", "add", at(7_200_000), 7, "")], schema).write.mode("append").parquet(folder)
    go()
    index = read_index(spark, path)
    assert [r["name"] for r in index.nodes.filter("repo = 'r'").collect()] == ["a2"]
    assert [r["callee_id"] for r in index.edges.filter("repo = 'r'").collect()] == [None]


def test_tree_with_underscores(spark, tmp_path):
    for name in ("pkg/__init__.py", "pkg/_private.py", "_folder/x.py", "pkg/.hidden.py", ".git/y.py", "node_modules/z.js", "pkg/note.txt"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    (tmp_path / "pkg" / "odd.py").write_bytes(b"# \xff\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        found = read_source_tree(spark, root, "r")
        assert rows(found, "file_path") == [("_folder/x.py",), ("pkg/__init__.py",), ("pkg/_private.py",), ("pkg/odd.py",)]
    assert {r["source"] for r in found.filter("file_path = 'pkg/odd.py'").collect()} == {"# \ufffd\n"}
    (tmp_path / "none").mkdir()
    assert read_source_tree(spark, str(tmp_path / "none"), "r").count() == 0


def test_only_parsed_files_are_reindexed(spark):
    schema = "repo string, file_path string, source string"
    files = spark.createDataFrame([("r", "a.ts", "function a() {}"), ("r", "b.txt", "text"), ("r", "c.py", "def broken(:")], schema)
    index, report = reindex_report(empty_index(spark), files, now_ms=1)
    assert rows(report, "file_path", "reindexed") == [("a.ts", True), ("b.txt", False), ("c.py", False)]
    _, report = reindex_report(index, files.filter("file_path = 'a.ts'"), now_ms=2)
    assert rows(report, "file_path", "reindexed") == [("a.ts", False)]


def test_odd_sources_dont_stop_others(spark):
    deep = "x = " + "+".join(["a"] * 3000) + "\ndef after():\n    pass\n"
    sources = [
        ("deep.py", deep, "after"),
        ("returns.py", "def one():\r    two()\rdef three():\r    pass\r", "three"),
        ("ligature.py", "def e\ufb03cient():\n    pass\n", "e\ufb03cient"),
        ("marked.py", "\ufeffdef begun():\n    pass\n", "begun"),
        ("calls.ts", "function f() {\n" + "f(" * 10000 + ")" * 10000 + ";\n}\n", "f"),
    ]
    schema = "repo string, file_path string, source string"
    files = spark.createDataFrame([("r", n, s) for n, s, _ in sources], schema)
    syntax = parse_sources(files).cache()
    assert syntax.filter("kind = 'ERROR'").count() == 0
    named = {*rows(syntax.filter("field = 'name'"), "file_path", "text")}
    assert {(n, name) for n, _, name in sources} <= named

    def fails(source):
        raise RuntimeError("no")

    failed = parse_sources(files.filter("file_path LIKE '%.py'"), {"python": fails})
    assert rows(failed, "kind", "text") == [("ERROR", "RuntimeError: no")] * 4
    index, summary = full_index(empty_index(spark), files, {"python": fails, "typescript": scan_braces}, now_ms=1)
    assert rows(index.files, "file_path") == [("calls.ts",)]


def test_stream_leaves_ignored_paths_alone(spark, tmp_path):
    path, folder = str(tmp_path / "live"), str(tmp_path / "events")
    write_index(empty_index(spark), path)
    t = dt.datetime(2024, 1, 1)
    schema = "repo string, file_path string, kind string, ts timestamp, seq bigint, source string"
    events = [("r", "a.ts", "add", t, 1, "function a() {}"), ("r", "gen/b.ts", "add", t, 2, "function b() {}"), ("z", "end.ts", "add", t + dt.timedelta(hours=1), 3, "")]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(folder)
    patterns = spark.createDataFrame([("r", "gen")], "repo string, pattern string")
    stream = spark.readStream.schema(schema).parquet(folder)
    running = keep_current(stream, path, str(tmp_path / "state"), 300, now_ms=5, patterns=patterns, trigger={"processingTime": "1 second"})
    try:
        running.processAllAvailable()
        assert running.isActive
    finally:
        running.stop()
    assert [r["name"] for r in read_index(spark, path).nodes.filter("repo = 'r'").collect()] == ["a"]
