"""Properties that hold whatever the data: depth, partitions, storage, repeated work."""

import pytest
from pyspark.sql import functions as F

from treeweave import tables
from treeweave.fixtures import frame
from treeweave.operators import describe, graph, lookup, reports
from treeweave.queries import index_of, seeds_of, stand_in, typed
from treeweave.schemas import empty_index
from treeweave.sources import store
from treeweave.sources.store import read_index, write_index

DIR = "/root/testdata/sf0.001"


def test_deeper_reaches_more(spark):
    index = index_of(spark, DIR)
    seeds = seeds_of(index.nodes, "name").filter("seed LIKE 'Load1%'")
    found = [{(r["repo"], r["seed"], r["id"]) for r in graph.callees_of_names(index.nodes, index.edges, seeds, d).collect()} for d in (0, 1, 2, 4)]
    assert found[0] == found[1] <= found[2] <= found[3]


def test_partitions_dont_matter(spark):
    index = index_of(spark, DIR)
    names = frame(spark, DIR, "rq_names")

    def run():
        return sorted(map(str, reports.call_graph_report(index, names, 2).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_store_refuses(spark, tmp_path):
    index = empty_index(spark)
    bad = spark.createDataFrame([("r", "1", "t", "original", 5)], index.comments.schema)
    with pytest.raises(ValueError):
        write_index(index.with_(comments=bad), str(tmp_path / "a"))
    write_index(index, str(tmp_path / "b"))
    assert read_index(spark, str(tmp_path / "b")).nodes.count() == 0
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "none"))
    store.written_once(spark, f"{tmp_path}/b/commits/{9:020d}.json", '{"place": 9, "version": "v", "tables": [], "repos": [], "base": false, "resolved": true, "streams": {}, "schema_version": 0}')
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path / "b"))


def test_status_and_empty(spark):
    assert reports.index_status(empty_index(spark)).count() == 0
    pending = spark.createDataFrame([("r0", 3)], "repo string, pending bigint")
    rows = {r["repo"]: r["pending"] for r in reports.status_report(index_of(spark, DIR), pending).collect()}
    assert rows == {"r0": 3, "r1": 0, "r2": 0}


def test_unknown_requests_get_errors(spark):
    index = index_of(spark, DIR)
    asked = spark.createDataFrame([("r0", "nowhere")], "repo string, name string")
    assert reports.call_graph_report(index, asked).first()["error"] == reports.UNKNOWN_NAME
    paths = spark.createDataFrame([("r0", "no.ts")], "repo string, file_path string")
    assert reports.file_summary(index, paths).first()["error"] == reports.UNKNOWN_FILE
    for depth in (0, 6):
        with pytest.raises(ValueError):
            reports.call_graph_report(index, asked, depth)


def test_no_client_no_text(spark):
    nodes = frame(spark, DIR, "fx_nodes")
    prompts = describe.function_prompts(nodes)
    assert describe.generate_comments(prompts, None).filter("text IS NOT NULL").count() == 0
    notes = frame(spark, DIR, "fx_comments")
    assert describe.to_generate(prompts, notes, True).count() == prompts.count() > describe.to_generate(prompts, notes).count()
    bare = lookup.nodes_without_comments(nodes, notes, 5)
    assert bare.groupBy("repo").count().agg(F.max("count")).first()[0] == 5
    once = describe.write_back(notes, describe.generate_comments(prompts, stand_in), 9)
    twice = describe.write_back(once, describe.generate_comments(prompts, stand_in), 9)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_a_write_that_breaks_off_changes_nothing(spark, tmp_path):
    index, path = typed(index_of(spark, DIR)), str(tmp_path / "index")
    write_index(index, path)
    count = lambda: {n: t.count() for n, t in read_index(spark, path).tables().items()}
    before = count()
    half = index.with_(nodes=index.nodes.limit(3), files=index.files.limit(1))
    store.write_version(half, path)  # as if the driver had died before the commit
    assert count() == before
    write_index(half.with_(nodes=half.nodes.limit(0), files=half.files.limit(0), edges=half.edges.limit(0), comments=half.comments.limit(0)), path, ["r1"])
    assert {r[0] for r in read_index(spark, path).nodes.select("repo").distinct().collect()} == {"r0", "r2"}


def test_many_searches_find_the_same(spark, monkeypatch):
    nodes, asked = frame(spark, DIR, "fx_nodes"), frame(spark, DIR, "rq_search")
    names = nodes.filter("id % 5 = 0").select("repo", F.col("name").alias("query"), F.lit(None).cast("string").alias("type"), F.lit(9).alias("limit")).distinct()
    short = names.select("repo", F.lit("_a").alias("query"), "type", "limit").distinct()
    asked = asked.unionByName(names).unionByName(short)
    find = lambda: sorted(map(str, lookup.search_nodes(nodes, asked).select("repo", "query", "rank", "id").collect()))
    few = find()
    monkeypatch.setattr(tables, "SMALL", 0)
    assert find() == few and any("_a" in r for r in few)
    classes = lambda: sorted(map(str, describe.class_methods(nodes).collect()))
    many = classes()
    monkeypatch.setattr(tables, "SMALL", 100_000)
    assert classes() == many


def test_unknown_names_have_rows(spark):
    index = index_of(spark, DIR)
    asked = spark.createDataFrame([("r0", "nowhere"), ("r0", "nowhere")], "repo string, name string")
    for report in (reports.context_report, reports.comment_report):
        (row,) = report(index, asked).collect()
        assert (row["name"], row["id"], row["error"]) == ("nowhere", None, reports.UNKNOWN_NAME)
    (row,) = reports.call_graph_rows(index, asked).collect()
    assert (row["part"], row["error"]) == ("error", reports.UNKNOWN_NAME)


def test_lists_have_a_bound(spark):
    index, names = index_of(spark, DIR), frame(spark, DIR, "rq_names")
    whole = {(r["repo"], r["name_asked"]): r for r in reports.call_graph_report(index, names).collect()}
    for r in reports.call_graph_report(index, names, most=2).collect():
        full = whole[r["repo"], r["name_asked"]]
        for part in ("callers", "callees", "outgoing", "incoming"):
            assert (r[part] or []) == (full[part] or [])[:2] and (r[f"n_{part}"] or 0) == len(full[part] or [])


def test_status_of_style(spark):
    assert len({*describe.STYLE_EXAMPLES.values()}) == 12
    assert spark.range(1).select(describe.style_of(F.lit("zig"))).first()[0] == describe.STYLE_EXAMPLES["typescript"]
