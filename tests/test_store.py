"""The index on disk: what is written follows what changes; commits that come twice, too late, or break off."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from treeweave.jobs.indexing import full_index, incremental_update, update_stored
from treeweave.operators.maintain import delete_files
from treeweave.schemas import FILES, NODES, empty_index
from treeweave.sources import store
from treeweave.sources.store import add_rows, compact, read_index, vacuum, write_index
from treeweave.streaming import watch
from treeweave.tables import cut

TEXTS = "repo string, file_path string, source string"
PATHS = "repo string, file_path string"


def rows(index):
    """All rows of an index, with times left out; ids tell contents."""
    return {n: sorted(map(repr, (tuple(r) for r in t.drop("last_indexed").collect()))) for n, t in index.tables().items()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def text(rng, k):
    lines = [f"// does {k}\nfunction f{rng.randrange(12)}() {{ f{rng.randrange(12)}(); g{rng.randrange(3)}(); }}" for _ in range(rng.randrange(4))]
    return "\n".join([f"import x{k}", *lines]) + "\n"


def test_changes_equal_a_whole_update(spark, tmp_path):
    """Random edits and deletes, round after round: the same rows as without a store, whatever was resolved to what."""
    rng, path = random.Random(8), str(tmp_path / "index")
    names = [(r, f"{d}/{i}.ts") for r in ("p", "q") for d in ("a", "b") for i in range(3)]
    first = spark.createDataFrame([(*n, text(rng, k)) for k, n in enumerate(names)], TEXTS)
    whole, _ = full_index(empty_index(spark), first, now_ms=1)
    whole = whole.with_(**{n: cut(t, "whole") for n, t in whole.tables().items()})
    write_index(whole, path, resolved=True)
    for turn in range(2):
        edits = spark.createDataFrame([(*n, text(rng, k)) for k, n in enumerate(names) if rng.random() < 0.4] + [("p", f"new{turn}.ts", text(rng, turn))], TEXTS)
        dead = spark.createDataFrame(rng.sample(names, 2), PATHS)
        whole, _ = incremental_update(delete_files(whole, dead), edits, now_ms=2)
        whole = whole.with_(**{n: cut(t, "whole") for n, t in whole.tables().items()})
        assert update_stored(path, edits, dead, now_ms=2) is not None
        assert rows(read_index(spark, path)) == rows(whole)
        if turn == 0:
            compact(spark, path)
            assert rows(read_index(spark, path)) == rows(whole)
    assert rows(read_index(spark, path, ["q"]))["nodes"] == [r for r in rows(whole)["nodes"] if r.startswith("('q'")]


def test_open_calls_of_added_rows_are_tried(spark, tmp_path):
    path = str(tmp_path / "index")
    a, _ = full_index(empty_index(spark), spark.createDataFrame([("p", "a.ts", "function a() { b(); }\n"), ("z", "z.ts", "function z() {}\n")], TEXTS), now_ms=1)
    b, _ = full_index(empty_index(spark), spark.createDataFrame([("p", "b.ts", "function b() {}\n")], TEXTS), now_ms=1)
    write_index(a, path, resolved=True)
    add_rows(path, b)
    seen = store.snapshot(spark, path)
    assert not seen.resolved(["p"]) and not seen.resolved() and seen.resolved(["z"])
    update_stored(path, spark.createDataFrame([("p", "c.ts", "function c() {}\n")], TEXTS), now_ms=2)
    assert store.snapshot(spark, path).resolved(["p"])
    assert [r["callee_id"] is not None for r in read_index(spark, path).edges.collect()] == [True]


def test_what_is_written_follows_the_change(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.range(400).select(F.lit("p").alias("repo"), F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".ts")).alias("file_path"), F.concat(F.lit("function a"), F.col("id").cast("string"), F.lit("() { a"), (F.col("id") + 1).cast("string"), F.lit("(); /* "), F.sha2(F.col("id").cast("string"), 512), F.lit(" */ }\n")).alias("source"))
    index, _ = full_index(empty_index(spark), many, now_ms=1)
    write_index(index, path, resolved=True)
    before, count = size(path), {n: t.count() for n, t in read_index(spark, path).tables().items()}
    update_stored(path, spark.createDataFrame([("p", "f7.ts", "function other() {}\n")], TEXTS), now_ms=2)
    assert size(path) - before < before / 4
    seen = store.snapshot(spark, path)
    written = {n: spark.read.parquet(f"{path}/{n}/version={seen.commits[-1].version}").count() for n in seen.commits[-1].tables}
    # the file's own rows, and those of the one file that called into it
    assert written == {"files": 1, "nodes": 1, "edges": 1, "gone": 5}
    now = read_index(spark, path)
    assert {n: t.count() for n, t in now.tables().items()} == count | {"edges": count["edges"] - 1}
    assert now.edges.filter("callee_id IS NULL").count() == 2  # the call of what doesn't exist, and the one into the changed file
    assert update_stored(path, many.filter("file_path = 'f9.ts'")) is None and store.snapshot(spark, path).place == seen.place


def test_appends_read_nothing_and_are_all_or_none(spark, tmp_path):
    path = str(tmp_path / "index")
    write_index(empty_index(spark), path)
    node = lambda i: ("p", "a.ts", i, "n", "function", "s", 1, 1, 0, 1, None, "typescript", "")
    add_rows(path, empty_index(spark).with_(nodes=spark.createDataFrame([node("1")], NODES)))
    old = store.snapshot(spark, path).commits[-1]
    os.rename(f"{path}/nodes/version={old.version}", f"{path}/hidden")  # an append that read it would fail
    add_rows(path, empty_index(spark).with_(nodes=spark.createDataFrame([node("2")], NODES)))
    os.rename(f"{path}/hidden", f"{path}/nodes/version={old.version}")
    with pytest.raises(ValueError):
        add_rows(path, empty_index(spark).with_(files=spark.createDataFrame([("p", "b.ts", "h", "l", 1, 1)], FILES), nodes=spark.createDataFrame([node("3"), node(None)], NODES)))
    assert sorted(r["id"] for r in read_index(spark, path).nodes.collect()) == ["1", "2"] and read_index(spark, path).files.count() == 0


def test_a_lost_race(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    write_index(empty_index(spark), path, resolved=True)
    one = lambda r, f, s: spark.createDataFrame([(r, f, s)], TEXTS)
    seen = store.snapshot(spark, path)
    update_stored(path, one("p", "a.ts", "function a() {}\n"), now_ms=1)
    none = empty_index(spark)
    gone = spark.createDataFrame([], store.GONE)
    other = store.change_rows(spark, seen, none, gone, ["q"])  # of another repo: goes after
    assert other.place == seen.place + 2
    with pytest.raises(store.Conflict):
        store.change_rows(spark, seen, none, gone, ["p"])
    stale = [seen]
    real = store.snapshot
    monkeypatch.setattr(store, "snapshot", lambda s, p: stale.pop() if stale else real(s, p))
    update_stored(path, one("p", "b.ts", "function b() { a(); }\n"), now_ms=1)  # worked out again from what the other wrote
    index = read_index(spark, path)
    assert sorted(r["name"] for r in index.nodes.collect()) == ["a", "b"]
    assert index.edges.filter("callee_id IS NOT NULL").count() == 1


def test_a_batch_that_comes_twice(spark, tmp_path):
    path = str(tmp_path / "index")
    write_index(empty_index(spark), path, resolved=True)
    batch = lambda f, s, kind="change": spark.createDataFrame([("p", f, kind, dt.datetime(2024, 1, 1), 1, s)], TEXTS.replace("source string", "kind string, ts timestamp, seq bigint, source string"))
    apply = watch.apply_batch(path, now_ms=1, stream="s")
    apply(batch("a.ts", "function a() {}\n"), 4)
    place = store.snapshot(spark, path).place
    apply(batch("a.ts", "function never() {}\n"), 4)
    assert store.snapshot(spark, path).place == place
    compact(spark, path)
    apply(batch("a.ts", None, "unlink"), 3)  # compaction keeps what streams have brought
    assert [r["name"] for r in read_index(spark, path).nodes.collect()] == ["a"]
    watch.apply_batch(path, now_ms=1, stream="t")(batch("a.ts", None, "unlink"), 3)
    assert read_index(spark, path).nodes.count() == 0


def test_compaction_that_breaks_off_and_vacuum(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index, _ = full_index(empty_index(spark), spark.createDataFrame([("p", "a.ts", "// one\nfunction a() { a(); }\n"), ("p", "b.ts", "function b() {}\n")], TEXTS), now_ms=1)
    write_index(index, path, resolved=True)
    update_stored(path, spark.createDataFrame([("p", "b.ts", "function c() { a(); }\n")], TEXTS), now_ms=2)
    before, real = rows(read_index(spark, path)), store.commit
    monkeypatch.setattr(store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        compact(spark, path)
    monkeypatch.setattr(store, "commit", real)
    assert rows(read_index(spark, path)) == before
    compact(spark, path)
    assert vacuum(spark, path) == []  # all are too young to be removed
    assert len(vacuum(spark, path, 0)) == 3 and len(store.snapshot(spark, path).commits) == 1
    assert rows(read_index(spark, path)) == before and len([f for f in os.listdir(f"{path}/commits") if f.endswith(".json")]) == 1
    plan = read_index(spark, path).nodes._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_runs_are_those_of_a_plain_reading():
    """Events in any order and any parts leave the runs that a sorted reading leaves."""
    rng = random.Random(9)
    for _ in range(300):
        events = [(rng.randrange(60), k, rng.choice(["change", "unlink"]), None) for k in range(rng.randrange(1, 9))]
        plain = []
        for e in sorted(events, key=lambda e: e[:2]):
            if plain and e[0] - plain[-1][1] < 5:
                plain[-1][1:] = e
            else:
                plain.append([e[0], *e])
        rng.shuffle(events)
        cut = rng.randrange(len(events))
        assert watch.merged(watch.merged([], events[:cut], 5), events[cut:], 5) == plain


def test_deletes_dont_wait(spark, tmp_path):
    """A delete is out in the batch that brings it, and cancels the change before it; the watermark passes neither."""
    t = dt.datetime(2024, 1, 1)
    schema = "repo string, file_path string, kind string, ts timestamp, seq bigint, source string"
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    spark.createDataFrame([("r", "a.ts", "change", t, 1, "x"), ("r", "b.ts", "change", t, None, "y")], schema).write.parquet(folder)
    go = lambda: watch.debounced(spark.readStream.schema(schema).parquet(folder), 300).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    fired = lambda: sorted((r["file_path"], r["kind"], r["seq"], r["source"]) for r in spark.read.schema(schema).parquet(out).collect())
    go()
    assert fired() == [] and [tuple(r) for r in watch.waiting_files(spark, f"{out}-state").collect()] == [("r", 2)]
    spark.createDataFrame([("r", "a.ts", "unlink", t + dt.timedelta(milliseconds=100), 2, None)], schema).write.mode("append").parquet(folder)
    go()
    assert fired() == [("a.ts", "unlink", 2, None)] and [tuple(r) for r in watch.waiting_files(spark, f"{out}-state").collect()] == [("r", 1)]
    spark.createDataFrame([("z", "z.ts", "unlink", t + dt.timedelta(hours=1), 2**53 + 1, None)], schema).write.mode("append").parquet(folder)
    go()
    assert fired() == [("a.ts", "unlink", 2, None), ("b.ts", "change", None, "y"), ("z.ts", "unlink", 2**53 + 1, None)]
    assert watch.waiting_files(spark, f"{out}-state").count() == 0
