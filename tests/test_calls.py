"""Calls to a model that are kept, given up, and bounded; trees with what can't be read."""

import os
import threading
import time

import pytest

from treeweave.operators import describe
from treeweave.sources.files import read_source_tree, scan_source_tree

PROMPTS = "repo string, id string, system string, user string"


@pytest.fixture
def prompts(spark):
    return spark.createDataFrame([("r", str(i), "s", f"about {i % 12}") for i in range(16)], PROMPTS).coalesce(1)


def logging_client(log, dies_after=None, fails=()):
    def make():
        def call(system, user, temperature, most, timeout):
            if dies_after is not None and os.path.exists(log) and len(open(log).read().split("\n")) > dies_after:
                os._exit(1)  # the worker is killed before it sends this one
            with open(log, "a") as f:
                f.write(user + "\n")
            if user in fails:
                raise RuntimeError("busy")
            return "" if user.endswith("5") else user.upper()

        return call

    return make


def test_a_killed_task_sends_no_prompt_twice(spark, prompts, tmp_path):
    log, kept = str(tmp_path / "log"), f"file://{tmp_path}/answers"
    with pytest.raises(Exception):  # noqa: B017
        describe.generate_comments(prompts, logging_client(log, dies_after=5), 1, 1, answers=kept).collect()
    sent = open(log).read().split()
    assert len(sent) == 2 * 5  # two words each
    found = {r["id"]: (r["text"], r["error"]) for r in describe.generate_comments(prompts, logging_client(log), 3, 1, answers=kept).collect()}
    lines = open(log).read().strip().split("\n")
    assert sorted(lines) == sorted({f"about {i}" for i in range(12)})  # equal prompts once, none again
    assert found == {str(i): (None if i % 12 == 5 else f"ABOUT {i % 12}", None) for i in range(16)}
    describe.generate_comments(prompts, logging_client(log), 3, 2, answers=kept).collect()
    assert open(log).read().strip().split("\n") == lines


def test_errors_are_asked_again(spark, prompts, tmp_path):
    log, kept = str(tmp_path / "log"), str(tmp_path / "answers")
    first = describe.generate_comments(prompts, logging_client(log, fails=["about 3"]), answers=kept).filter("error IS NOT NULL").collect()
    assert {(r["id"], r["error"]) for r in first} == {("3", "RuntimeError: busy"), ("15", "RuntimeError: busy")}
    assert describe.generate_comments(prompts, logging_client(log), answers=kept).filter("error IS NOT NULL").count() == 0
    assert open(log).read().strip().split("\n").count("about 3") == 2


def test_a_client_that_hangs_is_given_up(spark, prompts):
    def make():
        def call(system, user, *_):
            if user == "about 2":
                threading.Event().wait()
            return user

        return call

    began = time.time()
    found = {r["id"]: r["error"] for r in describe.generate_comments(prompts, make, 1, 1, deadline=0.5).collect()}
    assert time.time() - began < 60
    assert {i for i, e in found.items() if e} == {"2", "14"} and found["2"].startswith("TimeoutError")


def test_calls_in_flight_have_a_bound(spark, tmp_path):
    many = spark.createDataFrame([("r", str(i), "s", f"{i}") for i in range(40)], PROMPTS).repartition(8)
    folder = str(tmp_path)

    def make():
        def call(system, user, *_):
            mark = f"{folder}/on-{user}"
            open(mark, "w").close()
            on = sum(n.startswith("on-") for n in os.listdir(folder))
            time.sleep(0.02)
            os.remove(mark)
            return str(on)

        return call

    assert max(int(r["text"]) for r in describe.generate_comments(many, make, 2, in_flight=4).collect()) <= 4
    assert max(int(r["text"]) for r in describe.generate_comments(many, make, 3, in_flight=1).collect()) == 1
    with pytest.raises(ValueError):
        describe.generate_comments(many, make, 2, in_flight=0)


def test_a_tree_with_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.py", "lost.py"):
        (tmp_path / "a" / name).write_text("x = 1\n")
    os.symlink(tmp_path / "a" / "round", tmp_path / "a" / "round")
    scanned, read = scan_source_tree(spark, str(tmp_path), "r"), read_source_tree(spark, str(tmp_path), "r")
    (tmp_path / "a" / "lost.py").unlink()  # between listing and reading
    assert {r["file_path"]: (r["source"], r["error"] is None) for r in scanned.collect()} == {"a/x.py": ("x = 1\n", True), "a/lost.py": (None, False)}
    assert [r["file_path"] for r in read.collect()] == ["a/x.py"]
    gone = scan_source_tree(spark, str(tmp_path / "none"), "r").collect()
    assert [(r["file_path"], r["source"]) for r in gone] == [("", None)] and "FileNotFound" in gone[0]["error"]
