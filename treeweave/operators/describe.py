"""Comment generation in bulk: prompts, targets, calls to a user's model client, writing back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import Empty, Queue
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trim
from ..schemas import check_range, node_order_columns
from ..sources.files import file_system
from ..tables import cut
from .lookup import holding, nodes_without_comments
from .maintain import replace_generated

#: One documentation comment for each language, as its programmers write them.
STYLE_EXAMPLES = {
    "typescript": "/** Opens the log and rotates it when it is a day old. */",
    "tsx": "/** A list of open tickets, the oldest on top. */",
    "javascript": "/** Waits until every pending request has been answered. */",
    "python": '"""Yield the rows of a sheet that have a date."""',
    "java": "/** Returns the seats that are still free on this flight. */",
    "csharp": "/// <summary>Reads the next frame, or null at the end of the stream.</summary>",
    "go": "// Retry runs fn again, at growing intervals, until it succeeds.",
    "rust": "/// Splits the buffer at the last whole record.",
    "c": "/* Number of bytes that the encoder still has to flush. */",
    "cpp": "/// Moves all nodes of the other list to the end of this one.",
    "ruby": "# Names of the subscribers who asked for the weekly letter.",
    "php": "/** Renders the invoice in the customer's language. */",
}
OTHER_STYLE = STYLE_EXAMPLES["typescript"]
CLASS_TYPES = ["class", "interface", "struct", "trait"]
METHODS, BODY = 50, 1500


def style_of(language: Column) -> Column:
    """The language's example; that of typescript for others."""
    styles = F.create_map(*[F.lit(x) for kv in STYLE_EXAMPLES.items() for x in kv])
    return F.coalesce(F.try_element_at(styles, language), F.lit(OTHER_STYLE))


def system_text(what: str) -> Column:
    return F.concat(F.lit(f"Write a short documentation comment for this {what}, one to three sentences, in the manner of "), F.col("language"), F.lit(". Answer with the comment's text only."))


def function_prompts(nodes: DataFrame) -> DataFrame:
    """(repo, id, system, user) for functions and methods: language, style, signature and the body's first 1500 characters."""
    user = F.format_string("Language: %s\nStyle: %s\n\nSignature:\n%s\n\nBody:\n%s", "language", style_of(F.col("language")), "signature", F.substring("body_text", 1, BODY))
    return nodes.filter(F.col("type").isin("function", "method")).select("repo", "id", system_text("function").alias("system"), user.alias("user"))


def class_methods(nodes: DataFrame, methods: str = "named") -> DataFrame:
    """(repo, id, names): a class's methods in order.

    ``named``: of the first 50 methods of the repo whose name holds the class's name, those in the class's file. ``contained``: those
    within the class's lines, a join on the file.
    """
    classes = nodes.filter(F.col("type").isin(CLASS_TYPES)).select("repo", "id", F.col("name").alias("class_name"), F.col("file_path").alias("class_file"), F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    own = nodes.filter(F.col("type") == "method")
    if methods == "contained":
        inside = (F.col("file_path") == F.col("class_file")) & (F.col("start_line") >= F.col("from_line")) & (F.col("end_line") <= F.col("to_line"))
        own = own.withColumnRenamed("id", "method_id")
        found = classes.join(own, (classes["repo"] == own["repo"]) & inside).drop(own["repo"])
    elif methods == "named":
        names = classes.select("repo", F.col("class_name").alias("query")).distinct()
        hits = holding(own, names, METHODS).withColumnRenamed("query", "class_name")
        first = hits.withColumn("_k", F.row_number().over(Window.partitionBy("repo", "class_name").orderBy(*node_order_columns()))).filter(F.col("_k") <= METHODS).withColumnRenamed("id", "method_id")
        found = classes.join(first, ["repo", "class_name"]).filter(F.col("file_path") == F.col("class_file"))
    else:
        raise ValueError(f"methods must be named or contained, not {methods}")
    one = F.struct("file_path", "start_line", "start_col", (-F.col("end_line")).alias("u"), (-F.col("end_col")).alias("v"), "method_id", "name")
    return found.groupBy("repo", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"]), ", ").alias("names"))


def class_prompts(nodes: DataFrame, methods: str = "named") -> DataFrame:
    """(repo, id, system, user) for classes and the like: name, signature and methods, or ``none``."""
    own = nodes.filter(F.col("type").isin(CLASS_TYPES)).join(class_methods(nodes, methods), ["repo", "id"], "left")
    user = F.format_string("Language: %s\nStyle: %s\n\nClass: %s\nSignature: %s\nMethods: %s", "language", style_of(F.col("language")), "name", "signature", F.coalesce("names", F.lit("none")))
    return own.select("repo", "id", system_text("class").alias("system"), user.alias("user"))


def generation_targets(nodes: DataFrame, comments: DataFrame, limit: int | None = 100) -> DataFrame:
    return nodes_without_comments(nodes, comments, limit)


Client = Callable[[str, str, float, int, float], str]


def asked(call: Client, system: str, user: str, deadline: float) -> tuple[str | None, str | None]:
    """One call's text and error. A call that isn't back after ``deadline`` seconds is an error, whether it heeds its timeout or hangs: its thread is left to itself."""
    done: Queue[tuple[str | None, str | None]] = Queue()

    def run() -> None:
        try:
            done.put(((call(system, user, 0.3, 500, deadline) or "").strip() or None, None))
        except Exception as e:
            done.put((None, f"{type(e).__name__}: {e}"))

    Thread(target=run, daemon=True).start()
    try:
        return done.get(timeout=deadline)
    except Empty:
        return None, f"TimeoutError: no answer within {deadline:g} seconds"


class Answers:
    """Answers kept in a folder by their prompts' digests, a small file each, written as they come."""

    def __init__(self, folder: str):
        self.system, self.base = file_system(folder)

    def place(self, digest: str) -> str:
        return f"{self.base}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> tuple[str | None] | None:
        """The answer in a tuple; None if there is none yet."""
        try:
            with self.system.open_input_stream(self.place(digest)) as f:
                return (json.loads(f.read())["text"],)
        except FileNotFoundError:
            return None

    def put(self, digest: str, text: str | None) -> None:
        place = self.place(digest)
        temporary = f"{place}.{uuid.uuid4().hex}"
        self.system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with self.system.open_output_stream(temporary) as f:
            f.write(json.dumps({"text": text}).encode())
        self.system.move(temporary, place)


def generate_comments(
    prompts: DataFrame, client: Callable[[], Client] | None, max_concurrent: int = 3, tasks: int | None = None, answers: str | None = None, deadline: float = 30.0, in_flight: int | None = None
) -> DataFrame:
    """``prompts`` (repo, id, system, user) with ``text`` and ``error``: at most ``max_concurrent`` calls at a time in a task.

    ``client``: a picklable factory, called once a task, of a function (system, user, temperature, max_tokens, timeout in seconds)
    -> text. None: nothing is generated. Empty answers are null; an error is its own row's only. A call that isn't back after ``deadline`` seconds is given up,
    even if it hangs. ``in_flight`` bounds the calls at a time over the whole cluster (``tasks`` does, too, times ``max_concurrent``).

    ``answers``: a folder, shared by all tasks, where answers are kept as they come. Then equal prompts are sent once, and a task that starts
    again, or a job that is run again, asks only for what isn't there; errors are not kept. Without it a retry calls again: write the result before using it.
    """
    check_range("maxConcurrent", max_concurrent, 1, 10)
    if client is None:
        return prompts.select("repo", F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    if in_flight is not None:
        max_concurrent = min(max_concurrent, check_range("in_flight", in_flight, 1, 1_000_000))
        tasks = min(tasks or in_flight, in_flight // max_concurrent)
    rows = prompts.select("repo", F.col("id").cast("string").alias("id"), "system", "user", F.sha2(F.to_json(F.array("system", "user")), 256).alias("digest"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, kept = client(), Answers(answers) if answers else None

        def one(system: str, user: str, digest: str) -> tuple[str | None, str | None]:
            known = kept.get(digest) if kept else None
            if known:
                return known[0], None
            text, error = asked(call, system, user, deadline)
            if kept and error is None:
                kept.put(digest, text)
            return text, error

        with ThreadPoolExecutor(max_concurrent) as pool:
            for x in batches:
                done = [*pool.map(one, x["system"], x["user"], x["digest"])]
                yield x[[c for c in ("repo", "id") if c in x] or ["digest"]].assign(text=[d[0] for d in done], error=[d[1] for d in done])

    if not answers:
        return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, "repo string, id string, text string, error string")
    distinct = rows.groupBy("digest").agg(F.first("system").alias("system"), F.first("user").alias("user"))
    found = (distinct.repartition(tasks) if tasks else distinct).mapInPandas(run, "digest string, text string, error string")
    return rows.select("repo", "id", "digest").join(cut(found, "answers"), "digest").select("repo", "id", "text", "error")


def to_generate(prompts: DataFrame, comments: DataFrame, always_generate: bool = False) -> DataFrame:
    """Prompts of nodes that need a call: an original comment is answer enough unless ``always_generate``."""
    if always_generate:
        return prompts
    return prompts.join(comments.filter("source = 'original'").select("repo", F.col("node_id").alias("id")).distinct(), ["repo", "id"], "left_anti")


def write_back(comments: DataFrame, generated: DataFrame, now_ms: int) -> DataFrame:
    """``comments`` with the texts of ``generated`` (repo, id, text) in place of the same nodes' generated ones."""
    new = generated.filter(F.col("text").isNotNull()).select("repo", F.col("id").cast(comments.schema["node_id"].dataType).alias("node_id"), trim(F.col("text")).alias("text"), F.lit(now_ms).cast("bigint").alias("generated_at"))
    return replace_generated(comments, new)


def outcome_counts(generated: DataFrame) -> DataFrame:
    """How many got a text and how many were skipped, errors among the latter, counted apart too."""
    return generated.groupBy("repo").agg(F.count_if(F.col("text").isNotNull()).alias("success"), F.count_if(F.col("text").isNull()).alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("errors"))
