"""Comments of symbols: the lines above them, or a Python docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WHITE, trim
from .extract import FILE


def marked(line: Column) -> Column:
    """Whether a trimmed line is a comment's."""
    return F.rlike(line, F.lit(r"(?s)^(?://|#|\*|/\*).*"))


def comment_text(lines: Column) -> Column:
    """The text of a comment's trimmed lines, or null if nothing is left but marks."""
    bare = F.transform(lines, lambda x: trim(F.regexp_replace(x, rf"^(?:///?[{WHITE}]?|/\*\*?[{WHITE}]?|\*/?[{WHITE}]?|#[{WHITE}]?)", "")))
    return F.nullif(F.array_join(F.filter(bare, lambda x: x != ""), "\n"), F.lit(""))


def preceding_comment(lines: Column, row: Column) -> Column:
    """The comment in ``lines`` that ends right above line ``row`` (0-based), or null.

    Going up: blank lines are passed until a comment line came; the first other line ends it. Marks at the start of a line are
    taken off once; lines that are then empty are left out.
    """
    above = F.reverse(F.transform(F.slice(lines, 1, F.greatest(row, F.lit(0))), trim))
    # how far up it goes: past blanks, then past comment lines
    begin = F.aggregate(above, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda s, x: F.struct((s["n"] + F.when(~s["done"] & (x == ""), 1).otherwise(0)).alias("n"), (s["done"] | (x != "")).alias("done")))["n"]
    rest = F.slice(above, begin + 1, F.greatest(F.size(above) - begin, F.lit(0)))
    kept = F.aggregate(rest, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda s, x: F.struct((s["n"] + F.when(~s["done"] & marked(x), 1).otherwise(0)).alias("n"), (s["done"] | ~marked(x)).alias("done")))["n"]
    return comment_text(F.reverse(F.slice(rest, 1, kept)))


def comment_runs(files: DataFrame) -> DataFrame:
    """(repo, file_path, at, until, lines) for each run of comment lines: where it begins, the next line after it that isn't blank (null: none), its lines, trimmed.

    ``files``: (repo, file_path, source). Each step is one pass over a file's lines, which are named columns so that no step works them out again for each line.
    """
    lines = F.transform(F.split("source", "\n"), lambda x, i: F.struct(i.alias("at"), trim(x).alias("text")))
    shown = files.select(*FILE, F.transform(F.filter(lines, lambda s: s["text"] != ""), lambda s: F.struct(s["at"], s["text"], marked(s["text"]).alias("marked"))).alias("_shown"))
    near = lambda k, step: F.get("_shown", k + step)
    apart = lambda s, other, step: ~F.coalesce(other["marked"] & (other["at"] == s["at"] + step), F.lit(False))
    bound = lambda step: F.filter(F.transform("_shown", lambda s, k: F.when(s["marked"] & apart(s, near(k, step), step), k)), lambda k: k.isNotNull())
    bounds = shown.withColumn("_bounds", F.arrays_zip(bound(-1).alias("begin"), bound(1).alias("end")))
    run = lambda b: F.struct(
        F.get("_shown", b["begin"])["at"].alias("at"),
        F.get("_shown", b["end"] + 1)["at"].alias("until"),
        F.transform(F.slice("_shown", b["begin"] + 1, b["end"] - b["begin"] + 1), lambda s: s["text"]).alias("lines"),
    )
    return bounds.select(*FILE, F.explode(F.transform("_bounds", run)).alias("_run")).select(*FILE, "_run.*")


def comment_lines(files: DataFrame, places: DataFrame, depth: int = 0) -> DataFrame:
    """``places`` (repo, file_path, start_row, ...) with ``preceding``; ``files``: (repo, file_path, source).

    A file costs its lines and its symbols, not their pairs: its lines are read once, and one pass over its runs of comment lines and its symbols, in page order,
    brings each symbol the last run that begins above it. ``depth`` > 0 looks at no more lines than that above a symbol.
    """
    runs = comment_runs(files.filter("repo IS NOT NULL AND file_path IS NOT NULL")).select(*FILE, F.col("at").alias("_at"), F.lit(1).alias("_turn"), F.struct("at", "until", "lines").alias("_run"))
    asked = places.select(*FILE, F.col("start_row").alias("_at"), F.lit(0).alias("_turn"), F.struct(*(F.col(c) for c in places.columns)).alias("_place"))
    above = Window.partitionBy(*FILE).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(runs, allowMissingColumns=True).withColumn("_run", F.last("_run", ignorenulls=True).over(above))
    found = both.filter(F.col("_place").isNotNull()).select("_place.*", "_run")
    row, run = F.col("start_row"), F.col("_run")
    over = F.greatest(row - depth - run["at"], F.lit(0)) if depth else F.lit(0)
    count = F.least(row - run["at"], F.size(run["lines"])) - over
    ends = (count > 0) & (run["until"].isNull() | (row <= run["until"]))  # no other line between the run and the symbol
    return found.withColumn("preceding", F.when(ends, comment_text(F.slice(run["lines"], over + 1, F.greatest(count, F.lit(0)))))).drop("_run")


def docstrings(syntax: DataFrame) -> DataFrame:
    """(repo, file_path, node_id, docstring): the string that begins a node's body, without triple quotes, trimmed."""
    bodies = syntax.filter(F.col("field") == "body").select(*FILE, F.col("parent_node_id").alias("owner"), F.col("node_id").alias("body"), "child_index")
    bodies = bodies.groupBy(*FILE, "owner").agg(F.min_by("body", "child_index").alias("body"))
    first = syntax.filter(F.col("child_index") == 0)
    statement = first.filter(F.col("kind") == "expression_statement").select(*FILE, F.col("parent_node_id").alias("body"), F.col("node_id").alias("statement"))
    string = first.filter(F.col("kind") == "string").select(*FILE, F.col("parent_node_id").alias("statement"), "text")
    found = bodies.join(statement, [*FILE, "body"]).join(string, [*FILE, "statement"])
    text = trim(F.regexp_replace(F.regexp_replace("text", r"^(?:\"\"\"|''')", ""), r"(?:\"\"\"|''')$", ""))
    return found.select(*FILE, F.col("owner").alias("node_id"), text.alias("docstring"))


def original_comments(syntax: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Comment rows (``schemas.COMMENTS``) of the symbols in ``nodes`` (``extract.symbols``, with node_id).

    In Python a docstring counts, even an empty one, before the lines above. Imports and exports have no comments; empty ones are no rows.
    """
    own = nodes.filter(~F.col("type").isin("import", "export")).select(*FILE, "node_id", "id", "language", (F.col("start_line") - 1).alias("start_row"))
    own = comment_lines(files, own).join(docstrings(syntax), [*FILE, "node_id"], "left")
    text = F.when(F.col("language") == "python", F.coalesce("docstring", "preceding")).otherwise(F.col("preceding"))
    rows = own.withColumn("text", text).filter(F.coalesce("text", F.lit("")) != "")
    return rows.select("repo", F.col("id").alias("node_id"), "text", F.lit("original").alias("source"), F.lit(None).cast("bigint").alias("generated_at"))
