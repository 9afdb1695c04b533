"""Source trees: reading files, languages by extension, which paths count, ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, trim
from ..tables import cut

#: The languages and their extensions.
LANGUAGE_EXTENSIONS = {
    "typescript": [".ts"],
    "tsx": [".tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs"],
    "python": [".py", ".pyw"],
    "java": [".java"],
    "csharp": [".cs"],
    "go": [".go"],
    "rust": [".rs"],
    "c": [".c", ".h"],
    "cpp": [".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx"],
    "ruby": [".rb"],
    "php": [".php"],
}
#: What is indexed and left out unless the caller says otherwise (names that begin with a dot always are left out).
DEFAULT_LANGUAGES = ["typescript", "javascript", "python", "java", "csharp", "go", "rust", "c", "cpp", "ruby", "php"]
DEFAULT_IGNORED = ["node_modules", ".git", "dist", "build", "out", "__pycache__", ".venv", "venv", "vendor", "target", ".next", "coverage"]
MAX_DEPTH = 20
#: Bytes of files that a task reads, and hands on, at a time; and what opening a file costs, in bytes.
READ, OPENED = 16 << 20, 64 << 10


def language_of(path: Column) -> Column:
    """The language of a path by its last extension, in any case; null if none has it."""
    by_extension = F.create_map(*[F.lit(x) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts for x in (e, lang)])
    return F.try_element_at(by_extension, F.lower(extension(path)))


def keep_path(path: Column, ignored: list[str] | None = None, languages: list[str] | None = None) -> Column:
    """Whether a relative path is indexed: no segment ignored or dotted, not too deep, extension enabled in this very case."""
    ignored = DEFAULT_IGNORED if ignored is None else ignored
    enabled = [e for lang in (DEFAULT_LANGUAGES if languages is None else languages) for e in LANGUAGE_EXTENSIONS.get(lang, [])]
    segments = F.split(path, "/")
    dropped = F.exists(segments, lambda s: s.isin(ignored) | s.startswith("."))
    return ~dropped & (F.size(segments) - 1 <= MAX_DEPTH) & extension(path).isin(enabled)


def list_tree(spark: SparkSession, root: str, ignored: list[str] | None = None) -> DataFrame:
    """(file_path, size, error) of all files below ``root``, a local path or a URI, level by level; ignored and dotted names aren't entered.

    A folder that can't be listed has one row, with the error, and the rest goes on. The listing is made in tasks with Arrow's file systems: Spark's own
    readers skip names that begin with an underscore.
    """
    ignored = DEFAULT_IGNORED if ignored is None else ignored
    schema = "file_path string, folder boolean, size bigint, error string"

    def children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(root)
        for x in batches:
            for folder in x["file_path"]:
                try:
                    infos = system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=False))
                except Exception as e:
                    yield pd.DataFrame([(folder, False, 0, f"{type(e).__name__}: {e}")], columns=["file_path", "folder", "size", "error"])
                    continue
                names = [(f"{folder}/{i.base_name}".lstrip("/"), i.type == fs.FileType.Directory, i.size or 0, None) for i in infos if not i.base_name.startswith(".") and i.base_name not in ignored]
                yield pd.DataFrame(names, columns=["file_path", "folder", "size", "error"])

    level = spark.createDataFrame([("",)], "file_path string")
    found = None
    for _ in range(MAX_DEPTH + 1):
        below = cut(level.mapInPandas(children, schema), "listing")
        files = below.filter("NOT folder").select("file_path", "size", "error")
        found = files if found is None else found.unionByName(files)
        level = below.filter("folder").select("file_path").repartition(spark.sparkContext.defaultParallelism)
        if not below.filter("folder").limit(1).count():
            break
    return found


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a local path or a URI."""
    if "://" in root or root.startswith("file:"):
        system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
        return system, base.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")


def scan_source_tree(spark: SparkSession, root: str, repo: str, ignored: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(repo, file_path, source, error) of a folder: a row for each file that is kept, and for each file or folder that can't be read, with the error.

    Paths are filtered before any file is opened. Files are dealt out by their sizes, in parts of about READ bytes, and handed on by as many. Bytes that aren't
    UTF-8 are replaced.
    """
    listed = cut(list_tree(spark, root, ignored), "tree")
    failed = listed.filter("error IS NOT NULL").select(F.lit(repo).alias("repo"), "file_path", F.lit(None).cast("string").alias("source"), "error")
    kept = listed.filter("error IS NULL").filter(keep_path(F.col("file_path"), ignored, languages)).select("file_path", "size")
    # an opened file counts as some bytes, so that many small ones are dealt out, too
    parts = kept.agg(F.ceil(F.sum(F.col("size") + OPENED) / READ)).first()[0] or 1

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = file_system(root)
        rows: list[tuple[str, str, str | None, str | None]] = []
        size = 0
        for x in batches:
            for path in x["file_path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                    rows.append((repo, path, data.decode("utf-8", "replace"), None))
                    size += len(data)
                except Exception as e:
                    rows.append((repo, path, None, f"{type(e).__name__}: {e}"))
                if size >= READ or len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=["repo", "file_path", "source", "error"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["repo", "file_path", "source", "error"])

    found = kept.select("file_path").repartition(max(int(parts), spark.sparkContext.defaultParallelism)).mapInPandas(texts, "repo string, file_path string, source string, error string")
    return found.unionByName(failed)


def read_source_tree(spark: SparkSession, root: str, repo: str, ignored: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """source_files(repo, file_path, source) of a folder; what can't be read is passed over (``scan_source_tree`` tells what)."""
    return scan_source_tree(spark, root, repo, ignored, languages).filter("error IS NULL").drop("error")


def ignore_patterns(lines: DataFrame, configured: list[str]) -> DataFrame:
    """Patterns (repo, pattern, place): the configured ones, then the ignore files' lines (repo, line_no, line), each once."""
    text = trim(F.col("line"))
    own = lines.select("repo", F.col("line_no").cast("long").alias("place"), text.alias("pattern"))
    own = own.filter((F.col("pattern") != "") & ~F.col("pattern").startswith("#") & ~F.col("pattern").startswith("!"))
    first = F.explode(F.array(*[F.struct(F.lit(i - len(configured)).cast("long").alias("place"), F.lit(p).alias("pattern")) for i, p in enumerate(configured)])) if configured else None
    both = own if first is None else own.unionByName(lines.select("repo").distinct().select("repo", first.alias("x")).select("repo", "x.place", "x.pattern"))
    return both.groupBy("repo", "pattern").agg(F.min("place").alias("place"))


def glob_regex(pattern: Column) -> Column:
    """A glob as an anchored regex: ``**`` is anything, ``*`` stays in a segment; a bare name stands for it anywhere and all below."""
    bare = ~F.contains(pattern, F.lit("*")) & ~F.contains(pattern, F.lit("/"))
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^$|])", r"\\$1")
    starred = F.regexp_replace(quoted, r"\*\*/", "\x01")
    starred = F.regexp_replace(F.regexp_replace(starred, r"/\*\*$", "\x02"), r"\*\*", "\x03")
    starred = F.regexp_replace(starred, r"\*", "[^/]*")
    starred = F.replace(F.replace(F.replace(starred, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit("(?:/.*)?")), F.lit("\x03"), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), F.when(bare, F.concat(F.lit("(?:.*/)?"), quoted, F.lit("(?:/.*)?"))).otherwise(starred), F.lit("$"))


def watch_kept(paths: DataFrame, patterns: DataFrame, path: str = "file_path") -> DataFrame:
    """``paths`` (repo, a path, ...) that no pattern of their repo and no dot segment rules out.

    A repo's patterns are gathered into one list, so a path is tested in its own row, whatever the number of paths.
    """
    lists = patterns.groupBy("repo").agg(F.collect_list(glob_regex(F.col("pattern"))).alias("_globs"))
    dotted = F.exists(F.split(F.col(path), r"[/\\]"), lambda s: s.startswith("."))
    hit = F.exists(F.coalesce("_globs", F.array().cast("array<string>")), lambda g: F.rlike(F.col(path), g))
    return paths.join(lists, "repo", "left").filter(~dotted & ~hit).drop("_globs")
