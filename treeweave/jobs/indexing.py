"""Jobs: index a whole tree, bring an index up to date with changed files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import comments, extract, maintain
from ..schemas import COMMENTS, EDGES, Index
from ..sources import store
from ..sources.files import language_of
from ..sources.parse import ERROR, Parser, parse_sources
from ..tables import cut

FILE = ["repo", "file_path"]


def extract_files(changed: DataFrame, parsers: dict[str, Parser] | None, now_ms: int, max_body: int = 2000) -> tuple[Index, DataFrame]:
    """The rows of changed files (repo, file_path, source, hash), and the files among them that a parser took."""
    syntax = cut(parse_sources(changed, parsers).filter(F.col("kind") != ERROR), "syntax")
    taken = changed.join(syntax.filter("node_id = 0").select(*FILE), FILE, "left_semi").withColumn("language", language_of(F.col("file_path")))
    symbols = cut(extract.symbols(syntax, taken, max_body), "symbols")
    return (
        Index(
            files=extract.file_records(taken, symbols, now_ms),
            nodes=extract.node_rows(symbols),
            edges=extract.call_edges(syntax, symbols).select(*EDGES.names),
            comments=comments.original_comments(syntax, taken, symbols).select(*COMMENTS.names),
        ),
        taken.select(*FILE),
    )


def update(index: Index, source_files: DataFrame, parsers: dict[str, Parser] | None, now_ms: int | None, max_body: int) -> tuple[Index, DataFrame | None]:
    """``incremental_update``, with the files that were indexed anew (None: nothing had changed)."""
    changed = cut(maintain.changed_files(source_files, index.files), "changed")
    if not changed.limit(1).count():
        return index, None
    new, taken = extract_files(changed, parsers, int(time.time() * 1000) if now_ms is None else now_ms, max_body)
    out = maintain.replace_file_rows(index, taken, new)
    out = out.with_(files=maintain.upsert_files(index.files, new.files))
    return out.with_(edges=maintain.resolve_edges(out.edges, out.nodes)), taken


def incremental_update(index: Index, source_files: DataFrame, parsers: dict[str, Parser] | None = None, now_ms: int | None = None, max_body: int = 2000) -> tuple[Index, bool]:
    """``index`` with new and changed files' rows replaced and calls resolved, and whether anything had changed.

    ``source_files`` may be any named files: only their extensions have to be known. Files that no parser takes leave the index as it is.
    """
    out, taken = update(index, source_files, parsers, now_ms, max_body)
    return out, taken is not None


def full_index(index: Index, source_files: DataFrame, parsers: dict[str, Parser] | None = None, now_ms: int | None = None, max_body: int = 2000) -> tuple[Index, DataFrame]:
    """``index`` brought up to date with a whole tree, calls always resolved, and a one-row summary.

    Files that vanished stay: ``maintain.delete_files`` removes them.
    """
    changed = cut(maintain.changed_files(source_files, index.files), "changed")
    new, taken = extract_files(changed, parsers, int(time.time() * 1000) if now_ms is None else now_ms, max_body)
    nodes_new = new.files.agg(F.count(F.lit(1)).alias("files_processed"), F.coalesce(F.sum("node_count"), F.lit(0)).alias("nodes_found"))
    out = maintain.replace_file_rows(index, taken, new)
    tried = out.edges.withColumn("_open", F.col("callee_id").isNull())
    resolved = cut(maintain.resolve_edges(tried, out.nodes), "edges")  # written once, counted and returned
    found = F.count_if(F.col("_open") & F.col("callee_id").isNotNull())
    summary = nodes_new.crossJoin(resolved.agg(found.alias("edges_resolved")))  # one row each
    return out.with_(files=maintain.upsert_files(index.files, new.files), edges=resolved.drop("_open")), summary


def reindex_report(index: Index, source_files: DataFrame, parsers: dict[str, Parser] | None = None, now_ms: int | None = None, max_body: int = 2000) -> tuple[Index, DataFrame]:
    """Bring named files up to date, and tell for each whether it was indexed anew: a parser took it, and it had changed."""
    out, taken = update(index, source_files, parsers, now_ms, max_body)
    asked = source_files.select(*FILE)
    if taken is None:
        report = asked.withColumn("reindexed", F.lit(False))
    else:
        report = asked.join(taken.withColumn("_taken", F.lit(True)), FILE, "left").select(*FILE, F.coalesce("_taken", F.lit(False)).alias("reindexed"))
    return out, cut(report, "report").withColumn("message", F.when(F.col("reindexed"), "indexed anew").otherwise("unchanged, or no parser takes it"))


def update_stored(
    path: str,
    source_files: DataFrame,
    removed: DataFrame | None = None,
    parsers: dict[str, Parser] | None = None,
    now_ms: int | None = None,
    max_body: int = 2000,
    stream: tuple[str, int] | None = None,
    tries: int = 5,
) -> DataFrame | None:
    """Delete ``removed`` files (repo, file_path) from the index at ``path``, then bring named files up to date, as ``incremental_update`` would.

    Only the repos that are named are read, and only rows that change are written. ``stream``: a stream's name and batch, which is passed over if the index has
    it already. A commit that another writer's overtakes is worked out again, up to ``tries`` times. Returns the files that
    were indexed anew; None if nothing was written.
    """
    spark = source_files.sparkSession
    removed = cut((source_files.select(*FILE).limit(0) if removed is None else removed.select(*FILE)).distinct(), "removed")
    named = source_files.select("repo").unionByName(removed.select("repo")).distinct().limit(store.NAMED + 1).collect()
    repos = [r[0] for r in named] if len(named) <= store.NAMED else None
    for attempt in range(tries):
        seen = store.snapshot(spark, path)
        if stream and seen.batch(stream[0]) >= stream[1]:
            return None
        index = store.read_snapshot(spark, seen, repos)
        left = index.files.join(removed, FILE, "left_anti")
        changed = cut(maintain.changed_files(source_files, left), "changed")
        some = changed.limit(1).count()
        if not some and not removed.limit(1).count():
            return None
        new, taken = extract_files(changed, parsers, int(time.time() * 1000) if now_ms is None else now_ms, max_body)
        taken = cut(taken, "taken")
        known = seen.resolved(repos)
        rows, gone = maintain.file_changes(index, removed, taken, new, bool(some), known)
        try:
            store.change_rows(spark, seen, rows, gone, repos, stream, tried=bool(some) and not known)
            return taken
        except store.Conflict:
            if attempt + 1 == tries:
                raise
    return None
