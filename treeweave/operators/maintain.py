"""Keeping an index current: changed files, replacing and deleting their rows, resolving calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGES, Index, node_order
from ..tables import cut, if_small

FILE = ["repo", "file_path"]
#: What ``node_order`` looks at.
NODE_ORDER = ["file_path", "start_line", "start_col", "end_line", "end_col", "id"]


def content_hash(text):
    """SHA-256 of the text, as hex."""
    return F.sha2(text, 256)


def changed_files(source_files: DataFrame, files: DataFrame) -> DataFrame:
    """``source_files`` (repo, file_path, source) that are new or have another hash than in ``files``; with ``hash``."""
    known = files.select(*FILE, F.col("hash").alias("_old"))
    hashed = source_files.withColumn("hash", content_hash(F.col("source")))
    return hashed.join(known, FILE, "left").filter(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def replace_file_rows(index: Index, changed: DataFrame, new: Index) -> Index:
    """The rows of the ``changed`` files (repo, file_path) give way to ``new``'s. Calls from elsewhere into them become unresolved."""
    paths = changed.select(*FILE).distinct()
    gone = index.nodes.join(paths, FILE, "left_semi").select("repo", "id")
    edges = index.edges.join(gone.withColumnRenamed("id", "caller_id"), ["repo", "caller_id"], "left_anti")
    edges = edges.join(gone.select("repo", F.col("id").alias("callee_id"), F.lit(True).alias("_gone")), ["repo", "callee_id"], "left")
    edges = edges.withColumn("callee_id", F.when(F.col("_gone").isNull(), F.col("callee_id"))).select(index.edges.columns)
    comments = index.comments.join(gone.withColumnRenamed("id", "node_id"), ["repo", "node_id"], "left_anti").select(index.comments.columns)
    nodes = index.nodes.join(paths, FILE, "left_anti")
    return index.with_(
        nodes=nodes.select(index.nodes.columns).unionByName(new.nodes),
        edges=edges.unionByName(new.edges),
        comments=comments.unionByName(new.comments),
    )


def upsert_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """``records`` take the place of the files of the same (repo, file_path)."""
    return files.join(records.select(*FILE), FILE, "left_anti").select(files.columns).unionByName(records.select(files.columns))


def delete_files(index: Index, paths: DataFrame) -> Index:
    """All rows of these files go, and all calls from or into them."""
    paths = paths.select(*FILE).distinct()
    gone = index.nodes.join(paths, FILE, "left_semi").select("repo", "id")
    edges = index.edges
    for c in ("caller_id", "callee_id"):
        edges = edges.join(gone.withColumnRenamed("id", c), ["repo", c], "left_anti")
    return Index(
        files=index.files.join(paths, FILE, "left_anti").select(index.files.columns),
        nodes=index.nodes.join(paths, FILE, "left_anti").select(index.nodes.columns),
        edges=edges.select(index.edges.columns),
        comments=index.comments.join(gone.withColumnRenamed("id", "node_id"), ["repo", "node_id"], "left_anti").select(index.comments.columns),
    )


def resolve_edges(edges: DataFrame, nodes: DataFrame, prefer_same_file: bool = False) -> DataFrame:
    """Unresolved edges get the first node of their repo that has the called name; those without one stay unresolved.

    ``prefer_same_file``: a node of the caller's file comes first. One row for each name is joined, so edges don't multiply, and a
    name that a third of them call is split by Spark's skew handling.
    """
    first = nodes.groupBy("repo", F.col("name").alias("callee_name")).agg(F.min_by("id", node_order()).alias("_any"))
    out = edges.join(first, ["repo", "callee_name"], "left")
    found = F.col("_any")
    if prefer_same_file:
        near = nodes.groupBy("repo", "file_path", F.col("name").alias("callee_name")).agg(F.min_by("id", node_order()).alias("_near"))
        out = out.join(near, ["repo", "file_path", "callee_name"], "left")
        found = F.coalesce("_near", "_any")
    return out.withColumn("callee_id", F.coalesce("callee_id", found)).select(edges.columns)


def file_changes(index: Index, removed: DataFrame, taken: DataFrame, new: Index, resolve: bool = True, resolved: bool = True) -> tuple[Index, DataFrame]:
    """What deleting the ``removed`` files, then replacing the ``taken`` ones by ``new``, and resolving calls, changes in ``index``.

    Returns rows to write and tombstones (name, repo, key) of the rows that they stand for; see ``sources.store``. Together they give what ``delete_files``,
    ``replace_file_rows``, ``upsert_files`` and ``resolve_edges`` give, but only calls are looked at that the change can have touched: those of the
    files themselves, those into nodes that went, and open ones to a name that came. A file that holds such a call has its calls written anew.
    ``resolve``: whether ``resolve_edges`` is to follow at all. ``resolved``: no other open call could be resolved before the change; otherwise all open calls are
    tried. An edge's file is its caller's.
    """
    gone_files = cut(removed.select(*FILE).withColumn("_removed", F.lit(True)).unionByName(taken.select(*FILE).withColumn("_removed", F.lit(False))).groupBy(*FILE).agg(F.max("_removed").alias("_removed")), "gone-files")
    small = if_small(gone_files)
    gone = cut(index.nodes.join(small, FILE).select("repo", F.col("id").alias("callee_id"), "_removed"), "gone-nodes")
    stay = index.nodes.join(small, FILE, "left_anti").select(*NODE_ORDER, "repo", "name").unionByName(new.nodes.select(*NODE_ORDER, "repo", "name"))
    came = (new.nodes if resolved or not resolve else stay).select("repo", F.col("name").alias("callee_name")).distinct()
    others = index.edges.join(small, FILE, "left_anti")
    into = others.join(if_small(gone), ["repo", "callee_id"], "left_semi").select(*FILE)
    open_ = others.filter("callee_id IS NULL").join(if_small(came), ["repo", "callee_name"], "left_semi").select(*FILE)
    touched = cut(into.unionByName(open_).distinct(), "touched-files")
    kept = others.join(if_small(touched), FILE, "left_semi").join(if_small(gone), ["repo", "callee_id"], "left").filter("_removed IS NULL OR NOT _removed")
    kept = kept.withColumn("callee_id", F.when(F.col("_removed").isNull(), F.col("callee_id")))
    edges = cut(kept.select(*EDGES.names).unionByName(new.edges.select(*EDGES.names)), "touched-edges")
    called = edges.filter("callee_id IS NULL").select("repo", F.col("callee_name").alias("name")).distinct()
    if resolve:
        edges = resolve_edges(edges, stay.join(if_small(cut(called, "called")), ["repo", "name"], "left_semi"))
    by_file = gone_files.select(F.explode(F.array(*map(F.lit, ("files", "nodes", "edges")))).alias("name"), "repo", F.col("file_path").alias("key"))
    by_file = by_file.unionByName(touched.select(F.lit("edges").alias("name"), "repo", F.col("file_path").alias("key")))
    by_node = gone.select(F.lit("comments").alias("name"), "repo", F.col("callee_id").alias("key"))
    return new.with_(edges=edges), by_file.unionByName(by_node)


def unresolved_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo").agg(F.count_if(F.col("callee_id").isNull()).alias("unresolved"), F.count(F.lit(1)).alias("edges"))


def put_comments(comments: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows."""
    return comments.unionByName(new.select(comments.columns))


def replace_generated(comments: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` comments (repo, node_id, text, generated_at) take the place of the same nodes' generated ones."""
    rows = new.withColumn("source", F.lit("generated")).select(comments.columns)
    old = comments.join(rows.select("repo", "node_id", "source").distinct(), ["repo", "node_id", "source"], "left_anti").select(comments.columns)
    return old.unionByName(rows)
