"""Lookups: each takes a table of requests with a ``repo`` and returns the rows that answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_ascii, like_anywhere, slashes
from ..schemas import check_range, node_order_columns
from ..tables import cut, if_small

#: The most rows that one request may ask for.
MOST = 100
#: Sizes of the pieces of names that searches go by; the empty one is in every name.
GRAMS = (0, 1, 2, 3)
#: Names of one piece that a task compares, about; more are dealt out.
PART = 200_000
COMMENTED_TYPES = ["function", "method", "class", "interface", "struct", "trait"]


def nodes_by_id(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose (repo, id) is asked for."""
    return nodes.join(if_small(ids.select("repo", "id").distinct()), ["repo", "id"], "left_semi")


def nodes_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes of exactly these (repo, name); order by ``node_order_columns`` to present them."""
    return nodes.join(if_small(names.select("repo", "name").distinct()), ["repo", "name"], "left_semi")


def nodes_by_file(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of these (repo, file_path); backslashes in a request count as slashes."""
    asked = paths.select("repo", slashes(F.col("file_path")).alias("file_path")).distinct()
    return nodes.join(if_small(asked), ["repo", "file_path"], "left_semi")


def postings(nodes: DataFrame, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """(repo, gram, name): each distinct name with all its pieces of these sizes, A-Z folded. Write it down to search many times (see ``search_nodes``)."""
    names = nodes.filter("name IS NOT NULL").select("repo", "name").distinct()
    folded = fold_ascii(F.col("name"))

    def pieces(n: int) -> Column:
        if not n:
            return F.array(F.lit(""))
        found = F.transform(F.sequence(F.lit(1), F.length("name") - (n - 1)), lambda i: F.substring(folded, i, F.lit(n)))
        return F.when(F.length("name") >= n, found).otherwise(F.array().cast("array<string>"))

    grams = F.array_distinct(F.concat(*map(pieces, sizes)))
    return names.select("repo", F.explode(grams).alias("gram"), "name")


def query_grams(query: Column) -> Column:
    """Pieces that a name must hold to match ``query``: those of GRAMS' largest size that its parts between wildcards have; '' if all are wildcards."""
    parts = F.filter(F.split(fold_ascii(query), "[%_]"), lambda p: p != "")
    size = F.least(F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)), F.lit(max(GRAMS)))
    pieces = F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) >= size), lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - size + 1), lambda i: F.substring(p, i, size))))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(pieces))


def matching_names(nodes: DataFrame, queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(repo, query, name) for each distinct name that holds a query (repo, query) of its repo, as LIKE has it.

    A query meets names on (repo, piece), by the rarest of its pieces; names of frequent pieces are dealt out to as many parts as they need. Only pieces
    that queries have are looked at. ``known``: ``postings`` of the nodes written down before.
    """
    asked = cut(queries.select("repo", "query").distinct().filter("query IS NOT NULL").withColumn("gram", F.explode(query_grams(F.col("query")))), "asked")
    sizes = tuple(sorted(r[0] for r in asked.select(F.length("gram")).distinct().collect()))  # some of GRAMS
    all_ = postings(nodes, sizes or (0,)) if known is None else known
    found = cut(all_.join(if_small(asked.select("repo", "gram").distinct()), ["repo", "gram"], "left_semi"), "postings")
    counts = found.groupBy("repo", "gram").agg(F.count(F.lit(1)).alias("names"))
    # a piece that no name has rules its query out
    rarest = asked.join(counts, ["repo", "gram"], "left").groupBy("repo", "query").agg(F.min_by("gram", F.struct("names", "gram")).alias("gram"), F.min(F.coalesce("names", F.lit(0))).alias("names"))
    parts = F.ceil(F.col("names") / PART).cast("int")
    rarest = cut(rarest.filter("names > 0").withColumn("parts", parts), "rarest")
    often = rarest.filter("parts > 1").select("repo", "gram", "parts").distinct()
    dealt = found.join(if_small(often), ["repo", "gram"], "left").withColumn("part", F.pmod(F.xxhash64("name"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    wanted = rarest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("repo", "gram", "part", "query")
    return dealt.join(wanted, ["repo", "gram", "part"]).filter(like_anywhere(F.col("name"), F.col("query"))).select("repo", "query", "name")


def holding(nodes: DataFrame, asked: DataFrame, most: int = MOST, known: DataFrame | None = None) -> DataFrame:
    """Nodes with each row of ``asked`` (repo, query, ...) of their repo whose query their name holds: of each name and type, the first ``most``.

    Only distinct names are searched; a name that many nodes share brings ``most`` nodes of each type to the join, which Spark finds before the shuffle.
    """
    names = cut(matching_names(nodes, asked, known), "matching")
    first = Window.partitionBy("repo", "name", "type").orderBy(*node_order_columns())
    held = nodes.join(if_small(names.select("repo", "name").distinct()), ["repo", "name"], "left_semi")
    held = held.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).drop("_k")
    return held.join(names, ["repo", "name"]).join(if_small(asked), ["repo", "query"]) if asked.columns != ["repo", "query"] else held.join(names, ["repo", "name"])


def search_nodes(nodes: DataFrame, requests: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` nodes whose name holds a request's ``query``: repo, query, type_wanted, limit, rank, and the node's columns.

    ``requests``: repo, query, type (null: any), limit (null: 20; 1 to 100). ``%`` and ``_`` in a query are wildcards; case
    doesn't count for A-Z. Each request's best hundred are found before anything is shuffled. ``known``: ``postings`` of the nodes, written
    down before.
    """
    asked = requests.select("repo", "query", F.col("type").alias("type_wanted"), F.coalesce("limit", F.lit(20)).cast("int").alias("limit")).distinct()
    worst = asked.agg(F.min("limit"), F.max("limit")).first()
    for n in worst:
        check_range("limit", 20 if n is None else n, 1, MOST)
    found = holding(nodes, asked, known=known).filter(F.col("type_wanted").isNull() | (F.col("type") == F.col("type_wanted")))
    order = Window.partitionBy("repo", "query", "type_wanted", "limit").orderBy(*node_order_columns())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MOST).filter(F.col("rank") <= F.col("limit"))


def edges_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges that leave (``outgoing``) or reach (``incoming``) the nodes asked for: repo, node_id, direction and the edge's columns."""
    asked = if_small(ids.select("repo", F.col("id").alias("node_id")).distinct())
    sides = [edges.join(asked, (edges["repo"] == asked["repo"]) & (edges[c] == asked["node_id"])).select(edges["*"], "node_id", F.lit(d).alias("direction")) for c, d in (("caller_id", "outgoing"), ("callee_id", "incoming"))]
    return sides[0].unionByName(sides[1])


def comments_of(comments: DataFrame, ids: DataFrame) -> DataFrame:
    asked = ids.select("repo", F.col("id").alias("node_id")).distinct()
    return comments.join(if_small(asked), ["repo", "node_id"], "left_semi")


def file_hashes(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(repo, file_path, hash) for each path asked for; null if there is no such file."""
    return paths.select("repo", "file_path").distinct().join(files.select("repo", "file_path", "hash"), ["repo", "file_path"], "left")


def nodes_without_comments(nodes: DataFrame, comments: DataFrame, limit: int | None = 100) -> DataFrame:
    """The first ``limit`` nodes of each repo that can have a comment and have none; all of them if ``limit`` is None."""
    bare = nodes.filter(F.col("type").isin(COMMENTED_TYPES)).join(comments.select("repo", F.col("node_id").alias("id")).distinct(), ["repo", "id"], "left_anti")
    if limit is None:
        return bare
    return bare.withColumn("_k", F.row_number().over(Window.partitionBy("repo").orderBy(*node_order_columns()))).filter(F.col("_k") <= limit).drop("_k")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each (repo, name): the first. A partial aggregate, so a name that many nodes share isn't gathered."""
    from ..schemas import node_order

    return nodes.groupBy("repo", "name").agg(F.min_by(F.struct("id", "file_path", "start_line", "type", "signature", "language"), node_order()).alias("first")).select("repo", "name", "first.*")
