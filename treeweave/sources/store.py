"""An index on disk, changed file by file: data parts, tombstones, and a log of commits that tells which of them count.

A commit adds a version, a folder of Parquet rows for each table, and tombstones: (table, repo, key) of older rows that no longer count, where the
key is the file of files, nodes and edges and the node of comments, and null stands for the whole repo. Readers take the rows of all versions
that no later tombstone names (merge on read), so a changed file costs its own rows, and an append costs what it appends. ``compact`` writes what counts as
one version; ``vacuum`` removes what no commit needs.

A commit is one small file that appears whole or not at all, under the next number. Of two writers one gets the number; the other
goes on if they touched different repos, and else starts anew. What a broken write left behind is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COMMENTS, EDGES, FILES, NODES, SCHEMA_VERSION, Index, fields
from ..tables import if_small

LAYOUT = {"files": FILES, "nodes": NODES, "edges": EDGES, "comments": COMMENTS}
#: The column by which a table's rows are named in tombstones, beside the repo.
KEYS = {"files": "file_path", "nodes": "file_path", "edges": "file_path", "comments": "node_id"}
GONE = fields("name string, repo string, key string")
#: What no row may lack.
NEEDED = {"files": ("repo", "file_path"), "nodes": ("repo", "file_path", "id"), "edges": ("repo", "caller_id"), "comments": ("repo", "node_id"), "gone": ("name", "repo")}
#: Folders of a version's table, by a hash of the repo: a bound on the number of folders, and what a read of some repos looks into.
BUCKETS = 64
#: Up to so many repos a commit names those that it touched; a commit of more is taken to touch all.
NAMED = 1000


class Conflict(RuntimeError):
    """Another writer's commit came first and touched the same repos: what was to be written rests on rows that may be gone."""


@dataclass(frozen=True)
class Commit:
    place: int
    version: str
    #: Tables (and "gone") that the version has rows of.
    tables: list[str]
    #: Repos touched; None: any.
    repos: list[str] | None
    #: Commits before this one don't count: it holds everything.
    base: bool = False
    #: Whether this left no call open that could be resolved, if there was none before.
    resolved: bool = True
    #: Whether all open calls of its repos were tried, so that none is left that could be resolved.
    tried: bool = False
    #: The last batch of each stream that is part of the index, as far as this commit tells.
    streams: dict[str, int] = field(default_factory=dict)
    schema_version: int = SCHEMA_VERSION


@dataclass(frozen=True)
class Snapshot:
    """The commits that count at a moment, oldest first."""

    path: str
    commits: list[Commit]

    @property
    def place(self) -> int:
        return self.commits[-1].place if self.commits else 0

    def resolved(self, repos: list[str] | None = None) -> bool:
        """Whether it is known that no call of these repos (of any) is open that could be resolved."""
        for repo in [None] if repos is None else repos:
            state = True
            for c in self.commits:
                if repo is None or c.repos is None or repo in c.repos:
                    state = (state or c.tried and (repo is not None or c.repos is None)) and c.resolved
            if not state:
                return False
        return True

    def batch(self, stream: str) -> int:
        """The last batch of a stream that is in the index; -1 if none is."""
        return max((c.streams[stream] for c in self.commits if stream in c.streams), default=-1)


def bucket(repo) -> F.Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


# --- the log ---


def file_context(spark: SparkSession, path: str):
    """Hadoop's file context and path for a location, whatever its store."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration()), place


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and times of a folder's entries; none if there is no such folder."""
    context, place = file_context(spark, path)
    if not context.util().exists(place):
        return []
    found, out = context.listStatus(place), []
    while found.hasNext():
        s = found.next()
        out.append((s.getPath().getName(), s.getModificationTime()))
    return out


def removed(spark: SparkSession, path: str) -> None:
    context, place = file_context(spark, path)
    context.delete(place, True)


def written_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet, whole or not at all; whether it is ours that is there."""
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    context, source = file_context(spark, temporary)
    _, target = file_context(spark, path)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    out = context.create(source, flags, options)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(source, target, how)
        return True
    except Py4JJavaError as e:
        context.delete(source, False)
        if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
            raise
        return False


COMMIT = T.StructType(
    [
        T.StructField("place", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("tables", T.ArrayType(T.StringType())),
        T.StructField("repos", T.ArrayType(T.StringType())),
        T.StructField("base", T.BooleanType()),
        T.StructField("resolved", T.BooleanType()),
        T.StructField("tried", T.BooleanType()),
        T.StructField("streams", T.MapType(T.StringType(), T.LongType())),
        T.StructField("schema_version", T.IntegerType()),
    ]
)


def snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The commits that count now: from the last that holds everything on. There are as many as writes since then."""
    if not any(n.endswith(".json") for n, _ in listed(spark, f"{path}/commits")):
        return Snapshot(path, [])
    rows = spark.read.schema(COMMIT).json(f"{path}/commits/*.json").orderBy("place").collect()
    commits = [Commit(**r.asDict()) for r in rows]
    odd = {c.schema_version for c in commits} - {SCHEMA_VERSION}
    if odd:
        raise ValueError(f"index at {path} has versions {sorted(odd)}, not {SCHEMA_VERSION}")
    start = max((i for i, c in enumerate(commits) if c.base), default=0)
    return Snapshot(path, commits[start:])


# --- reading ---


def rows_of(spark: SparkSession, seen: Snapshot, name: str, schema: T.StructType) -> list[tuple[Commit, DataFrame]]:
    """A table's rows by commit; only folders that the log names are looked at."""
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return [(c, spark.read.schema(full).parquet(f"{seen.path}/{name}/version={c.version}")) for c in seen.commits if name in c.tables]


def united(parts: Iterable[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def read_snapshot(spark: SparkSession, seen: Snapshot, repos: list[str] | None = None) -> Index:
    """The index as these commits make it; of ``repos`` alone where they are given, and then only their buckets are read."""
    own = lambda t: t if repos is None else t.filter(F.col("repo").isin(repos) & F.col("bucket").isin(buckets))
    buckets = [] if repos is None else sorted({r[0] for r in spark.createDataFrame([(r,) for r in repos], "repo string").select(bucket(F.col("repo"))).collect()})
    gone = united(own(t).drop("bucket").withColumn("_until", F.lit(c.place)) for c, t in rows_of(spark, seen, "gone", GONE))
    tables = {}
    for name, schema in LAYOUT.items():
        parts = rows_of(spark, seen, name, schema)
        if not parts:
            tables[name] = spark.createDataFrame([], schema)
            continue
        last_gone = max((c.place for c in seen.commits if "gone" in c.tables), default=0)
        # rows that no later tombstone can name need no join
        plain = [own(t).select(*schema.names) for c, t in parts if c.place >= last_gone]
        older = united(own(t).select(*schema.names).withColumn("_place", F.lit(c.place)) for c, t in parts if c.place < last_gone)
        if older is not None:
            plain.append(alive(older, gone.filter(F.col("name") == name), KEYS[name]).select(*schema.names))
        tables[name] = united(plain)
    return Index(**tables)


def alive(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` that no tombstone of a later place names, by their key or their repo."""
    by_repo = gone.filter("key IS NULL").groupBy(F.col("repo").alias("_repo")).agg(F.max("_until").alias("_until"))
    by_key = gone.filter("key IS NOT NULL").groupBy(F.col("repo").alias("_repo"), F.col("key").alias("_key")).agg(F.max("_until").alias("_until"))
    rows = rows.join(if_small(by_repo), (F.col("repo") == F.col("_repo")) & (F.col("_place") < F.col("_until")), "left_anti")
    return rows.join(if_small(by_key), (F.col("repo") == F.col("_repo")) & (F.col(key) == F.col("_key")) & (F.col("_place") < F.col("_until")), "left_anti")


def read_index(spark: SparkSession, path: str, repos: list[str] | None = None) -> Index:
    """Open an index as its last commit left it, of some repos or of all; refuses a layout of another version, and a folder without any commit."""
    seen = snapshot(spark, path)
    if not seen.commits:
        raise ValueError(f"no index at {path}")
    return read_snapshot(spark, seen, repos)


# --- writing ---


def write_version(rows: Index, path: str, gone: DataFrame | None = None) -> tuple[str, list[str], list[str] | None]:
    """Write rows and tombstones (GONE) as a new version, which doesn't count yet; with a bad row in any table it is removed again.

    Returns the version, the tables that it has rows of, and the repos it touches (None: too many to name).
    """
    spark = rows.files.sparkSession
    own = F.col("source").isin("original", "generated") & ~((F.col("source") == "original") & F.col("generated_at").isNotNull())
    version = uuid.uuid4().hex

    def write(name: str, t: DataFrame) -> tuple[DataFrame, int, int]:
        schema, folder = LAYOUT.get(name, GONE), f"{path}/{name}/version={version}"
        # as many files as the rows need: small ones of a bucket together, and a bucket with a hot repo in several
        t.select(*schema.names).withColumn("bucket", bucket(F.col("repo"))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        bad = F.exists(F.array(*NEEDED[name]), F.isnull) if name != "comments" else F.exists(F.array(*NEEDED[name]), F.isnull) | ~F.coalesce(own, F.lit(False))
        written = spark.read.schema(schema).parquet(folder)
        return written, *written.agg(F.count(F.lit(1)), F.count_if(bad)).first()

    tables = rows.tables() | ({} if gone is None else {"gone": gone.distinct()})
    with ThreadPoolExecutor(len(tables)) as side_by_side:
        done = dict(zip(tables, side_by_side.map(write, *zip(*tables.items(), strict=True)), strict=True))
    wrong = [n for n, (_, _, bad) in done.items() if bad]
    if wrong:
        for name in tables:
            removed(spark, f"{path}/{name}/version={version}")
        raise ValueError("; ".join(f"{n}: {', '.join(NEEDED[n])} must not be null" for n in wrong) + "; comments: source is original or generated, and only generated ones have a time")
    present = [n for n, (_, count, _) in done.items() if count]
    repos = [r[0] for r in united(done[n][0].select("repo") for n in present).distinct().limit(NAMED + 1).collect()] if present else []
    return version, present, sorted(repos) if len(repos) <= NAMED else None


def commit(spark: SparkSession, seen: Snapshot, version: str, tables: list[str], repos: list[str] | None, **more) -> Commit:
    """Make a version count, by one file, after all commits of ``seen`` and others that touched other repos.

    Raises Conflict where a commit since ``seen`` touched the same repos, or has the same batch of a stream.
    """
    place = seen.place
    while True:
        place += 1
        new = Commit(place, version, tables, repos, **more)
        if written_once(spark, f"{seen.path}/commits/{place:020d}.json", json.dumps(new.__dict__)):
            return new
        for other in snapshot(spark, seen.path).commits:
            if other.place < place:
                continue
            apart = other.repos is not None and repos is not None and not set(other.repos) & set(repos) and not other.base and not new.base
            if not apart or any(other.streams.get(s, -1) >= b for s, b in new.streams.items()):
                raise Conflict(f"commit {other.place} of {seen.path} came first")
            place = other.place


def write_index(index: Index, path: str, repos: list[str] | None = None, resolved: bool = False) -> None:
    """Replace the repos that ``index`` holds; other repos' rows stay.

    ``repos``: those that are replaced even where ``index`` has no rows of them (they then go). What is read may come from ``path`` itself.
    ``resolved``: the caller says that none of the open calls could be resolved, as after ``full_index``; else the next update tries them all.
    """
    spark = index.files.sparkSession
    seen = snapshot(spark, path)
    held = united(t.select("repo") for t in index.tables().values()).distinct()
    if repos:
        held = held.unionByName(spark.createDataFrame([(r,) for r in repos], "repo string")).distinct()
    gone = held.select(F.explode(F.array(*map(F.lit, LAYOUT))).alias("name"), "repo", F.lit(None).cast("string").alias("key"))
    version, tables, touched = write_version(index, path, gone if seen.commits else None)
    commit(spark, seen, version, tables, touched, resolved=resolved)


def add_rows(path: str, new: Index, resolved: bool = False) -> None:
    """Append the rows of ``new`` to the index at ``path``: all of them, or none where one of them is bad or the write fails. No old row is read.

    ``resolved``: the caller says that no call of the index is left that could be resolved now.
    """
    spark = new.files.sparkSession
    seen = snapshot(spark, path)
    version, tables, touched = write_version(new, path)
    while True:
        try:
            commit(spark, seen, version, tables, touched, resolved=resolved)
            return
        except Conflict:  # an append rests on nothing that another commit could have changed
            seen = snapshot(spark, path)


def change_rows(spark: SparkSession, seen: Snapshot, rows: Index, gone: DataFrame, repos: list[str] | None, stream: tuple[str, int] | None = None, tried: bool = False) -> Commit:
    """Commit a change of ``repos`` (None: any) worked out from ``seen``: tombstones (GONE) for older rows, and new rows.

    ``stream``: a stream's name and the batch that this is; ``tried``: all open calls of the repos were tried.
    """
    version, tables, _ = write_version(rows, seen.path, gone)
    return commit(spark, seen, version, tables, repos, tried=tried, streams=dict([stream]) if stream else {})


# --- upkeep ---


def compact(spark: SparkSession, path: str) -> None:
    """Write what counts as one version, so that reads need no tombstones. A crash on the way changes nothing."""
    seen = snapshot(spark, path)
    version, tables, _ = write_version(read_snapshot(spark, seen), path)
    streams = {s: seen.batch(s) for c in seen.commits for s in c.streams}
    commit(spark, seen, version, tables, None, base=True, resolved=seen.resolved(), streams=streams)


def vacuum(spark: SparkSession, path: str, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
    """Remove commits before the last that holds everything, and versions that no commit needs and that are older than a write, or a reader, can last.

    Returns the versions removed.
    """
    seen = snapshot(spark, path)
    live, until = {c.version for c in seen.commits}, time.time() * 1000 - older_than_ms
    first = seen.commits[0].place if seen.commits else 0
    for name, changed in listed(spark, f"{path}/commits"):
        if name.endswith(".json") and int(name.removesuffix(".json")) < first and changed <= until:
            removed(spark, f"{path}/commits/{name}")
    out = set()
    for table in (*LAYOUT, "gone"):
        for name, changed in listed(spark, f"{path}/{table}"):
            version = name.removeprefix("version=")
            if name.startswith("version=") and version not in live and changed <= until:
                removed(spark, f"{path}/{table}/{name}")
                out.add(version)
    return sorted(out)
