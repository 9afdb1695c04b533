"""URL filters: host and path rules held in a cascade of Bloom filters.

A rule is a key, its host and path joined. A URL has few keys that could be a rule: each suffix of its
host with each prefix of its path that is as long as some rule's path. The first filter holds the
rules' keys; the second the corpus's other keys that pass the first; the third the rules' keys that pass the
second, and so on until a filter lets nothing false through. Over the corpus's complete key universe
the answer is then exact: the first level that a key fails tells whether it is listed. Filters are
arrays of bits in literals, so judging needs no join and no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No filter in a literal is larger than this. Where the second level would be, the first is made larger, so that fewer keys pass it.
MOST_BITS = 1 << 20
PROBES = 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """The keys of a URL, longest first: host suffixes at dots, each with the path's prefixes of these lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.filter(F.array(*[F.substring(path, 1, n) for n in sorted(path_lengths, reverse=True)]), lambda p: F.length(p) > 0)
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    return F.when(F.length(host) > 0, F.array_sort(F.array_distinct(keys), lambda a, b: F.length(b) - F.length(a))).otherwise(F.array().cast("array<string>"))


def probes(key: Column, level: int, bits: int) -> list[Column]:
    """The places of a key in a level's filter."""
    a, b = (F.pmod(F.xxhash64(*x), F.lit(1 << 31)) for x in ((key, F.lit(level)), (F.lit(level), key)))
    return [F.pmod(a + b * i, F.lit(bits)) for i in range(PROBES)]


def passes(key: Column, level: int, words: list[int]) -> Column:
    """Whether every probe finds its bit; ``words`` are the filter's 64-bit words."""
    held = F.array(*[F.lit(w).cast("long") for w in words])
    found = [F.getbit(F.get(held, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in probes(key, level, 64 * len(words))]
    return reduce(lambda x, y: x & y, found)


def filter_words(keys: DataFrame, level: int, words: int) -> list[int]:
    """The filter of these keys: set bits are gathered by word, so no more rows than words reach the driver."""
    places = keys.select(F.explode(F.array(*probes(F.col("key"), level, 64 * words))).alias("p"))
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("bits")
    out = [0] * words
    for w, b in places.groupBy(F.shiftright("p", 6).alias("w")).agg(bits).collect():
        out[w] = b
    return out


def key_table(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")).alias("key"))


def build_cascade(listed: list[str], universe: DataFrame, bits_per_key: int = 16) -> list[list[int]]:
    """Filters, as 64-bit words, that tell the listed keys from all others of ``universe`` (a column ``key``, repeats allowed).

    ``listed`` is the user's list, so small; the universe is read once for level 1, and only what passes it is kept, in
    a staged table. Should that be too much for a literal, level 1 gets four times the bits and is built again; an error if that has no room either.
    """
    if not listed:
        return []
    words = max(1, -(-bits_per_key * len(listed) // 64))
    while True:
        levels = [filter_words(key_table(universe.sparkSession, listed), 1, words)]
        false = staged(universe.filter(passes(F.col("key"), 1, levels[0]) & ~F.col("key").isin(listed)).distinct(), "false-keys")
        n = false.count()
        if n * bits_per_key <= MOST_BITS:
            break
        if 4 * 64 * words > MOST_BITS:
            raise ValueError(f"{len(listed)} rules are too many for filters in literals: {n} keys of the corpus pass the largest first level")
        words *= 4
    sides = [key_table(universe.sparkSession, listed), false]  # what the odd and the even levels hold
    while n:
        level = len(levels) + 1
        side = (level + 1) % 2
        levels.append(filter_words(sides[side], level, max(1, -(-bits_per_key * n // 64))))
        sides[1 - side] = sides[1 - side].filter(passes(F.col("key"), level, levels[-1]))
        n = sides[1 - side].count()
    return levels


def listed_in(key: Column, levels: list[list[int]]) -> Column:
    """Membership: a key is listed if the first level that it fails is an even one, or if it fails none of an odd number."""
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels), 0, -1):
        out = F.when(passes(key, level, levels[level - 1]), out).otherwise(F.lit(level % 2 == 0))
    return out


def judge_urls(pages: DataFrame, allow: list[str], block: list[str], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``allow`` and ``block`` are rules, host and path joined, as ``example.org/es/``. A rule fits its host and all subdomains
    if the path starts with the rule's; the longest that fits wins. Without one the verdict is the cascade's: a key
    that isn't listed as blocked is allowed, so null, empty and malformed urls are. Columns of those names are replaced.
    """
    clash = set(allow) & set(block)
    if clash or any("/" not in r or r.startswith("/") for r in [*allow, *block]):
        raise ValueError(f"rules are a host and a path, each either allowed or blocked: {sorted(clash) or [*allow, *block]}")
    lengths = sorted({len(r) - r.index("/") for r in [*allow, *block]})
    fields = {"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))}
    if not lengths:
        return pages.withColumns(fields | {"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    universe = pages.select(F.explode(rule_keys(fields["host"], fields["path"], lengths)).alias("key"))
    blocked, allowed = build_cascade(block, universe), build_cascade(allow, universe)
    (keys,) = fresh([*pages.columns, *fields, "rule", "verdict"], "_keys")
    fits = F.filter(F.col(keys), lambda k: listed_in(k, blocked) | listed_in(k, allowed))
    return (
        pages.withColumns(fields)
        .withColumn(keys, rule_keys(F.col("host"), F.col("path"), lengths))
        .withColumn("rule", F.get(fits, F.lit(0)))
        .withColumn("verdict", F.when(F.col("rule").isNotNull() & listed_in(F.col("rule"), blocked), "block").otherwise("allow"))
        .drop(keys)
    )
