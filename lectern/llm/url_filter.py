"""URL filters by a Bloom filter cascade, in DataFrame operations only.

A key is a host suffix joined with a path prefix. The key universe is every key that a URL of the corpus can match: the
suffixes with as many labels as some rule's host, with the path prefixes as long as some rule's path. Level 0 of the cascade
encodes the listed keys; level 1 the keys of the universe that level 0 takes wrongly; level 2 the listed keys that
level 1 takes wrongly, and so on until a level makes no mistake. A key is listed exactly when the first level that does not
hold it is an odd one. Levels are bit arrays held as literals of the plan, so URLs are judged without a join; their size
follows the rule list and is checked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, quoted

#: Rules of op10, in the order given: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Bits a key at level 0 (few false positives over a large universe) and at the later ones; most levels and bits of one level.
FIRST_BITS, LATER_BITS, PROBES, MAX_LEVELS, MAX_BITS = 24, 8, 4, 32, 1 << 23

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * PROBES + i)), F.lit(bits)).cast("int") for i in range(PROBES)]


class TooManyKeys(ValueError):
    """A filter would be too large to be a literal of the plan."""


@dataclass
class Level:
    """One Bloom filter: words of 64 bits."""

    number: int
    bits: int
    words: list[int]

    def holds(self, key: Column) -> Column:
        array = F.array(*map(F.lit, self.words)) if len(self.words) <= 4096 else F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<long>")
        test = lambda p: F.getbit(F.get(array, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
        out = F.lit(True)
        for p in _positions(key, self.number, self.bits):
            out = out & test(p)
        return out


def build_level(keys: DataFrame, number: int) -> Level | None:
    """The filter of a table of keys, or None if it is empty. Bits are or-ed on the executors; only words reach the driver."""
    n = keys.count()
    if not n:
        return None
    bits = 64 * max(1, math.ceil(n * (LATER_BITS if number else FIRST_BITS) / 64))
    if bits > MAX_BITS:
        raise TooManyKeys(f"level {number} needs {bits} bits, more than MAX_BITS")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits))).alias("p"))
    rows = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    words = [0] * (bits // 64)
    for w, b in rows.collect():  # at most MAX_BITS / 64 rows
        words[w] = b
    return Level(number, bits, words)


class Cascade:
    """Exact membership in `listed` for every key of `universe` (one column `key` each)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[Level] = []
        wanted = listed.select("key").distinct()
        # what level 0 takes is all that later levels can see: the universe is read once
        first = build_level(wanted, 0)
        if first is None:
            return
        self.levels.append(first)
        passed = materialise(universe.select("key").filter(first.holds(F.col("key"))).distinct(), "passed")
        sides = [wanted, passed.join(wanted, "key", "left_anti")]
        for number in range(1, MAX_LEVELS):
            sides[number % 2] = sides[number % 2].filter(self.levels[-1].holds(F.col("key"))) if number > 1 else sides[1]
            level = build_level(sides[number % 2], number)
            if level is None:
                return
            self.levels.append(level)
        raise ValueError("the cascade does not end")

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that lacks it is an odd one, or none is left."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(out)
        return out


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(key, verdict, labels, size) of rules (verdict, host, path), given in a list or as a table of any length; hosts are lower-cased, nulls empty."""
    if isinstance(rules, DataFrame):
        rows = rules.select("verdict", "host", "path")
    else:
        one = lambda r: F.struct(*[F.lit(x).alias(n) for n, x in zip(("verdict", "host", "path"), r, strict=True)])
        rows = spark.range(1).select(F.inline(F.array(*map(one, rules)) if rules else F.array(one(("", "", ""))))).filter(F.lit(bool(rules)))
    name, prefix = F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER), F.coalesce(F.col("path"), F.lit(""))
    return rows.filter("verdict IN ('block', 'allow')").select(F.concat(name, prefix).alias("key"), "verdict", F.size(F.split(name, r"\.", -1)).alias("labels"), F.length(prefix).alias("size"))


def candidate_keys(host_: Column, path_: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """The keys that a URL can match, the longest first: (host suffix, path prefix) with the numbers of labels and characters that rules have."""
    labels = F.split(host_, r"\.", -1)
    if not shapes:
        return F.array().cast("array<string>")
    every = F.array(*[F.struct(F.lit(depth).alias("labels"), F.lit(size).alias("size")) for depth, size in sorted(shapes, reverse=True)])
    fitting = F.filter(every, lambda s: (F.size(labels) >= s["labels"]) & (F.length(path_) >= s["size"]))
    suffix = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    keys = F.transform(fitting, lambda s: F.concat(suffix(s["labels"]), F.substring(path_, F.lit(1), s["size"])))
    return F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    rules are (verdict, host, path), in a list or a table; of a table only the different numbers of host labels and path characters reach the
    driver, which the lengths of rules bound. A rule fits its host and all subdomains if the path starts with the rule's path; of those
    that fit, the one with the longest host and path wins (of equal ones, the block). Without a rule the cascade finds no listed key and the
    URL is allowed. A null URL or one without :// has an empty host and path and is allowed; null and repeated ids are kept as they are; a
    very long URL is judged whole; an empty table gives no rows; names of other columns don't matter. A list whose filters would be
    longer than MAX_BITS is joined with the keys instead.
    """
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(url_col)).alias("url")).select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    table = rule_table(pages.sparkSession, rules)
    shapes = [(r["labels"], r["size"]) for r in table.select("labels", "size").distinct().collect()]
    keyed = rows.select("*", candidate_keys(F.col("host"), F.col("path"), shapes).alias("keys"))
    universe = keyed.select(F.explode("keys").alias("key"))
    of = lambda verdict: table.filter(F.col("verdict") == verdict).select("key")
    try:
        block, allow = Cascade(of("block"), universe), Cascade(of("allow"), universe)
    except TooManyKeys:
        return _judge_by_join(keyed, table, id_col)
    rule = F.get(F.filter("keys", lambda k: block.holds(k) | allow.holds(k)), F.lit(0))
    found = keyed.select("id", "host", "path", rule.alias("rule"))
    verdict = F.when(F.col("rule").isNotNull() & block.holds(F.col("rule")), "block").otherwise("allow")
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def _judge_by_join(keyed: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """The same by joins: each different host and path is judged once, by the longest of its keys that is listed."""
    table = rules.groupBy("key").agg(F.max("verdict").alias("v"))  # a block before an allow
    urls = keyed.select("host", "path", "keys").distinct()
    hits = urls.select("host", "path", F.explode("keys").alias("key")).join(table, "key")
    best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(F.struct(F.length("key").alias("n"), "key", "v")).alias("best"))
    found = keyed.join(best, (keyed["host"] == best["h"]) & (keyed["path"] == best["p"]), "left")
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.v", F.lit("allow")).alias("verdict"))


def op10(pages: DataFrame) -> DataFrame:
    return judge(pages)


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT u.*, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, verdict DESC) AS k
  FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
