"""URL filters: exact membership of URL keys in listings by cascades of Bloom filters, in DataFrame functions only.

A listing holds keys, host followed by path. The first level of its cascade encodes the listed keys; the
second those keys of the corpus that pass the first level wrongly; the third the listed keys that pass
the second, and so on until no key is told wrongly. Over the corpus's complete key universe the answers
are therefore exact, without a join of pages with lists. Only filters reach the tasks: about
``1.44 * log2(|universe| / |listed|)`` bits for each listed key that the universe has. A listing of more such than ``max_keys`` keys is split by
a hash of the key into parts, each with a cascade and a pass of its own, so that tasks never get more at once.
The marks of the universe's keys are written once, and all levels read them.

Keys of a url: its host or a parent domain, followed by the path's first characters, of as many labels and
characters as some rule has. Rules are a table of any size; only the distinct pairs of these two numbers are collected.

A null url or one without ``://`` has an empty host and path and no keys; it gets the default verdict. Repeated
pages are judged alike, of two rules of one length the blocking one wins, and listings as well as tables may be empty.
Urls of any length are judged whole; only their keys, which are short, are compared. Other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm._spark import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits in 64-bit words, ``probes`` of them for a key; ``words`` is a JSON list."""

    bits: int
    probes: int
    words: str

    def passes(self, key: Column, salt: int) -> Column:
        words = F.from_json(F.lit(self.words), "array<bigint>")
        test = F.lit(True)
        for bit in positions(key, salt, self.bits, self.probes):
            test &= F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        return test


def positions(key: Column, salt: int, bits: int, probes: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(salt))
    a, b = h.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(h, 33)
    return [F.pmod(a + F.lit(k) * b, F.lit(bits)) for k in range(probes)]


def build_level(keys: DataFrame, n: int, share: float, salt: int) -> Level:
    """A filter of the ``n`` keys that other keys pass at about the rate ``share``."""
    probes = max(1, round(math.log2(1 / share)))
    bits = 64 * max(1, math.ceil(n * probes / math.log(2) / 64))
    bit = F.explode(F.array(*positions(F.col("key"), salt, bits, probes)))
    rows = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).collect()
    words = [0] * (bits // 64)
    for r in rows:  # as many as the filter has words
        words[r["word"]] = r["set"]
    return Level(bits, probes, "[" + ",".join(map(str, words)) + "]")


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]
    salt: int
    part: int = 0
    parts: int = 1

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed in this part: the first level that it doesn't pass decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(~self.levels[k].passes(key, self.salt + k), F.lit(k % 2 == 1)).otherwise(answer)
        return answer if self.parts == 1 else (part_of(key, self.parts) == self.part) & answer


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))


def build_cascades(listed: DataFrame, universe: DataFrame, salt: int = 0, max_keys: int = 5_000_000) -> Iterator[Cascade]:
    """Cascades, one for each part of the listing, that are exact on ``universe`` (distinct ``key``) together: every key of it is told listed or not.

    listed: column ``key``. No join: one aggregation over both tells the universe's keys that are listed from the
    others, and listed keys that the universe has not are left out. A cascade is built when it is asked for.
    """
    both = universe.select("key", F.lit(0).alias("own"), F.lit(1).alias("met")).unionByName(listed.select("key", F.lit(1).alias("own"), F.lit(0).alias("met")))
    marks = materialize(both.groupBy("key").agg(F.max("own").alias("own"), F.max("met").alias("met")).filter("met = 1").drop("met"))
    total = int(marks.agg(F.sum("own")).first()[0] or 0)
    parts = 1 if total <= max_keys else 1 + math.ceil(1.2 * total / max_keys)
    for part in range(parts):
        some = marks if parts == 1 else marks.filter(part_of(F.col("key"), parts) == part)
        n_in, n_out = (int(x or 0) for x in some.agg(F.sum("own"), F.sum(1 - F.col("own"))).first())
        levels: list[Level] = []
        share = min(0.5, max(1, n_in) / max(1, n_out))
        n, keys, others = n_in, some.filter("own = 1"), some.filter("own = 0")
        while n:
            level = build_level(keys, n, share, salt + len(levels))
            levels.append(level)
            keys, others = others.filter(level.passes(F.col("key"), salt + len(levels) - 1)), keys
            n = keys.count()
            share = 0.5
        yield Cascade(tuple(levels), salt, part, parts)
    discard(marks)


def url_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys that a rule of some shape (labels of its host, characters of its path) could have here; at most one for each label and path prefix of the url."""
    given = F.from_json(F.lit(json.dumps([{"labels": n, "chars": m} for n, m in shapes])), "array<struct<labels:int,chars:int>>")
    n_labels = F.when(host == "", 0).otherwise(F.length(host) - F.length(F.replace(host, F.lit("."))) + 1)
    fits = F.filter(given, lambda s: (s["labels"] <= n_labels) & (s["chars"] <= F.length(path)))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["chars"])))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules (verdict, host, path) as the table that ``filter_urls`` takes."""
    given = json.dumps([dict(zip(("verdict", "host", "path"), r, strict=True)) for r in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<verdict:string,host:string,path:string>>")))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_keys: int = 5_000_000) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict.

    rules: columns verdict (``block`` or ``allow``), host, path; any number of rows. The longest rule that fits wins;
    without one, the url is in no listing and the verdict is ``default``. Rules with a null, and other verdicts, fit nothing.
    """
    rows = pages.select(pages[id_col].alias("page_id"), url_host(pages[url_col]).alias("host"), url_path(pages[url_col]).alias("path"))
    rows = rows.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    listed = rules.select("verdict", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars")).dropna()
    shapes = sorted((r["labels"], r["chars"]) for r in listed.select("labels", "chars").distinct().collect())  # numbers alone, few: labels times lengths at most
    keyed = rows.withColumn("keys", url_keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    best = keyed.select("page_id", "host", "path", "keys", *(F.lit(None).cast("string").alias(v) for v in ("block", "allow")))
    for k, v in enumerate(("block", "allow")):
        for cascade in build_cascades(listed.filter(F.col("verdict") == v), universe, 1000 * k, max_keys):
            longest = F.reduce(F.filter("keys", cascade.holds), F.col(v), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
            best = best.withColumn(v, longest)
            if cascade.parts > 1:
                best = materialize(best)
    block = F.col("allow").isNull() | (F.length("block") >= F.length("allow"))
    rule = F.when(F.col("block").isNotNull() & block, F.col("block")).otherwise(F.col("allow"))
    verdict = F.when(F.col("block").isNotNull() & block, F.lit("block")).when(F.col("allow").isNotNull(), F.lit("allow")).otherwise(F.lit(default))
    return best.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
