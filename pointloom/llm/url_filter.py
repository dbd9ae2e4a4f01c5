"""URL filters: host and path rules, then a cascade of Bloom filters for the listed hosts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, map_columns, staged, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most bits that a level may have, as it is broadcast: 16 MB. More listed keys are split by a hash into several cascades.
MAX_BITS = 1 << 27
RATE = 2**-8  # of false positives of the first level


@dataclass(frozen=True)
class Rule:
    """Judges urls on host or a subdomain of it whose path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text of the longest rule that fits, its verdict); null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


@dataclass
class Level:
    bits: np.ndarray  # 64-bit words
    m: int
    k: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for i in range(self.k):
            at = (h1 + np.uint64(i) * h2) % np.uint64(self.m)
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _keys(key: Column, level: int) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key).bitwiseOR(F.lit(1))


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class Cascade:
    """Exact membership for every key of the universe that it was built over.

    Level 0 holds the listed keys; each further level holds the keys that the
    one before accepts wrongly: unlisted keys on odd levels, listed ones on
    even. A key is listed if the first level that lacks it is an odd one.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        n = len(hashes[0][0]) if hashes else 0
        out, open_ = np.zeros(n, bool), np.ones(n, bool)
        for i, level in enumerate(self.levels):
            inside = level.has(*hashes[i])
            out[open_ & ~inside] = i % 2 == 1
            open_ &= inside
        out[open_] = len(self.levels) % 2 == 1  # in every level: it is what the last one was built of
        return out


def bits_of(count: int, rate: float) -> int:
    return max(64, math.ceil(count * max(1, round(-math.log2(rate))) / math.log(2) / 64) * 64)


def _build_level(keys: DataFrame, count: int, level: int, rate: float) -> Level:
    """One filter; bits are set in the executors and joined by 64-bit word, so the driver gets m / 64 words."""
    k, m = max(1, round(-math.log2(rate))), bits_of(count, rate)
    if m > MAX_BITS:
        raise ValueError(f"a level of {m} bits is over MAX_BITS={MAX_BITS}")
    h1, h2 = _keys(F.col("key"), level)

    def places(a: pa.Array, b: pa.Array) -> list:
        x, y = _unsigned(a), _unsigned(b)
        at = np.stack([(x + np.uint64(i) * y) % np.uint64(m) for i in range(k)], 1).astype(np.int64)
        return [at.tolist()]

    at = map_columns(keys.select(h1.alias("a"), h2.alias("b")), ["a", "b"], "at array<long>", places).select(F.explode("at").alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toPandas()
    bits = np.zeros(m // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, m, k)


def _accepted(keys: DataFrame, level: Level, i: int) -> DataFrame:
    h1, h2 = _keys(F.col("key"), i)
    shared = keys.sparkSession.sparkContext.broadcast(level)
    both = keys.select("key", h1.alias("a"), h2.alias("b"))
    return map_columns(both, ["a", "b"], "hit boolean", lambda a, b: [pa.array(shared.value.has(_unsigned(a), _unsigned(b)))]).filter("hit").select("key")


def build_cascade(universe: DataFrame, max_levels: int = 40) -> Cascade:
    """universe: distinct rows (key string, listed boolean), staged by the caller."""
    sides = [universe.filter("listed").select("key"), universe.filter("not listed").select("key")]
    levels: list[Level] = []
    left, other = sides
    count = left.count()
    owned: list[DataFrame] = []
    while count and len(levels) < max_levels:
        levels.append(_build_level(left, count, len(levels), RATE if not levels else 0.5))
        wrong = staged(_accepted(other, levels[-1], len(levels) - 1), "bloom")
        owned.append(wrong)
        left, other, count = wrong, left, wrong.count()
    for df in owned:
        drop_staged(df)
    if count:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def with_member(df: DataFrame, key_col: str, cascade: Cascade, name: str = "listed") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(cascade)
    n = len(cascade.levels)
    hashed = df
    for i in range(n):
        a, b = _keys(F.col(key_col), i)
        hashed = hashed.withColumn(f"_a{i}", a).withColumn(f"_b{i}", b)
    if not n:
        return df.withColumn(name, F.lit(False))

    def has(*columns: pa.Array) -> list:
        v = [_unsigned(c) for c in columns]
        return [pa.array(shared.value.has(list(zip(v[::2], v[1::2], strict=True))))]

    inputs = [f"_{s}{i}" for i in range(n) for s in "ab"]
    return map_columns(hashed, inputs, f"{name} boolean", has).drop(*inputs)


def filter_urls(df: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES, most_bits: int = MAX_BITS) -> DataFrame:
    """df with host, path, rule, listed and verdict (allow or block); columns of these names are replaced.

    listed: a table whose column host has the listed hosts. Where no rule fits,
    a url is blocked if its host is listed. Of the rules that fit, the longest
    decides; two of equal length that fit one url would be the same rule but
    for the place of the first slash, and then the later in the table decides.
    Null urls and those without :// have an empty host and path; an empty host
    is a key like any other. Rows are judged alone, so very long urls and
    repeats change nothing; an empty table stays empty.

    The cascade is built over all hosts of df, so membership is exact. Listed
    hosts beyond what most_bits hold are split by a hash of the host, with a
    cascade for each part.
    """
    base = without(df, [n for n in ("host", "path", "rule", "listed", "verdict", "_rv") if n != url_col.lower()])
    url = F.col(f"`{url_col}`")
    parts = base.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    # every host once, with whether it is listed; a listed host that no url has plays no part
    seen = parts.select(F.col("host").alias("key"), F.lit(True).alias("here"), F.lit(False).alias("listed"))
    marks = listed.select(F.coalesce(F.col("host"), F.lit("")).alias("key"), F.lit(False).alias("here"), F.lit(True).alias("listed"))
    universe = seen.union(marks).groupBy("key").agg(F.max("here").alias("here"), F.max("listed").alias("listed"))
    universe = staged(universe.filter("here").select("key", "listed"), "hosts")
    count = universe.filter("listed").count()
    shards = max(1, math.ceil(bits_of(count, RATE) * 1.1 / most_bits)) if count > 64 else 1
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("rule", text).withColumn("_rv", verdict)
    out = None
    for s in range(shards):
        mine = lambda df, c: df if shards == 1 else df.filter(F.pmod(F.xxhash64(F.lit(-1), c), F.lit(shards)) == s)  # noqa: B023, E731
        judged = with_member(mine(ruled, "host"), "host", build_cascade(mine(universe, "key")))
        out = judged if out is None else out.union(judged)
    drop_staged(universe)
    return out.withColumn("verdict", F.coalesce("_rv", F.when(F.col("listed"), "block").otherwise("allow"))).drop("_rv")
