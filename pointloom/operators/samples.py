"""Tests over samples of any size, per group: signed ranks, rank sums, normality.

Ranks come from one row for each group and distinct value: rows are counted
first, then dealt by ranges of (group, value), so neither a large group nor a
value that most rows share meets in one task. p values are those of the exact
distribution for small samples without ties, else of the normal one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..staging import staged


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys agree; the keys are the left's."""
    names = {k: f"_of_{k}" for k in keys}
    other = right.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in right.columns if c not in names])
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, on, how).drop(*names.values())


def tied_ranks(df: DataFrame, by: Sequence[str], value: str, counts: dict[str, Column] | None = None) -> DataFrame:
    """by, value, c (rows), the counts' sums, first and last (ranks of the value's rows): one row for each distinct finite value."""
    by, counts = list(by), counts or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = df.withColumn(value, finite(value)).filter(F.col(value).isNotNull())
    # 0.0 and -0.0 are one value
    each = seen.withColumn(value, F.col(value) + F.lit(0.0)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"), *[F.sum(F.coalesce(x.cast("long"), F.lit(0))).alias(n) for n, x in counts.items()])
    dealt = staged(each.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()), "values")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*by, "_part").agg(F.sum("c").alias("_c")).withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_part", *by).orderBy(value)
    met = matched(dealt, offsets, ["_part", *by])
    last = F.col("_off") + F.sum("c").over(inside)
    return met.withColumn("last", last).withColumn("first", F.col("last") - F.col("c") + 1).drop("_part", "_off")


@lru_cache(maxsize=256)
def signed_rank_tail(n: int) -> np.ndarray:
    """P(W <= w) of the sum of ranks 1..n with random signs."""
    ways = np.ones(1)
    for k in range(1, n + 1):
        ways = np.concatenate([ways, np.zeros(k)]) + np.concatenate([np.zeros(k), ways])
    return np.cumsum(ways) / 2.0**n


@lru_cache(maxsize=256)
def rank_sum_tail(n1: int, n2: int) -> np.ndarray:
    """P(U <= u) for samples of n1 and n2: by adding one rank of the smaller sample at a time."""
    m, n = min(n1, n2), max(n1, n2)
    # ways[j][u]: j of the ranks so far are the smaller sample's, u pairs are in order
    ways = [np.zeros(m * n + 1) for _ in range(m + 1)]
    ways[0][0] = 1.0
    for k in range(1, m + n + 1):
        for j in range(min(k, m), 0, -1):
            shift = k - j  # ranks of the larger sample below this one
            if shift <= n:
                moved = np.zeros_like(ways[j])
                moved[shift:] = ways[j - 1][: len(moved) - shift]
                ways[j] = ways[j] + moved
    return np.cumsum(ways[m]) / math.comb(m + n, m)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


#: Largest sample, and largest smaller sample and product, whose exact distribution is used.
EXACT_PAIRS, EXACT_SIDE, EXACT_PRODUCT = 50, 8, 20_000


def _p_column(fn, *columns: Column) -> Column:
    def p(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*series, strict=True)], dtype="float64")

    p.__annotations__ = {}
    return F.pandas_udf(p, "double", functionType=F.PandasUDFType.SCALAR)(*columns)


def _signed_p(n, w, z, exact):
    if exact:
        t = signed_rank_tail(int(n))
        w = int(min(w, n * (n + 1) / 2 - w))
        return min(1.0, 2.0 * float(t[w]))
    return _two_sided(z) if z == z else 1.0


def signed_rank(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """by, n (differences that are not 0), w_plus, z, exact, p, least_p: the two-sided signed-rank test.

    Exact for at most 50 differences without zeros or ties. If no difference
    is over 1e-8, p is 1; with fewer than two finite differences it is null.
    least_p is the least p that n differences can reach in the exact test.
    Null keys are groups of their own.
    """
    by = list(by)
    d = df.withColumn(delta, finite(delta))
    size = d.withColumn("_a", F.abs(delta)).withColumn("_up", F.col(delta) > 0)
    r = tied_ranks(size.filter(F.col(delta) != 0), by, "_a", {"up": F.col("_up")})
    s = r.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum(F.col("up") * (F.col("first") + F.col("last")) / 2.0).alias("w_plus"), F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("_tie")
    )
    total = d.groupBy(*by).agg(F.count(delta).alias("_all"), F.max(F.abs(delta)).alias("_most"))
    both = matched(total, s, by, "left").select(*by, "_all", "_most", F.coalesce("n", F.lit(0)).alias("n"), "w_plus", F.coalesce("_tie", F.lit(0)).alias("_tie"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    z = F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, F.sqrt(var))
    exact = (n > 0) & (n <= EXACT_PAIRS) & (n == F.col("_all")) & (F.col("_tie") == 0)
    out = both.withColumn("z", F.when(n > 0, z)).withColumn("exact", exact)
    p = F.when(F.col("_all") < 2, F.lit(None)).when(F.col("_most") <= 1e-8, F.lit(1.0)).otherwise(_p_column(_signed_p, n, F.coalesce("w_plus", F.lit(0.0)), F.coalesce("z", F.lit(float("nan"))), F.col("exact")))
    return out.select(*by, "n", "w_plus", "z", "exact", p.alias("p"), F.when(n >= 2, F.pow(F.lit(2.0), 1 - n)).alias("least_p"))


def _sum_p(n1, n2, u, sd, exact):
    if exact:
        t = rank_sum_tail(int(n1), int(n2))
        return min(1.0, 2.0 * float(t[int(min(u, n1 * n2 - u))]))
    return min(1.0, _two_sided(max(0.0, abs(u - n1 * n2 / 2.0) - 0.5) / sd)) if sd and sd == sd else 1.0


def rank_sum(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """by, n1, n2, u, z, exact, p of the rows whose boolean group is true against those where it is false.

    Exact if the smaller sample has at most 8 values, the product of sizes is
    at most 20000, and none tie; else the normal p has a continuity correction. A
    side with fewer than two values, or values that are all equal, give p = 1.
    Rows without a group, or without a finite value, play no part.
    """
    by = list(by)
    r = tied_ranks(df.filter(F.col(group).isNotNull()), by, value, {"m1": F.col(group)})
    s = r.groupBy(*by).agg(
        F.sum("m1").alias("n1"), F.sum(F.col("c") - F.col("m1")).alias("n2"), F.sum(F.col("m1") * (F.col("first") + F.col("last")) / 2.0).alias("_s"), F.sum(F.col("c") * (F.col("c") * F.col("c") - 1)).alias("_tie")
    )
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    var = n1 * n2 / 12.0 * (n + 1 - F.coalesce(F.try_divide(F.col("_tie"), n * (n - 1)), F.lit(0.0)))
    out = s.withColumn("u", F.col("_s") - n1 * (n1 + 1) / 2.0).withColumn("_sd", F.sqrt(F.greatest(var, F.lit(0.0))))
    out = out.withColumn("z", F.try_divide(F.col("u") - n1 * n2 / 2.0, F.col("_sd")))
    out = out.withColumn("exact", (F.col("_tie") == 0) & (F.least(n1, n2) >= 2) & (F.least(n1, n2) <= EXACT_SIDE) & (n1 * n2 <= EXACT_PRODUCT))
    p = F.when(F.least(n1, n2) < 2, F.lit(1.0)).otherwise(_p_column(_sum_p, n1, n2, F.col("u"), F.col("_sd"), F.col("exact")))
    return out.select(*by, "n1", "n2", "u", "z", "exact", p.alias("p"))


def _normal(values: pd.Series) -> pd.Series:
    """ln Phi(z)."""
    root = math.sqrt(2.0)
    return pd.Series([math.log(0.5 * math.erfc(-z / root)) if z > -37 else -0.5 * z * z - math.log(-z * math.sqrt(2 * math.pi)) for z in values], dtype="float64")


def _score(p: pd.Series) -> pd.Series:
    from statistics import NormalDist

    inv = NormalDist().inv_cdf
    return pd.Series([inv(x) for x in p], dtype="float64")


#: Royston's polynomials for the weights and for the p value of W, and the 5 % point of A2.
ROYSTON_A1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
ROYSTON_A2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_SMALL_MEAN, ROYSTON_SMALL_SD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_MEAN, ROYSTON_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
ROYSTON_GAMMA = (-2.273, 0.459)
ANDERSON_5 = 0.787


def _poly(c: Sequence[float], x: float) -> float:
    return sum(a * x**i for i, a in enumerate(c))


def _w_p(n, w):
    """p of Shapiro and Wilk's W."""
    if n < 3 or w != w:
        return float("nan")
    w = min(w, 1.0)
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return 1.0
    y = math.log(1 - w)
    if n <= 11:
        g = _poly(ROYSTON_GAMMA, n)
        if y >= g:
            return 1e-99
        y, m, s = -math.log(g - y), _poly(ROYSTON_SMALL_MEAN, n), math.exp(_poly(ROYSTON_SMALL_SD, n))
    else:
        x = math.log(n)
        m, s = _poly(ROYSTON_MEAN, x), math.exp(_poly(ROYSTON_SD, x))
    return 0.5 * math.erfc((y - m) / s / math.sqrt(2.0))


def normality(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, w, p_w (Shapiro-Wilk), k2, p_k2 (D'Agostino's skewness and kurtosis), a2, a2_critical (Anderson-Darling, 5 %).

    Over all finite values. W needs 3 values, K2 needs 8, A2 needs 2; values
    that are all equal have none of them. W's p is fitted to at most 5000
    values. The ranks of a repeated value are made in runs of 4096.
    """
    by = list(by)
    live = df.withColumn(value, finite(value)).filter(F.col(value).isNotNull())
    m = staged(live.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"), F.skewness(value).alias("_skew"), F.kurtosis(value).alias("_kurt")), "moments")
    r = staged(tied_ranks(live.select(*by, value), by, value), "ranks")
    both = matched(r, m.drop("_skew", "_kurt"), by)

    # A2: the sums of odd numbers over a run of ranks are differences of squares
    ln = F.pandas_udf(_normal, "double", functionType=F.PandasUDFType.SCALAR)
    z = F.try_divide(F.col(value) - F.col("_mean"), F.col("_sd") * F.sqrt(F.try_divide(F.col("n"), F.col("n") - 1)))
    at = both.filter("_sd > 0 and n > 1").withColumn("_z", z)
    sq = lambda c: c.cast("double") * c.cast("double")
    n = F.col("n")
    under, over = sq(F.col("last")) - sq(F.col("first") - 1), sq(n - F.col("first") + 1) - sq(n - F.col("last"))
    a2 = at.groupBy(*by).agg(F.sum(under * ln(F.col("_z")) + over * ln(-F.col("_z"))).alias("_a"))

    # W: expected scores of all ranks, their squares' sum, and the products with the values
    block = both.withColumn("_b", F.explode(F.sequence("first", "last", F.lit(4096).cast("long"))))
    each = block.withColumn("_i", F.explode(F.sequence("_b", F.least(F.col("_b") + 4095, F.col("last")))))
    score = F.pandas_udf(_score, "double", functionType=F.PandasUDFType.SCALAR)((F.col("_i") - 0.375) / (F.col("n") + 0.25))
    off = F.col(value) - F.col("_mean")
    scored = each.select(*by, "_i", "n", off.alias("_x"), score.alias("_m"))
    low = lambda k: F.max(F.when(F.col("_i") == k, F.col("_x")))
    high = lambda k: F.max(F.when(F.col("_i") == n - k + 1, F.col("_x")))
    top = lambda k: F.max(F.when(F.col("_i") == n - k + 1, F.col("_m")))
    sums = scored.groupBy(*by).agg(F.sum(F.col("_m") * F.col("_m")).alias("_mm"), F.sum(F.col("_m") * F.col("_x")).alias("_mx"), F.sum(F.col("_x") * F.col("_x")).alias("_xx"), *[f(k).alias(f"_{c}{k}") for c, f in (("l", low), ("h", high), ("m", top)) for k in (1, 2)])
    out = matched(matched(m, a2, by, "left"), sums, by, "left")

    # the outermost weights are Royston's polynomials in 1 / sqrt(n), the rest are scaled so that all squares sum to 1
    u = 1 / F.sqrt(n)
    poly = lambda c: sum((F.lit(a) * F.pow(u, F.lit(float(i))) for i, a in enumerate(c) if i), F.lit(0.0))
    size = F.sqrt(F.col("_mm"))
    one = F.when(n > 3, poly(ROYSTON_A1) + F.col("_m1") / size).otherwise(F.lit(math.sqrt(0.5)))
    two = poly(ROYSTON_A2) + F.col("_m2") / size
    ends1, ends2 = F.col("_h1") - F.col("_l1"), F.col("_h2") - F.col("_l2")
    m1, m2 = F.col("_m1"), F.col("_m2")
    phi1 = F.try_divide(F.col("_mm") - 2 * m1 * m1, 1 - 2 * one * one)
    phi2 = F.try_divide(F.col("_mm") - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * one * one - 2 * two * two)
    rest1 = F.try_divide(F.col("_mx") - m1 * ends1, F.sqrt(F.greatest(phi1, F.lit(1e-300))))
    rest2 = F.try_divide(F.col("_mx") - m1 * ends1 - m2 * ends2, F.sqrt(F.greatest(phi2, F.lit(1e-300))))
    along = F.when(n == 3, one * ends1).when(n <= 5, one * ends1 + rest1).otherwise(one * ends1 + two * ends2 + rest2)
    w = F.when((n >= 3) & (F.col("_sd") > 0), F.try_divide(along * along, F.col("_xx")))

    # K2
    skew_y = F.col("_skew") * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.log(w2)), F.sqrt(2 / (w2 - 1))
    z1 = delta * F.asinh(skew_y / alpha)
    b2, expected = F.col("_kurt") + 3, 3.0 * (n - 1) / (n + 1)
    spread = 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - expected) / F.sqrt(spread)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7.0) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(inner) * F.cbrt(F.abs(inner))) / F.sqrt(2 / (9 * a))
    k2 = F.when((n >= 8) & (F.col("_sd") > 0), z1 * z1 + z2 * z2)
    fit = out.withColumn("w", F.when(w.isNotNull(), F.least(w, F.lit(1.0)))).withColumn("k2", k2).withColumn("a2", -n - F.col("_a") / n)
    p_w = _p_column(_w_p, n, F.coalesce("w", F.lit(float("nan"))))
    return fit.select(
        *by, "n", "w", F.when(F.col("w").isNotNull(), p_w).alias("p_w"), "k2", F.exp(-F.col("k2") / 2).alias("p_k2"), "a2",
        F.when(F.col("a2").isNotNull(), F.lit(ANDERSON_5) / (1 + 4.0 / n - 25.0 / (n * n))).alias("a2_critical"),
    )
