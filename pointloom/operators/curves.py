"""Pooling of curves in long form (curve columns, r, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, percentile, sample_std_or_zero
from .ripley import k_of_l, l_of_k


def complete_only(curves: DataFrame, curve: Sequence[str], within: Sequence[str] = (), r: str = "r") -> DataFrame:
    """Curves that have every r that occurs in their group."""
    total = curves.groupBy(*within).agg(F.countDistinct(r).alias("_all")) if within else curves.agg(F.countDistinct(r).alias("_all"))
    have = curves.groupBy(*curve).agg(F.countDistinct(r).alias("_have"))
    both = have.join(total, list(within)) if within else have.crossJoin(total)  # one row
    return curves.join(both.filter("_have = _all").select(*curve), list(curve), "left_semi")


def percentile_band(curves: DataFrame, by: Sequence[str], value: str, low: float = 2.5, high: float = 97.5) -> DataFrame:
    return curves.groupBy(*by).agg(
        F.avg(finite(value)).alias("mean"), percentile(value, 50.0).alias("median"), percentile(value, low).alias("lo"), percentile(value, high).alias("hi"), F.count(finite(value)).alias("n")
    )


def mean_bands(curves: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 below two values), standard error, and mean -+ each."""
    agg = curves.groupBy(*by).agg(F.avg(finite(value)).alias("mean"), sample_std_or_zero(value).alias("sd"), F.count(finite(value)).alias("n"))
    out = agg.withColumn("sem", F.col("sd") / F.sqrt(F.greatest(F.col("n"), F.lit(1))))
    for s in ("sd", "sem"):
        out = out.withColumn(f"{s}_lo", F.col("mean") - F.col(s)).withColumn(f"{s}_hi", F.col("mean") + F.col(s))
    return out


def weighted_mean(curves: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Mean by weight, and without weights where they sum to zero; the variance divides by the sum of weights."""
    x, w = finite(value), F.when(finite(value).isNotNull(), F.coalesce(F.col(weight), F.lit(0.0)))
    a = curves.groupBy(*by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.avg(x).alias("plain"))
    mean = F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("plain"))
    return a.select(*by, mean.alias("mean"), F.when(F.col("w") > 0, F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(0.0))).alias("var"))


def k_space_pool(curves: DataFrame, by: Sequence[str], r: str = "r", k: str = "k", l: str | None = None) -> DataFrame:  # noqa: E741
    """L of the mean K, and of mean K -+ its deviation. K is recovered from L where it is missing."""
    value = F.col(k) if l is None else F.coalesce(F.col(k), k_of_l(F.col(l), F.col(r)))
    agg = curves.withColumn("_k", value).groupBy(*by, r).agg(F.avg(finite("_k")).alias("k_mean"), sample_std_or_zero("_k").alias("k_sd"), F.count(finite("_k")).alias("n"))
    return agg.select(
        *by, r, "k_mean", "k_sd", "n", l_of_k(F.col("k_mean"), F.col(r)).alias("l_mean"),
        l_of_k(F.col("k_mean") - F.col("k_sd"), F.col(r)).alias("l_lo"), l_of_k(F.col("k_mean") + F.col("k_sd"), F.col(r)).alias("l_hi"),
    )


def to_wide(curves: DataFrame, index: Sequence[str], replicate: str, value: str, replicates: list | None = None, prefix: str = "rep_") -> DataFrame:
    """One column for each replicate; name the replicates to save the pass that finds them."""
    p = curves.groupBy(*index).pivot(replicate, replicates) if replicates is not None else curves.groupBy(*index).pivot(replicate)
    out = p.agg(F.first(value))
    return out.select(*index, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in out.columns if c not in index])


def to_long(wide: DataFrame, index: Sequence[str], prefix: str = "rep_", replicate: str = "replicate", value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c.startswith(prefix)]
    pairs = F.explode(F.array(*[F.struct(F.lit(c[len(prefix) :]).alias("k"), F.col(f"`{c}`").alias("v")) for c in columns])).alias("_p")
    return wide.select(*index, pairs).select(*index, F.col("_p.k").alias(replicate), F.col("_p.v").alias(value))


def mean_sem_by_offset(real: DataFrame, control: DataFrame, unit: Sequence[str], offset: str, value: str) -> DataFrame:
    """Per offset: mean, sample deviation, count and standard error of real minus the unit's mean control."""
    c = control.groupBy(*unit, offset).agg(F.avg(value).alias("_c"))
    delta = real.groupBy(*unit).agg(F.avg(value).alias("_r")).join(c, list(unit)).withColumn("delta", F.col("_r") - F.col("_c"))
    return mean_bands(delta, [offset], "delta")


def min_max_scaled(df: DataFrame, by: Sequence[str], value: str, name: str = "scaled") -> DataFrame:
    """Value scaled to 0..1 within its group; 0 in a constant group."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(name, F.when(hi == lo, 0.0).otherwise((F.col(value) - lo) / (hi - lo)))
