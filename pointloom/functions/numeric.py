"""Numeric conventions: NaN is NULL, which deviation a table takes, percentiles, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or NULL for NaN and the infinities."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def distance(a: str = "a_", b: str = "b_", axes: str = "xyz") -> Column:
    """Euclidean distance between the columns with two prefixes, axes added in order."""
    total = None
    for k in axes:
        d = F.col(a + k) - F.col(b + k)
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def pop_std(c: str | Column) -> Column:
    return F.stddev_pop(finite(c))


def sample_std_or_zero(c: str | Column) -> Column:
    """Sample deviation, 0 where there are fewer than two values."""
    return F.coalesce(F.stddev_samp(finite(c)), F.lit(0.0))


def percentile(c: str | Column, p: float) -> Column:
    """Exact percentile with linear interpolation; p in percent."""
    return F.percentile(finite(c), F.lit(p / 100.0))


def distance_class(d: str | Column, fusing: float = 1.0, close: float = 20.0) -> Column:
    """unknown, fusing (d <= fusing), close (d <= close) or far."""
    x = finite(d)
    return F.when(x.isNull(), "unknown").when(x <= fusing, "fusing").when(x <= close, "close").otherwise("far")


def synaptic(d: str | Column, cutoff: float = 30.0) -> Column:
    """synaptic within the cutoff; missing distances are extrasynaptic."""
    return F.when(finite(d) <= cutoff, "synaptic").otherwise("extrasynaptic")


def per_particle_area(density: str | Column) -> Column:
    x = finite(density)
    return F.when(x > 0, 1.0 / x)


def neg_log10(p: str | Column, floor: float = 1e-300) -> Column:
    return -F.log10(F.greatest(col(p), F.lit(floor)))


def affine(m: list[list[float]], x: str = "x", y: str = "y", z: str = "z") -> tuple[Column, Column, Column]:
    """Rows 0 to 2 of a 4 x 4 matrix applied to a point."""
    p = [F.col(x), F.col(y), F.col(z)]
    return tuple(p[0] * float(r[0]) + p[1] * float(r[1]) + p[2] * float(r[2]) + float(r[3]) for r in m[:3])  # type: ignore[return-value]


def inside_extent(coords: tuple[Column, ...], extent: tuple[int, ...]) -> Column:
    """Coordinates shifted by half the extent lie in [0, extent)."""
    ok = F.lit(True)
    for c, e in zip(coords, extent, strict=True):
        s = c + e // 2
        ok = ok & (s >= 0) & (s < e)
    return ok


def round_six(c: str) -> Column:
    """F.round(c, 6), by a division where no tie is near: a row for each pair spends most of its time in decimals otherwise."""
    v = F.col(c) * F.lit(1e6)
    whole = F.floor(v + 0.5)
    # the product is off by less than 1e-4 below a million, so only what is nearer to a tie has to be a decimal
    sure = (F.abs(F.col(c)) < 1e6) & (F.abs(v + 0.5 - whole) > 1e-3) & (F.abs(v - 0.5 - whole) > 1e-3)
    return F.when(sure, whole / F.lit(1e6)).otherwise(F.round(F.col(c), 6))
