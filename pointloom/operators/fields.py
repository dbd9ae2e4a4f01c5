"""Distance fields over cell tables, plateaus of maxima, regions and their classes.

A cell table has key columns, whole coordinates (two or three axes, given by
name) and a boolean. Cells that are not in the table are nobody's neighbours.
Rows with a null in the boolean are off; rows with a null coordinate are left
out. Coordinates lie within 2^30 of zero with two axes, 2^19 with three.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import drop_staged, staged
from .clusters import components


def lower_envelope(at: np.ndarray, g: np.ndarray, spacing: float = 1.0) -> np.ndarray:
    """min over j of g[j] + (spacing (at[i] - at[j]))^2 for each i; at ascends.

    Neighbours k places away are tried until even the nearest of them is
    farther than the greatest minimum.
    """
    best = g.copy()
    if not np.isfinite(g).any():
        return best
    for k in range(1, len(g)):
        gap = ((at[k:] - at[:-k]) * spacing) ** 2
        if gap.min() >= best.max():
            break
        np.minimum(best[k:], g[:-k] + gap, out=best[k:])
        np.minimum(best[:-k], g[k:] + gap, out=best[:-k])
    return best


def distance_field(cells: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("y", "x"), on: str = "on", spacing: Sequence[float] | None = None, full: bool = True) -> DataFrame:
    """cells with d2, the square of the exact distance to the nearest cell that is on; null where the key has none.

    full says that each key has all cells of its box. Where cells may be
    missing, full=False puts blank ones in their places for the passes.

    One pass for each axis: the first by windows along its lines, each further
    one over its lines as arrays, by the lower envelope of parabolas. A line
    of cells is the most that one task must hold.
    """
    step = [float(s) for s in spacing or [1.0] * len(axes)]
    out = cells.filter(" AND ".join(f"`{a}` IS NOT NULL" for a in axes))
    if not full:
        return _filled(out, keys, axes, on, step)
    first, rest = axes[0], list(axes[1:])
    line = Window.partitionBy(*keys, *rest).orderBy(first)
    lit = F.when(F.col(on), F.col(first))
    before = F.last(lit, True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(lit, True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    gap = F.least(F.col(first) - before, after - F.col(first)) * F.lit(step[0])
    out = out.withColumn("d2", F.coalesce(gap * gap, F.lit(float("inf"))).cast("double"))
    for axis, s in zip(rest, step[1:], strict=True):
        out = _along(out, keys, [a for a in axes if a != axis], axis, s)
    return out.withColumn("d2", F.when(F.col("d2") < float("inf"), F.col("d2")))


def _filled(cells: DataFrame, keys: Sequence[str], axes: Sequence[str], on: str, spacing: list[float]) -> DataFrame:
    """distance_field over cells and the blank cells of each key's box; only cells come back."""
    held = [c for c in cells.columns if c not in (*keys, *axes, on)]
    own = cells.select(*keys, *axes, on, F.struct(*[F.col(f"`{c}`") for c in held], F.lit(True).alias("_own")).alias("_held"))
    blank = cells.groupBy(*keys).agg(*[F.sequence(F.min(a), F.max(a)).alias(a) for a in axes]) if keys else cells.agg(*[F.sequence(F.min(a), F.max(a)).alias(a) for a in axes])
    for a in axes:
        blank = blank.withColumn(a, F.explode(a))
    every = own.unionByName(blank.withColumn(on, F.lit(False)), allowMissingColumns=True)
    field = distance_field(every, keys, axes, on, spacing).filter("_held._own")
    return field.select(*[F.col("_held").getField(c).alias(c) if c in held else F.col(f"`{c}`") for c in cells.columns], "d2")


def _along(field: DataFrame, keys: Sequence[str], others: Sequence[str], axis: str, spacing: float) -> DataFrame:
    """d2 after the pass along one axis; other columns ride along."""

    @F.pandas_udf("array<double>")
    def passed(at: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([lower_envelope(np.asarray(a, float), np.array(v, float), spacing) for a, v in zip(at, g, strict=True)])

    held = [c for c in field.columns if c not in (*keys, *others, axis, "d2")]
    line = F.array_sort(F.collect_list(F.struct(F.col(axis), F.col("d2"), F.struct(*[F.col(f"`{c}`") for c in held]).alias("_held"))))
    lines = field.groupBy(*keys, *others).agg(line.alias("_line")).withColumn("_d2", passed(F.col(f"_line.{axis}"), F.col("_line.d2")))
    each = lines.select(*keys, *others, F.explode(F.arrays_zip("_line", "_d2")).alias("_e"))
    return each.select(*keys, *others, F.col(f"_e._line.{axis}").alias(axis), *[F.col("_e._line._held").getField(c).alias(c) for c in held], F.col("_e._d2").alias("d2")).select(*field.columns)


def _bits(axes: Sequence[str]) -> int:
    return 62 // len(axes)


def cell_number(axes: Sequence[str]) -> Column:
    """One long for a cell, ascending in the order of the axes."""
    bits, out = _bits(axes), F.lit(0).cast("long")
    for a in axes:
        out = out * F.lit(1 << bits) + F.col(a).cast("long") + F.lit(1 << (bits - 1))
    return out


def _around(value: Column, keys: Sequence[str], axes: Sequence[str], df: DataFrame, name: str) -> DataFrame:
    """df with the greatest value of the cell and its neighbours, diagonal ones included: one window for each axis."""
    out = df.withColumn(name, value)
    for a in axes:
        line = Window.partitionBy(*keys, *[b for b in axes if b != a]).orderBy(a).rangeBetween(-1, 1)
        out = out.withColumn(name, F.max(name).over(line))
    return out


def regions(cells: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("y", "x"), value: str | None = None) -> DataFrame:
    """cells with region, the least cell_number of the cell's connected region, and area, the region's count of cells.

    Neighbours touch by sides, edges or corners; with `value` only cells of
    equal value are connected. Repeated cells count once.
    """
    k, bits = list(keys), _bits(axes)
    nodes = staged(cells.dropDuplicates([*k, *axes]).withColumn("_cell", cell_number(axes)), "cells")
    forward = [d for d in product((-1, 0, 1), repeat=len(axes)) if d > (0,) * len(axes)]
    moves = [sum(s << (bits * (len(axes) - 1 - i)) for i, s in enumerate(d)) for d in forward]
    same = [value] if value else []
    to = nodes.select(*k, *same, F.col("_cell").alias("a"), F.explode(F.array(*[F.col("_cell") + F.lit(m) for m in moves])).alias("b"))
    edges = to.join(nodes.select(*k, *same, F.col("_cell").alias("b")), [*k, *same, "b"]).select(*k, "a", "b")
    found = components(nodes.select(*k, "_cell"), edges, k, "_cell").withColumnRenamed("comp", "region")
    sized = found.groupBy(*k, "region").agg(F.count(F.lit(1)).alias("area"))
    return nodes.join(found, [*k, "_cell"]).join(sized, [*k, "region"]).select(*cells.columns, "region", "area")


def plateaus(field: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("y", "x"), value: str = "d2") -> DataFrame:
    """The cells of field's local maxima, with region and area.

    A maximum is a connected region of equal values none of whose neighbours
    is higher; it may touch the border. A key whose values are all equal has
    none, nor have null values. Equality is exact: give squares of distances,
    not their roots.
    """
    k = list(keys)
    top = _around(F.col(value), k, axes, field, "_top")
    top = staged(top.withColumn("_peak", F.coalesce(F.col(value) >= F.col("_top"), F.lit(False))), "tops")
    # a peak beside an equal cell that is none belongs to a region with a higher neighbour
    beside = _around(F.when(~F.col("_peak"), F.col(value)), k, axes, top, "_beside")
    flat = field.groupBy(*k).agg(F.min(value).alias("_least")) if k else None
    peaks = beside.filter("_peak").withColumn("_open", F.coalesce(F.col("_beside") == F.col(value), F.lit(False)))
    peaks = peaks.join(flat, k) if k else peaks.crossJoin(field.agg(F.min(value).alias("_least")))  # one row
    peaks = peaks.filter(F.col(value) > F.col("_least")).select(*field.columns, "_open")
    found = regions(peaks, k, axes, value)
    shut = found.groupBy(*k, "region").agg(F.max("_open").alias("_any")).filter("NOT _any").select(*k, "region")
    out = staged(found.join(shut, [*k, "region"], "left_semi").select(*field.columns, "region", "area"), "plateaus")
    drop_staged(top)
    return out


def classified(
    image: DataFrame, keys: Sequence[str], on: str = "on", vesicle_area: tuple[int, int] = (800, 2000), beyond: float = 5.0,
    cell_area: int = 5000, near: float = 10.0, far: float = 20.0,
) -> DataFrame:
    """keys, y, x, membrane, distance, vesicle, cell, outside, refined: what each pixel of a membrane image belongs to.

    vesicle: in a maximum of the distance to the membrane whose area lies in
    vesicle_area (both ends belong). cell: in a maximum farther than `beyond`
    of at least cell_area pixels. outside: neither cell nor membrane. refined:
    membrane, intracellular (at most `near` from it), extracellular (more than
    `far`), else unclassified. A maximum is never membrane, so taking vesicles
    off the membrane leaves it whole and one distance field serves all steps.
    An image without membrane has null distances and neither vesicles nor cells.
    """
    k, at = list(keys), [*keys, "y", "x"]
    marked = image.select(*at, F.coalesce(F.col(on), F.lit(False)).alias("membrane")).groupBy(*at).agg(F.max("membrane").alias("membrane"))
    field = staged(distance_field(marked, k, ("y", "x"), "membrane"), "field")
    low, high = vesicle_area
    far_enough = F.col("d2") > F.lit(float(beyond) ** 2)
    maxima = plateaus(field, k).select(*at, F.col("area").between(low, high).alias("vesicle"), (far_enough & (F.col("area") >= cell_area)).alias("cell"))
    out = field.join(maxima, at, "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("vesicle", "cell")})
    d2 = F.col("d2")
    refined = F.when(F.col("membrane"), "membrane").when(d2 <= float(near) ** 2, "intracellular").when(d2 > float(far) ** 2, "extracellular").otherwise("unclassified")
    return out.select(*at, "membrane", F.sqrt("d2").alias("distance"), "vesicle", "cell", (~F.col("cell") & ~F.col("membrane")).alias("outside"), refined.alias("refined"))


def class_counts(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pixels and the number of pixels of each class of classified()."""
    flags = [F.count_if(F.col(c)).alias(c) for c in ("membrane", "vesicle", "cell", "outside")]
    of = [F.count_if(F.col("refined") == c).alias(c) for c in ("intracellular", "extracellular", "unclassified")]
    return pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), *flags, *of)
