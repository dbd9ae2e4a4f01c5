"""Bivariate K, L and pair-correlation curves in long form: (keys, r, value).

Counts are strict: a partner counts at r if d < r. Pairs are binned once and
summed by a window over r, so a curve costs one join whatever its radii.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..staging import staged
from .spatial import betweenness, inside_hull, within

SPHERE = 4.0 / 3.0 * math.pi

#: Points of a chunk, and rows of it that meet another chunk at a time.
CHUNK, ROWS = 4096, 64


def radius_grid(step: float, r_max: float) -> Column:
    """step, 2 step, .. up to r_max, as an array of bin numbers 1.."""
    return F.sequence(F.lit(1), F.lit(int(math.floor(r_max / step + 0.5))))


def binned(foci: DataFrame, partners: DataFrame, step: float, r_max: float, keys: Sequence[str], by: Sequence[str] = (), axes: str = "xyz", exclude_self: bool = False) -> DataFrame:
    """keys, by (focus columns), bin, n: a pair is in bin k if (k - 1) step <= d < k step."""
    pairs = within(foci, partners, r_max, keys, axes)
    if exclude_self:
        pairs = pairs.filter(F.col("a_id") != F.col("b_id"))
    b = (F.floor(F.col("d") / F.lit(float(step))) + 1).cast("int").alias("bin")
    last = int(math.floor(r_max / step + 0.5))
    return pairs.select(*keys, *[F.col(f"a_{c}").alias(c) for c in by], b).filter(F.col("bin") <= last).groupBy(*keys, *by, "bin").agg(F.count(F.lit(1)).alias("n"))


def cumulated(base: DataFrame, bins: DataFrame, step: float, r_max: float, on: Sequence[str]) -> DataFrame:
    """base rows x all radii with bin, r and count: partners with d < r."""
    grid = base.withColumn("bin", F.explode(radius_grid(step, r_max)))
    w = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = grid.hint("merge").join(bins, [*on, "bin"], "left")
    return full.withColumn("count", F.sum(F.coalesce("n", F.lit(0))).over(w)).withColumn("r", F.col("bin") * F.lit(float(step))).drop("n")


def volumes(points: DataFrame, keys: Sequence[str], axes: str = "xyz") -> DataFrame:
    """Volume (or area) of each key's bounding box."""
    v = None
    for k in axes:
        s = F.max(k) - F.min(k)
        v = s if v is None else v * s
    return points.groupBy(*keys).agg(v.alias("volume"))


def lattice(points: DataFrame, h: float, keys: Sequence[str]) -> DataFrame:
    """Points of spacing h from the least corner of each key's bounding box."""
    box = points.groupBy(*keys).agg(*[F.min(k).alias(f"l{k}") for k in "xyz"], *[F.floor((F.max(k) - F.min(k)) / F.lit(float(h))).cast("int").alias(f"n{k}") for k in "xyz"])
    out = box
    for k in "xyz":
        out = out.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0), F.col(f"n{k}"))))
    return out.select(*keys, *[(F.col(f"l{k}") + F.col(f"i{k}") * F.lit(float(h))).alias(k) for k in "xyz"])


def edge_factors(foci: DataFrame, grid: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """keys, id, bin, r, in_grid, p: share of each focus's ball that lies in the window, at most 1, and 1 where it has no grid point."""
    bins = binned(foci, grid, step, r_max, keys, [id_col])
    out = cumulated(foci.select(*keys, id_col), bins, step, r_max, [*keys, id_col])
    share = F.col("count") * F.lit(float(h) ** 3) / (F.lit(SPHERE) * F.col("r") * F.col("r") * F.col("r"))
    return out.withColumn("p", F.when(F.col("count") == 0, 1.0).otherwise(F.least(F.lit(1.0), share))).withColumnRenamed("count", "in_grid")


def box_edge_factors(foci: DataFrame, points: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """edge_factors over lattice(points, h, keys), without a row for each grid point.

    The grid of a box is the product of three axes, so each focus counts it in
    arrays where the focus is read; a key's box is one row.
    """
    import numpy as np
    import pyarrow as pa

    keys, last = list(keys), int(math.floor(r_max / step + 0.5))
    box = points.groupBy(*keys).agg(*[F.min(k).alias(f"_l{k}") for k in "xyz"], *[F.floor((F.max(k) - F.min(k)) / F.lit(float(h))).cast("int").alias(f"_n{k}") for k in "xyz"])
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = foci.select(*keys, id_col, "x", "y", "z").join(box, keys).repartition(parts)  # small rows, long work
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in joined.select(*keys, id_col).schema]

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            at, low, n = [list(zip(*[col(f"{p}{k}") for k in "xyz"], strict=True)) for p in ("", "_l", "_n")]
            counts = []
            for p, lo, m in zip(at, low, n, strict=True):
                if None in p:
                    counts.append([0] * last)
                    continue
                near = []  # squared distances along each axis, of what is in reach
                for k in range(3):
                    d = p[k] - (lo[k] + np.arange(m[k] + 1) * float(h))
                    near.append((d * d)[np.abs(d) <= r_max])
                d = np.sqrt((near[0][:, None, None] + near[1][None, :, None]) + near[2][None, None, :]).ravel()
                bins = np.floor(d[d <= r_max] / float(step)).astype(np.int64)
                counts.append(np.cumsum(np.bincount(bins, minlength=last)[:last]).tolist())
            kept = [b.column(b.schema.get_field_index(c)) for c in [*keys, id_col]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.list_(pa.int64()))], names=[*keys, id_col, "_c"])

    out = joined.mapInArrow(run, ", ".join([*kinds, "_c array<long>"])).select(*keys, id_col, F.posexplode("_c").alias("_b", "in_grid"))
    out = out.withColumn("bin", F.col("_b") + 1).withColumn("r", F.col("bin") * F.lit(float(step))).drop("_b")
    share = F.col("in_grid") * F.lit(float(h) ** 3) / (F.lit(SPHERE) * F.col("r") * F.col("r") * F.col("r"))
    return out.withColumn("p", F.when(F.col("in_grid") == 0, 1.0).otherwise(F.least(F.lit(1.0), share)))


def window_grid(points: DataFrame, planes: DataFrame, h: float, keys: Sequence[str], pre: DataFrame | None = None, post: DataFrame | None = None, limit: float = 50.0) -> DataFrame:
    """Lattice points (keys, id, x, y, z) of each key's window: inside the hull of its planes and, with surfaces, between them."""
    grid = lattice(points, h, keys).withColumn("id", F.struct("x", "y", "z"))
    out = inside_hull(grid, planes, keys)
    return out if pre is None else betweenness(out, pre, post, keys, limit)


def window_volumes(grid: DataFrame, h: float, keys: Sequence[str]) -> DataFrame:
    """keys, volume of the window that a grid of spacing h fills."""
    return grid.groupBy(*keys).agg((F.count(F.lit(1)) * F.lit(float(h) ** 3)).alias("volume"))


def cross_k(foci: DataFrame, partners: DataFrame, volume: DataFrame, step: float, r_max: float, keys: Sequence[str], axes: str = "xyz", factors: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """keys, bin, r, n1, n2, count, k: K(r) = V / (n1 n2) * sum over foci of count / p.

    volume: keys, volume. factors: from edge_factors, else p is 1.
    """
    n1 = foci.groupBy(*keys).agg(F.count(F.lit(1)).alias("n1"))
    n2 = partners.groupBy(*keys).agg(F.count(F.lit(1)).alias("n2"))
    base = n1.join(n2, list(keys)).join(volume, list(keys))
    if factors is None:
        bins = binned(foci, partners, step, r_max, keys, (), axes, exclude_self)
        out = cumulated(base, bins, step, r_max, keys)
        weighted = F.col("count")
    else:
        each = focus_counts(foci, partners, step, r_max, keys, axes, exclude_self)
        both = each.join(factors.select(*keys, "id", "bin", "p").hint("merge"), [*keys, "id", "bin"])  # a row for each focus and radius
        sums = both.groupBy(*keys, "bin", "r").agg(F.sum("count").alias("count"), F.sum(F.col("count") / F.col("p")).alias("w"))
        out = base.join(sums, list(keys))
        weighted = F.col("w")
    return out.withColumn("k", F.col("volume") / (F.col("n1") * F.col("n2")) * weighted)


def focus_counts(foci: DataFrame, partners: DataFrame, step: float, r_max: float, keys: Sequence[str], axes: str = "xyz", exclude_self: bool = False) -> DataFrame:
    """keys, id, bin, r, count for every focus."""
    return cumulated(foci.select(*keys, "id"), binned(foci, partners, step, r_max, keys, ["id"], axes, exclude_self), step, r_max, [*keys, "id"])


def _chunks(a: DataFrame, b: DataFrame, r_max: float, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """a and b (keys, id, x, y, z, all finite) with the columns on which their chunks meet: cells of side r_max or more, each dealt to chunks of about CHUNK points."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = a.select(*keys, *"xyz").unionByName(b.select(*keys, *"xyz"))
    box = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[(F.max(k) - F.min(k) + F.lit(float(r_max))).alias(f"_s{k}") for k in "xyz"])
    side = F.greatest(F.lit(float(r_max)), F.cbrt(F.col("_sx") * F.col("_sy") * F.col("_sz") * CHUNK / F.col("_n")))
    box, cells = staged(box.select(*keys, side.alias("_side")), "box"), [f"_c{k}" for k in "xyz"]

    def dealt(df: DataFrame, name: str) -> DataFrame:
        at = df.join(box, keys).withColumns({f"_c{k}": F.floor(F.col(k) / F.col("_side")) for k in "xyz"}).drop("_side")
        sizes = at.groupBy(*keys, *cells).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_k"))
        sub = F.pmod(F.xxhash64("id", *"xyz"), F.col("_k"))
        return staged(at.join(sizes, [*keys, *cells]).withColumn(name, F.concat_ws(",", *cells, sub)).drop("_k"), "dealt")

    a, b = dealt(a, "_a"), dealt(b, "_b")
    around = a.select(*keys, *cells, "_a").distinct()
    for c in cells:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    on = [*keys, "_a", "_b"]
    pairs = staged(around.join(b.select(*keys, *cells, "_b").distinct(), [*keys, *cells]).select(*on), "chunk_pairs")
    left, right = (df.drop(*cells).join(pairs, [*keys, c]).repartition(parts, *on) for df, c in ((a, "_a"), (b, "_b")))
    return left, right, on


def focus_arrays(foci: DataFrame, partners: DataFrame, step: float, r_max: float, keys: Sequence[str]) -> DataFrame:
    """keys, id, counts: focus_counts as one array for each focus with a partner in reach, met in chunks without a row for a pair."""
    import numpy as np
    import pyarrow as pa

    keys, last = list(keys), int(math.floor(r_max / step + 0.5))
    a, b = (df.select(*keys, "id", *[finite(k).alias(k) for k in "xyz"]).dropna(subset=list("xyz")) for df in (foci, partners))
    left, right, on = _chunks(a, b, r_max, keys)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*keys, "id").schema]

    def run(key: tuple, one, two):
        p, q = (np.column_stack([t[k].to_numpy() for k in "xyz"]) for t in (one, two))
        counts = np.zeros((len(p), last), np.int64)
        for i in range(0, len(p) if len(q) else 0, ROWS):
            d = (p[i : i + ROWS, 0][:, None] - q[:, 0]) ** 2
            for k in (1, 2):
                d += (p[i : i + ROWS, k][:, None] - q[:, k]) ** 2
            d = np.sqrt(d, out=d)
            far = d > r_max
            d /= float(step)
            bins = d.astype(np.int64)  # no distance is negative
            bins[far | (bins > last)] = last
            bins += np.arange(len(bins))[:, None] * (last + 1)
            counts[i : i + ROWS] = np.bincount(bins.ravel(), minlength=len(bins) * (last + 1)).reshape(len(bins), -1)[:, :last].cumsum(1)
        out = {k: pa.array([v.as_py()] * len(p), v.type) for k, v in zip(keys, key, strict=False)}
        return pa.table({**out, "id": one["id"], **{f"_{i}": pa.array(counts[:, i]) for i in range(last)}})

    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, ", ".join([*kinds, *[f"_{i} long" for i in range(last)]]))
    sums = met.groupBy(*keys, "id").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(last)])
    return sums.select(*keys, "id", F.array(*[f"_{i}" for i in range(last)]).alias("counts"))


def pair_sums(a: DataFrame, b: DataFrame, step: float, r_max: float, keys: Sequence[str], by: str | None = None) -> DataFrame:
    """keys, by, bin, w12, w21: over the pairs with d < r, the sum of the first's weights at r, and that of the second's.

    a: keys, by (a long, the set of a row), id, x, y, z, w (an array with a
    weight for each radius); b: keys, id, x, y, z, w. Both directions and all
    sets meet once, and nothing has a row for a pair: points lie in cells of
    side r_max or more, a cell is dealt to chunks of about CHUNK points, and
    two chunks meet in a task. Radii at which no pair meets have no row.
    """
    import numpy as np
    import pyarrow as pa

    keys, last = list(keys), int(math.floor(r_max / step + 0.5))
    a = a.select(*keys, (F.col(by) if by else F.lit(0)).cast("long").alias("_set"), "id", *[finite(k).alias(k) for k in "xyz"], "w").dropna(subset=list("xyz"))
    b = b.select(*keys, "id", *[finite(k).alias(k) for k in "xyz"], "w").dropna(subset=list("xyz"))
    left, right, on = _chunks(a, b, r_max, keys)
    left, right = left.drop("id"), right.drop("id")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in a.select(*keys).schema]

    def run(key: tuple, one, two):
        sums: dict[int, np.ndarray] = {}
        if len(one) and len(two):
            (p, w1), (q, w2) = ((np.column_stack([t[k].to_numpy() for k in "xyz"]), t["w"].combine_chunks().flatten().to_numpy().reshape(len(t), last)) for t in (one, two))
            of, columns = one["_set"].to_numpy(), np.arange(len(q)) * (last + 1)
            for s in np.unique(of).tolist():
                mine = np.flatnonzero(of == s)
                seen, w12 = np.zeros((len(q), last)), np.zeros(last)
                for i in range(0, len(mine), ROWS):
                    rows = mine[i : i + ROWS]
                    d = (p[rows, 0][:, None] - q[:, 0]) ** 2
                    for k in (1, 2):
                        d += (p[rows, k][:, None] - q[:, k]) ** 2
                    d = np.sqrt(d, out=d)
                    far = d > r_max
                    d /= float(step)
                    bins = d.astype(np.int64)  # no distance is negative
                    bins[far | (bins > last)] = last
                    n = np.bincount((bins + np.arange(len(rows))[:, None] * (last + 1)).ravel(), minlength=len(rows) * (last + 1)).reshape(len(rows), -1)
                    w12 += (n[:, :last].cumsum(1) * w1[rows]).sum(0)
                    bins += columns
                    seen += np.bincount(bins.ravel(), minlength=len(q) * (last + 1)).reshape(len(q), -1)[:, :last]
                sums[s] = np.stack([w12, (seen.cumsum(1) * w2).sum(0)])
        n = len(sums) * last
        out = {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key, strict=False)}
        whole = np.concatenate([*sums.values()], 1) if sums else np.zeros((2, 0))
        return pa.table({**out, "_set": pa.array(np.repeat(np.array([*sums], np.int64), last)), "bin": pa.array(np.tile(np.arange(1, last + 1, dtype=np.int32), len(sums))), "w12": pa.array(whole[0]), "w21": pa.array(whole[1])})

    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, ", ".join([*kinds, "_set long, bin int, w12 double, w21 double"]))
    sums = met.groupBy(*keys, "_set", "bin").agg(F.sum("w12").alias("w12"), F.sum("w21").alias("w21")).filter("w12 > 0 or w21 > 0")
    return sums.withColumnRenamed("_set", by) if by else sums.drop("_set")


def focus_k(foci: DataFrame, partners: DataFrame, volume: DataFrame, step: float, r_max: float, keys: Sequence[str], factors: DataFrame | None = None) -> DataFrame:
    """One curve for each focus: V / n2 * count / p."""
    n2 = partners.groupBy(*keys).agg(F.count(F.lit(1)).alias("n2"))
    out = focus_counts(foci, partners, step, r_max, keys).join(n2, list(keys)).join(volume, list(keys))
    if factors is not None:
        out = out.join(factors.select(*keys, "id", "bin", "p"), [*keys, "id", "bin"])
    p = F.col("p") if factors is not None else F.lit(1.0)
    return out.withColumn("k", F.col("volume") / F.col("n2") * F.col("count") / p)


def l_of_k(k: Column, r: Column) -> Column:
    return F.cbrt(F.lit(3.0) * F.greatest(k, F.lit(0.0)) / F.lit(4.0 * math.pi)) - r


def k_of_l(l: Column, r: Column) -> Column:  # noqa: E741
    s = F.greatest(l + r, F.lit(0.0))
    return F.lit(SPHERE) * s * s * s


def h_of_k(k: Column, r: Column) -> Column:
    """The planar transform."""
    return F.sqrt(F.greatest(k, F.lit(0.0)) / F.lit(math.pi)) - r


def combined(n1: Column, k12: Column, n2: Column, k21: Column) -> Column:
    return (n1 * k12 + n2 * k21) / (n1 + n2)


def symmetric(a: DataFrame, b: DataFrame, volume: DataFrame, step: float, r_max: float, keys: Sequence[str]) -> DataFrame:
    """keys, bin, r, n1, n2, k12, k21, k_combined and the L of each; L of the combined K, not a mean of L."""
    k12 = cross_k(a, b, volume, step, r_max, keys).select(*keys, "bin", "r", "n1", "n2", F.col("k").alias("k12"))
    k21 = cross_k(b, a, volume, step, r_max, keys).select(*keys, "bin", F.col("k").alias("k21"))
    out = k12.join(k21, [*keys, "bin"]).withColumn("k_combined", combined(F.col("n1"), F.col("k12"), F.col("n2"), F.col("k21")))
    for s in ("12", "21", "_combined"):
        out = out.withColumn(f"l{s}", l_of_k(F.col(f"k{s}"), F.col("r")))
    return out


def pair_correlation(curves: DataFrame, keys: Sequence[str], width: int, step: float, k: str = "k", name: str = "g") -> DataFrame:
    """g over shells of `width` bins that tile the grid; K(0) = 0, and a partial last shell is left out."""
    w = Window.partitionBy(*keys).orderBy("bin")
    hi, lo = F.col("bin") * F.lit(float(step)), (F.col("bin") - width) * F.lit(float(step))
    shell = F.lit(SPHERE) * (hi * hi * hi - lo * lo * lo)
    g = (F.col(k) - F.coalesce(F.lag(k, width).over(w), F.lit(0.0))) / shell
    return curves.withColumn(name, g).filter(F.col("bin") % width == 0)


def shell_reliability(factors: DataFrame, keys: Sequence[str], width: int, least: int = 8) -> DataFrame:
    """keys, bin, in_shell, reliable: grid points of a shell summed over foci, and whether they are enough."""
    sums = factors.groupBy(*keys, "bin").agg(F.sum("in_grid").alias("_c"))
    w = Window.partitionBy(*keys).orderBy("bin")
    n = F.col("_c") - F.coalesce(F.lag("_c", width).over(w), F.lit(0))
    return sums.withColumn("in_shell", n).filter(F.col("bin") % width == 0).withColumn("reliable", F.col("in_shell") >= least).drop("_c")
