"""Windows of 3-D point patterns: the hull of a cloud and, with two surfaces, what lies between them.

A window is a table of tiles: cubes of SIDE lattice points each way, one bit a
point. Nothing has a row for each lattice point. Volumes are sums of bits, and
a focus's edge factors come from the tiles in its reach, which geometry bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .ripley import SPHERE
from .spatial import betweenness, inside_hull, nearest, within

SIDE = 8


def members(points: DataFrame, planes: DataFrame, keys: Sequence[str], pre: DataFrame | None = None, post: DataFrame | None = None, limit: float = 50.0, id_col: str = "id") -> DataFrame:
    """The points of each key's window; without surfaces, those of the hull."""
    out = inside_hull(points, planes, keys, id_col)
    return out if pre is None else betweenness(out, pre, post, keys, limit, id_col)


def _reaching(tiles: DataFrame, surface: DataFrame, half: float, keys: list[str], name: str) -> DataFrame:
    """tiles with an array (id, x, y, z) of the surface points that can be nearest to a point of the tile.

    The nearest point of the centre, d away, is within d + half of all the
    tile, so none farther than d + 2 half from the centre can be nearer. Tiles
    join by powers of two of that radius, so far tiles do not set the cells.
    """
    on = [*keys, "tile"]
    reach = (F.col("d") + 2 * half) * (1 + 1e-9) + 1e-9
    near = staged(nearest(tiles.select(*keys, "tile", "x", "y", "z"), surface, keys, "tile").select(*keys, F.col("a_tile").alias("tile"), "d"), "gaps")
    sized = tiles.join(near, on).withColumn("_reach", reach).withColumn("_class", F.ceil(F.log2(F.col("_reach") / half)).cast("int"))
    out = None
    for k in [r[0] for r in sized.select("_class").distinct().collect()]:  # the logarithm of the extent over a tile's size bounds their number
        part = sized.filter(F.col("_class") == k).select(*on, "x", "y", "z", "_reach")
        met = within(part, surface.select(*keys, "id", "x", "y", "z"), half * 2.0**k * (1 + 1e-9), keys).filter(F.col("d") <= F.col("a__reach"))
        part = met.groupBy(*keys, F.col("a_tile").alias("tile")).agg(F.sort_array(F.collect_list(F.struct(F.col("b_id").alias("id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("b_z").alias("z")))).alias(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = tiles.limit(0).select(*on, F.array(F.struct(F.lit(0).cast("long").alias("id"), "x", "y", "z")).alias(name))
    return tiles.join(out, on).join(near.withColumnRenamed("d", f"d_{name}"), on)


def nearest_of(points: np.ndarray, cloud: np.ndarray) -> np.ndarray:
    """Row of the cloud nearest to each point, ties to the first.

    Points are halved along their longest side, and each half goes on with
    the rows that can still be nearest to one of its points.
    """
    out = np.zeros(len(points), np.int64)
    todo = [(np.arange(len(points)), np.arange(len(cloud)))]
    while todo:
        mine, rows = todo.pop()
        p, c = points[mine], cloud[rows]
        if len(mine) <= 8 or len(rows) <= 32:
            out[mine] = rows[((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)]
            continue
        low, high = p.min(0), p.max(0)
        axis, centre = int((high - low).argmax()), (low + high) / 2
        d = np.sqrt(((c - centre) ** 2).sum(1))
        kept = rows[d <= (d.min() + math.sqrt(((high - low) ** 2).sum())) * (1 + 1e-9) + 1e-9]
        upper = p[:, axis] > centre[axis]
        todo += [(m, kept) for m in (mine[~upper], mine[upper]) if len(m)]
    return out


def tiles(points: DataFrame, planes: DataFrame, h: float, keys: Sequence[str], pre: DataFrame | None = None, post: DataFrame | None = None, limit: float = 50.0) -> DataFrame:
    """keys, lx, ly, lz (the lattice point of the tile's corner), x, y, z (its centre), bits, n: the window's tiles.

    The lattice has spacing h and begins at the least corner of the key's
    points, whose hull the planes (nx, ny, nz, c) are. With surfaces (keys,
    id, x, y, z) the window is what lies between them. Tiles without a point
    are left out; a key without planes, or with one surface only, has none.
    """
    keys, span = list(keys), (SIDE - 1) * float(h)
    half = span * math.sqrt(3) / 2
    box = points.groupBy(*keys).agg(*[F.min(k).alias(f"m{k}") for k in "xyz"], *[F.floor((F.max(k) - F.min(k)) / F.lit(float(h))).cast("int").alias(f"n{k}") for k in "xyz"])
    out = box.dropna()
    for k in "xyz":
        out = out.withColumn(f"t{k}", F.explode(F.sequence(F.lit(0), F.floor(F.col(f"n{k}") / SIDE).cast("int"))))
    out = out.withColumn("tile", F.struct("tx", "ty", "tz"))
    for k in "xyz":
        out = out.withColumn(f"l{k}", F.col(f"m{k}") + F.col(f"t{k}") * SIDE * F.lit(float(h))).withColumn(k, F.col(f"l{k}") + span / 2)
    facets = planes.groupBy(*keys).agg(F.collect_list(F.struct("nx", "ny", "nz", "c")).alias("facets"))
    clear = F.forall("facets", lambda f: f["nx"] * F.col("x") + f["ny"] * F.col("y") + f["nz"] * F.col("z") + f["c"] <= half + 1e-6)
    out = out.join(facets, keys).filter(clear)
    lists = []
    if pre is not None:
        out = staged(out, "tiles")
        for name, surface in (("pre", pre), ("post", post)):
            out = _reaching(out, surface, half, keys, name)
            lists.append(name)
        out = out.filter(F.least("d_pre", "d_post") <= limit + half)
    kept = [*keys, *[f"l{k}" for k in "xyz"], "x", "y", "z"]
    slim = out.select(*kept, *[f"{p}{k}" for p in "mnt" for k in "xyz"], "facets", *lists)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*kept).schema)

    def run(batches):
        steps = np.stack(np.meshgrid(*[np.arange(SIDE)] * 3, indexing="ij"), -1).reshape(-1, 3)
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            low, n, t = [np.column_stack([col(f"{p}{k}").to_numpy(zero_copy_only=False) for k in "xyz"]) for p in "mnt"]
            bits, counts = [], []
            for i in range(len(b)):
                at = t[i] * SIDE + steps
                p = low[i] + at * float(h)
                planes_ = np.array([list(f.values()) for f in col("facets")[i].as_py()])
                ok = (at <= n[i]).all(1)
                ok[ok] = (p[ok] @ planes_[:, :3].T + planes_[:, 3] <= 1e-6).all(1)
                if lists and ok.any():
                    q, away = p[ok], []
                    for name in lists:
                        cloud = np.array([[s["x"], s["y"], s["z"]] for s in col(name)[i].as_py()])
                        away.append(cloud[nearest_of(q, cloud)] - q)
                    d = [np.sqrt((v * v).sum(1)) for v in away]
                    ok[ok] = ((away[0] * away[1]).sum(1) < 0) & (np.minimum(*d) <= limit)
                bits.append(np.packbits(ok).tobytes())
                counts.append(int(ok.sum()))
            yield pa.RecordBatch.from_arrays([*[col(c) for c in kept], pa.array(bits, pa.binary()), pa.array(counts, pa.int64())], names=[*kept, "bits", "n"])

    return slim.mapInArrow(run, f"{kinds}, bits binary, n long").filter("n > 0")


def volumes(window: DataFrame, h: float, keys: Sequence[str]) -> DataFrame:
    """keys, volume: as many cells of the lattice as the window has points."""
    return window.groupBy(*keys).agg((F.sum("n") * F.lit(float(h) ** 3)).alias("volume"))


#: Foci of a cell that meet its window in one task, and how many at a time.
FOCI, ROWS = 2048, 64


def shares(foci: DataFrame, window: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """keys, id, x, y, z, in_grid, p: for each focus arrays over the radii, of the window's points in its ball and of their share of it.

    A share is at most 1, and 1 where the ball has no lattice point. Foci whose
    key has no window are left out; foci with a null coordinate reach nothing,
    so their p is 1. Foci of a cell and the tiles around it meet in a task.
    """
    keys, last = list(keys), int(math.floor(r_max / step + 0.5))
    reach = float(r_max) + (SIDE - 1) * float(h) * math.sqrt(3) / 2
    parts = int(foci.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = [f"_c{k}" for k in "xyz"]
    cell = {f"_c{k}": F.floor(F.col(k) / F.lit(reach)) for k in "xyz"}
    mine = foci.select(*keys, id_col, "x", "y", "z").join(window.select(*keys).distinct(), keys, "left_semi").withColumns(cell)
    sizes = mine.groupBy(*keys, *cells).agg(F.ceil(F.count(F.lit(1)) / FOCI).alias("_k"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, *cells)]
    mine = mine.alias("m").join(sizes.alias("s"), same).select("m.*", F.pmod(F.xxhash64(f"m.{id_col}", *"xyz"), F.col("_k")).alias("_sub"))
    near = window.select(*keys, "x", "y", "z", "lx", "ly", "lz", "bits").withColumns(cell).drop("x", "y", "z")
    for c in cells:
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    near = near.join(sizes, [*keys, *cells]).withColumn("_sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))).drop("_k")
    on = [*keys, *cells, "_sub"]
    left, right = (df.repartition(parts, *on) for df in (mine, near))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mine.select(*keys, id_col, "x", "y", "z").schema)

    def run(key, these, tiles):
        steps = np.stack(np.meshgrid(*[np.arange(SIDE)] * 3, indexing="ij"), -1).reshape(-1, 3) * float(h)
        counts = np.zeros((len(these), last), np.int64)
        if len(these) and len(tiles):
            at = np.column_stack([these[k].to_numpy() for k in "xyz"])
            corners = np.column_stack([tiles[k].to_numpy() for k in ("lx", "ly", "lz")])
            inside = np.unpackbits(np.frombuffer(b"".join(tiles["bits"].to_pylist()), np.uint8)).astype(bool)
            lattice = (corners[:, None] + steps[None]).reshape(-1, 3)[inside]
            for i in range(0, len(at), ROWS):
                some = at[i : i + ROWS]
                off = [(some[:, k][:, None] - lattice[:, k]) ** 2 for k in range(3)]
                d = np.sqrt((off[0] + off[1]) + off[2])
                far = ~(d <= r_max)
                d[far] = 0.0
                bins = (d / float(step)).astype(np.int64)
                bins[far | (bins > last)] = last
                bins += np.arange(len(some))[:, None] * (last + 1)
                counts[i : i + ROWS] = np.bincount(bins.ravel(), minlength=len(some) * (last + 1)).reshape(len(some), -1)[:, :last].cumsum(1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(these) + 1, dtype=np.int32) * last), pa.array(counts.ravel()))
        return pa.table([*[these[c] for c in (*keys, id_col, "x", "y", "z")], lists], names=[*keys, id_col, "x", "y", "z", "in_grid"])

    out = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"{kinds}, in_grid array<long>")
    r = lambda i: (i + 1) * F.lit(float(step))
    share = lambda n, i: n * F.lit(float(h) ** 3) / (F.lit(SPHERE) * r(i) * r(i) * r(i))
    return out.withColumn("p", F.transform("in_grid", lambda n, i: F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), share(n, i)))))


def by_radius(arrays: DataFrame, step: float, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """keys, id, bin, r, in_grid, p: a row for each focus and radius of shares."""
    out = arrays.select(*keys, id_col, F.posexplode(F.arrays_zip("in_grid", "p")).alias("_b", "_s"))
    return out.select(*keys, id_col, (F.col("_b") + 1).alias("bin"), ((F.col("_b") + 1) * F.lit(float(step))).alias("r"), "_s.in_grid", "_s.p")


def factors(foci: DataFrame, window: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """keys, id, bin, r, in_grid, p: shares, with a row for each focus and radius."""
    return by_radius(shares(foci, window, h, step, r_max, keys, id_col), step, keys, id_col)


def monte_carlo_factors(foci: DataFrame, planes: DataFrame, step: float, r_max: float, keys: Sequence[str], samples: int = 384, least: float = 1e-3, seed: int = 0, id_col: str = "id") -> DataFrame:
    """keys, id, bin, r, p: factors within the hull from `samples` seeded offsets in the unit ball, at least `least`.

    All foci take the same offsets, so reruns agree. Foci without planes are left out.
    """
    keys, last = list(keys), int(math.floor(r_max / step + 0.5))
    facets = planes.groupBy(*keys).agg(F.collect_list(F.struct("nx", "ny", "nz", "c")).alias("_facets"))
    known = foci.select(*keys, id_col, "x", "y", "z").dropna(subset=["x", "y", "z"]).join(facets, keys)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.select(*keys, id_col).schema)

    def run(batches):
        rng = np.random.default_rng(seed)
        way = rng.normal(size=(samples, 3))
        ball = way / np.sqrt((way * way).sum(1))[:, None] * np.cbrt(rng.random(samples))[:, None]
        radii = step * np.arange(1, last + 1)
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            shares = []
            for i in range(len(b)):
                f = np.array([list(x.values()) for x in col("_facets")[i].as_py()])
                at = np.array([col(k)[i].as_py() for k in "xyz"])
                slack = (at @ f[:, :3].T + f[:, 3])[None, :]  # of the focus, at each plane
                reach = ball @ f[:, :3].T
                shares.append([max(least, float((slack + r * reach <= 1e-6).all(1).mean())) for r in radii])
            yield pa.RecordBatch.from_arrays([*[col(c) for c in [*keys, id_col]], pa.array(shares, pa.list_(pa.float64()))], names=[*keys, id_col, "_p"])

    out = known.mapInArrow(run, f"{kinds}, _p array<double>").select(*keys, id_col, F.posexplode("_p").alias("_b", "p"))
    return out.select(*keys, id_col, (F.col("_b") + 1).alias("bin"), ((F.col("_b") + 1) * F.lit(float(step))).alias("r"), "p")
