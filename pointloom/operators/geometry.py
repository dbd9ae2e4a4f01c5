"""Geometry that needs a whole small point set at once: hulls, triangulation, fits, frames.

Each function takes a table and key columns; a group is one surface, cluster
or vesicle. Groups run in numpy, one Arrow table at a time; everything around
them stays relational. Hulls and spans see the corners of what each task has
read, frames one matrix for each key, so those take keys of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite


def _per_group(df: DataFrame, keys: Sequence[str], added: str, fn: Callable[[pd.DataFrame], list[tuple]]) -> DataFrame:
    """fn gives the added columns of each output row of a group."""
    new = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if f.name in keys]
    schema = T.StructType(kept + new.fields)
    names = [f.name for f in new.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fn(pdf)
        out = pd.DataFrame(rows, columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iloc[0]] * len(out))
        return out

    if keys:  # small rows, long work: a key of its own task, as far as partitions go
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return df.groupBy(*keys).applyInPandas(run, T.StructType([*[next(f for f in kept if f.name == k) for k in keys], *new.fields]) if keys else schema)


def _xyz(pdf: pd.DataFrame) -> np.ndarray:
    x = pdf[["x", "y", "z"]].to_numpy(float)
    return x[np.isfinite(x).all(1)]


# hulls
def hull_facets(points: np.ndarray) -> np.ndarray:
    """Triangles (rows of point numbers, outward) of the convex hull; none for flat or fewer than four points."""
    p = np.asarray(points, float)
    n = len(p)
    if n < 4:
        return np.zeros((0, 3), int)
    scale = max(1e-12, float(np.ptp(p, axis=0).max()))
    eps = 1e-10 * scale
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(((p - p[a]) ** 2).sum(1)))
    ab = p[b] - p[a]
    off = np.linalg.norm(np.cross(p - p[a], ab), axis=1)
    c = int(np.argmax(off))
    normal = np.cross(ab, p[c] - p[a])
    height = (p - p[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if off[c] <= eps * scale or abs(height[d]) <= eps * scale * scale:
        return np.zeros((0, 3), int)
    centre = p[[a, b, c, d]].mean(0)

    def plane(f: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        m = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        m = m / max(np.linalg.norm(m), 1e-300)
        return m, float(-m @ p[f[0]])

    faces: dict[tuple[int, int, int], tuple[np.ndarray, float, np.ndarray]] = {}
    edge_face: dict[tuple[int, int], tuple[int, int, int]] = {}

    def add(f: tuple[int, int, int], candidates: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
        m, o = plane(f)
        if m @ centre + o > 0:
            f = (f[0], f[2], f[1])
            m, o = -m, -o
        h = p[candidates] @ m + o if len(candidates) else np.zeros(0)
        mine = candidates[h > eps]
        faces[f] = (m, o, mine)
        for i in range(3):
            edge_face[(f[i], f[(i + 1) % 3])] = f
        return candidates[h <= eps], f

    rest = np.setdiff1d(np.arange(n), [a, b, c, d])
    for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        rest, _ = add(f, rest)
    work = [f for f in faces if len(faces[f][2])]
    while work:
        f = work.pop()
        if f not in faces or not len(faces[f][2]):
            continue
        m, o, mine = faces[f]
        tip = int(mine[np.argmax(p[mine] @ m + o)])
        seen, stack, rim = {f}, [f], []
        while stack:
            g = stack.pop()
            for i in range(3):
                e = (g[(i + 1) % 3], g[i])
                other = edge_face[e]
                if other in seen:
                    continue
                if faces[other][0] @ p[tip] + faces[other][1] > eps:
                    seen.add(other)
                    stack.append(other)
                else:
                    rim.append((e[1], e[0]))
        pool = np.unique(np.concatenate([faces[g][2] for g in seen]))
        pool = pool[pool != tip]
        for g in seen:
            del faces[g]
            for i in range(3):
                e = (g[i], g[(i + 1) % 3])
                if edge_face.get(e) == g:
                    del edge_face[e]
        for u, v in rim:
            pool, new = add((u, v, tip), pool)
            if len(faces[new][2]):
                work.append(new)
    return np.array(list(faces), int).reshape(-1, 3)


def hull_measures(points: np.ndarray) -> tuple[float, float]:
    """Surface area and volume."""
    f = hull_facets(points)
    if not len(f):
        return 0.0, 0.0
    p = points - points.mean(0)
    a, b, c = p[f[:, 0]], p[f[:, 1]], p[f[:, 2]]
    n = np.cross(b - a, c - a)
    return float(0.5 * np.linalg.norm(n, axis=1).sum()), float(np.einsum("ij,ij->i", a, n).sum() / 6.0)


def _finite_points(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    at = {k: finite(k) for k in "xyz"}
    return df.select(*keys, *[c.alias(k) for k, c in at.items()]).dropna(subset=list("xyz"))


#: Points of a key that are held before they are reduced, and points held by a task.
HELD, HELD_ALL = 20_000, 400_000


def corners(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, y, z, m: points that have the hull of each key's finite points; m sums to their number.

    Every task keeps only the corners of what it has read, where it read it,
    so the groups that follow are small however many points a key has. The
    distinct points of a flat set all stay.
    """
    slim, keys = _finite_points(df, keys), list(keys)

    def reduced(x: np.ndarray) -> np.ndarray:
        f = hull_facets(x)
        return x[np.unique(f)] if len(f) else np.unique(x, axis=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, int]] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for key, (x, n) in held.items():
                v = reduced(x)
                out = pd.DataFrame(v, columns=list("xyz")).assign(m=[n, *[0] * (len(v) - 1)])
                for i, k in enumerate(keys):
                    out.insert(i, k, [None if key[i] != key[i] else key[i]] * len(out))
                yield out

        for b in batches:
            for key, part in b.groupby(keys, dropna=False, sort=False) if keys else [((), b)]:
                key = tuple(key) if isinstance(key, (tuple, list)) else (key,)
                x, n = held.get(key, (np.zeros((0, 3)), 0))
                x, n = np.concatenate([x, part[["x", "y", "z"]].to_numpy(float)]), n + len(part)
                held[key] = (reduced(x) if len(x) > HELD else x, n)
            if sum(len(x) for x, _ in held.values()) > HELD_ALL:
                yield from rows()
                held.clear()
        yield from rows()

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*keys).schema]
    return slim.mapInPandas(run, ", ".join([*kinds, "x double", "y double", "z double", "m long"]))


def hull_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_points, area (half the hull's surface), volume; 0 with fewer than four points or a flat set. Keys without a finite point are left out."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        area, volume = hull_measures(_xyz(pdf))
        return [(int(pdf["m"].sum()), 0.5 * area, volume)]

    return _per_group(corners(df, keys), keys, "n_points long, area double, volume double", fn)


def hull_planes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, nx, ny, nz, c of every facet: n . p + c <= 0 inside."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        x = _xyz(pdf)
        f = hull_facets(x)
        a, b, c = x[f[:, 0]], x[f[:, 1]], x[f[:, 2]]
        n = np.cross(b - a, c - a)
        n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        return [(*map(float, m), float(-m @ p)) for m, p in zip(n, a, strict=True)]

    return _per_group(corners(df, keys), keys, "nx double, ny double, nz double, c double", fn)


def spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, span: greatest distance between two points, from hull corners; 0 with fewer than two. Keys without a finite point are left out."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        x = _xyz(pdf)
        f = hull_facets(x)
        v = x[np.unique(f)] if len(f) else x
        best = 0.0
        for i in range(0, len(v), 512):
            best = max(best, float(np.sqrt(((v[i : i + 512, None] - v[None]) ** 2).sum(-1)).max()))
        return [(best,)]

    return _per_group(corners(df, keys), keys, "span double", fn)


def mesh_area(vertices: DataFrame, faces: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """Sum of triangle areas, by joins alone."""
    out = faces
    for i in range(3):
        out = out.join(vertices.select(*keys, F.col(id_col).alias(f"v{i}"), *[F.col(k).alias(f"{k}{i}") for k in "xyz"]), [*keys, f"v{i}"])
    u = [F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"]
    v = [F.col(f"{k}2") - F.col(f"{k}0") for k in "xyz"]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return out.groupBy(*keys).agg(F.sum(0.5 * F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])).alias("area"))


# spheres
def fit_sphere(x: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Centre and radius that minimise the squares of (distance - radius); centroid and mean radius below four points."""
    c = x.mean(0)
    r = float(np.linalg.norm(x - c, axis=1).mean())
    if len(x) < 4:
        return c, r
    a = np.hstack([2 * (x - c), np.ones((len(x), 1))])
    sol = np.linalg.lstsq(a, ((x - c) ** 2).sum(1), rcond=None)[0]
    start = c + sol[:3]
    r0 = float(np.sqrt(max(sol[3] + sol[:3] @ sol[:3], 0.0)))
    if np.isfinite(start).all() and r0 > 0:
        c, r = start, r0
    for _ in range(steps):
        d = x - c
        n = np.maximum(np.linalg.norm(d, axis=1), 1e-12)
        j = np.hstack([-d / n[:, None], -np.ones((len(x), 1))])
        s = np.linalg.lstsq(j, -(n - r), rcond=None)[0]
        c, r = c + s[:3], r + float(s[3])
        if np.abs(s).max() < 1e-10:
            break
    return c, r


def sphere_fits(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_points, cx, cy, cz, radius, diameter, volume, sphericity, error; groups below three points are left out.

    Sphericity is that of the convex hull, 0 below four points. A group that
    fails has its message in error and nulls elsewhere.
    """

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        x = _xyz(pdf)
        if len(x) < 3:
            return []
        try:
            c, r = fit_sphere(x)
            area, volume = hull_measures(x)
            round_ = np.pi ** (1 / 3) * (6 * volume) ** (2 / 3) / area if area > 0 else 0.0
            return [(len(x), *map(float, c), r, 2 * r, 4 / 3 * np.pi * r**3, float(round_), None)]
        except (np.linalg.LinAlgError, ValueError, KeyError) as e:
            return [(len(x), *[None] * 7, str(e))]

    return _per_group(df, keys, "n_points long, cx double, cy double, cz double, radius double, diameter double, volume double, sphericity double, error string", fn)


# sampling and frames
def farthest_points(df: DataFrame, keys: Sequence[str], step: int, id_col: str = "id") -> DataFrame:
    """keys, order, id: greedy farthest-point order from the least id; max(1, n div step) points, ties to the least id."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values(id_col)
        x, ids = pdf[["x", "y", "z"]].to_numpy(float), pdf[id_col].to_numpy()
        n = max(1, len(x) // step)
        d, out, at = np.full(len(x), np.inf), [], 0
        for i in range(n):
            out.append((i, int(ids[at])))
            d = np.minimum(d, ((x - x[at]) ** 2).sum(1))
            at = int(np.argmax(d))
        return out

    return _per_group(df, keys, "order int, id long", fn)


def principal_frames(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, centre and the principal axes (greatest variance first, right-handed, first nonzero component positive).

    Means and covariances are sums in Spark; only one row for each key, with
    its 3 x 3 matrix, goes to numpy. Points with a coordinate that is not
    finite do not count.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = _finite_points(df, keys).groupBy(*keys).agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"], *[F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in pairs])
    names = [f"{a}{k}" for a in "uvw" for k in "xyz"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys, "cx", "cy", "cz").schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.empty((len(pdf), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = pdf[f"_{a}{b}"]
            axes = np.linalg.eigh(m)[1].transpose(0, 2, 1)[:, ::-1].copy()
            for i in range(2):
                lead = np.take_along_axis(axes[:, i], np.argmax(np.abs(axes[:, i]) > 1e-12, axis=1)[:, None], 1)
                axes[:, i] *= np.where(lead >= 0, 1.0, -1.0)
            axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
            out = pdf[[*keys, "cx", "cy", "cz"]].copy()
            out[names] = axes.reshape(len(pdf), 9)
            yield out

    return sums.mapInPandas(run, ", ".join([*kinds, *[f"{n} double" for n in names]]))


def centre_between(df: DataFrame, keys: Sequence[str], side: str = "side", rounds: int = 5, tolerance: float = 1e-3) -> DataFrame:
    """keys, x, y, z: fixed point of the midpoint of the nearest pre and post points, from the midpoint of centroids."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        pre, post = (pdf[pdf[side] == s][["x", "y", "z"]].to_numpy(float) for s in ("pre", "post"))
        if not len(pre) or not len(post):
            return []
        c = (pre.mean(0) + post.mean(0)) / 2
        for _ in range(rounds):
            a, b = (s[np.argmin(((s - c) ** 2).sum(1))] for s in (pre, post))
            new = (a + b) / 2
            if np.linalg.norm(new - c) < tolerance:
                c = new
                break
            c = new
        return [tuple(map(float, c))]

    return _per_group(df, keys, "x double, y double, z double", fn)


# triangulation and outlines in a plane
def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles of a planar set, as the lower hull of its lift to a paraboloid."""
    p = np.asarray(p, float)
    if len(p) < 3:
        return np.zeros((0, 3), int)
    q = p - p.mean(0)
    q = q / max(1e-12, float(np.abs(q).max()))
    lifted = np.column_stack([q, (q**2).sum(1)])
    top = np.array([[0.0, 0.0, 50.0]])  # far above: its facets are the upper hull
    f = hull_facets(np.vstack([lifted, top]))
    if not len(f):
        return f
    f = f[(f != len(p)).all(1)]
    a, b, c = lifted[f[:, 0]], lifted[f[:, 1]], lifted[f[:, 2]]
    down = np.cross(b - a, c - a)[:, 2] < -1e-14
    return f[down]


def circumradius(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    la, lb, lc = (np.linalg.norm(u - v, axis=1) for u, v in ((b, c), (a, c), (a, b)))
    area = 0.5 * np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))
    return la * lb * lc / np.maximum(4 * area, 1e-300)


def boundary(t: np.ndarray) -> list[tuple[int, int]]:
    """Edges that one triangle uses."""
    n: dict[tuple[int, int], int] = {}
    for tri in t.tolist():
        for i in range(3):
            e = tuple(sorted((tri[i], tri[(i + 1) % 3])))
            n[e] = n.get(e, 0) + 1
    return sorted(e for e, k in n.items() if k == 1)


def to_plane(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2]
    return c @ axes[:2].T


def neighbour_gaps(p: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest other one.

    Points are halved along their longer side; each half goes on with the
    rows that can still be nearest to one of its points: two rows are as near
    to the centre as the second nearest, and one of them is another point.
    """
    out = np.full(len(p), np.inf)
    todo = [(np.arange(len(p)), np.arange(len(p)))] if len(p) > 1 else []
    while todo:
        mine, rows = todo.pop()
        q, c = p[mine], p[rows]
        low, high = q.min(0), q.max(0)
        if len(mine) <= 16 or len(rows) <= 64 or (low == high).all():
            for i in range(0, len(mine), 512):
                d = ((q[i : i + 512, None] - c[None]) ** 2).sum(-1)
                d[mine[i : i + 512, None] == rows[None]] = np.inf
                out[mine[i : i + 512]] = np.sqrt(d.min(1))
            continue
        axis, centre = int((high - low).argmax()), (low + high) / 2
        d = np.sqrt(((c - centre) ** 2).sum(1))
        kept = rows[d <= (np.partition(d, 1)[1] + np.sqrt(((high - low) ** 2).sum())) * (1 + 1e-9) + 1e-9]
        upper = q[:, axis] > centre[axis]
        todo += [(m, kept) for m in (mine[~upper], mine[upper]) if len(m)]
    return out


def alpha_triangles(p: np.ndarray, factor: float = 2.5, local: bool = False, growth: float = 1.5, limit: float = 25.0) -> np.ndarray:
    """Triangles under an alpha that grows until they cover all points; the whole triangulation if none does.

    Global: circumradius < factor * median neighbour gap. Local: circumradius
    <= factor * mean gap of the triangle's corners.
    """
    t = delaunay(p)
    if not len(t):
        return t
    gaps, r = neighbour_gaps(p), circumradius(p, t)
    base = gaps[t].mean(1) if local else np.full(len(t), np.median(gaps))
    scale = factor
    while scale <= factor * limit:
        kept = t[r <= scale * base] if local else t[r < scale * base]
        if len(np.unique(kept)) == len(p):
            return kept
        scale *= growth
    return t


def alpha_edges(df: DataFrame, keys: Sequence[str], factor: float = 2.5, local: bool = False, id_col: str = "id") -> DataFrame:
    """keys, a, b: ids of the boundary edges of each group's concave outline in its best plane."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values(id_col)
        ids = pdf[id_col].to_numpy()
        if len(pdf) < 3:
            return []
        t = alpha_triangles(to_plane(pdf[["x", "y", "z"]].to_numpy(float)), factor, local)
        return [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for i, j in boundary(t)]

    return _per_group(df, keys, "a long, b long", fn)


def loops_of(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Boundary edges as closed loops: each begins at its least node and goes on to its lesser neighbour; an edge is used once."""
    near: dict[int, list[int]] = {}
    for i, j in edges:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    left = {frozenset(e) for e in edges}
    out = []
    for start in sorted(near):
        while any(frozenset((start, j)) in left for j in near[start]):
            loop, at = [start], start
            while True:
                step = next((j for j in sorted(near[at]) if frozenset((at, j)) in left), None)
                if step is None:
                    break
                left.discard(frozenset((at, step)))
                if step == start:
                    break
                loop.append(step)
                at = step
            out.append(loop)
    return out


def alpha_polygons(df: DataFrame, keys: Sequence[str], factor: float = 2.5, local: bool = False, id_col: str = "id") -> DataFrame:
    """keys, loop, order, id: the concave outline of each group as ordered loops of points, in its best plane."""

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values(id_col)
        ids = pdf[id_col].to_numpy()
        if len(pdf) < 3:
            return []
        t = alpha_triangles(to_plane(pdf[["x", "y", "z"]].to_numpy(float)), factor, local)
        return [(i, k, int(ids[v])) for i, loop in enumerate(loops_of(boundary(t))) for k, v in enumerate(loop)]

    return _per_group(df, keys, "loop int, order int, id long", fn)


def inside_loops(x: np.ndarray, loops: list[np.ndarray]) -> np.ndarray:
    """Which of the points lie in any of the loops, each by its own crossings; a loop in a loop is no hole."""
    out = np.zeros(len(x), bool)
    order = np.argsort(x[:, 1], kind="stable")  # an edge meets a run of the points by y
    px, py = x[order, 0], x[order, 1]
    for a in loops:
        b, odd = np.roll(a, -1, 0), np.zeros(len(x), bool)
        first, last = np.searchsorted(py, np.minimum(a[:, 1], b[:, 1])), np.searchsorted(py, np.maximum(a[:, 1], b[:, 1]))
        for u, v, i, j in zip(a, b, first.tolist(), last.tolist(), strict=True):
            if i < j:
                odd[i:j] ^= px[i:j] < u[0] + (py[i:j] - u[1]) * (v[0] - u[0]) / (v[1] - u[1])
        out[order] |= odd
    return out


def adaptive_loops(p: np.ndarray, factor: float = 2.5, growth: float = 1.5, rounds: int = 25) -> list[np.ndarray]:
    """Outline of a planar set by a local alpha, grown until all points lie on it or in it; else the convex outline.

    A triangle counts if its circumradius is at most factor times the mean
    gap of its corners to their nearest points. No loops with fewer than three
    points or with all on a line.
    """
    t = delaunay(p)
    if not len(t):
        return []
    base, r = neighbour_gaps(p)[t].mean(1), circumradius(p, t)
    for n in range(rounds):
        kept = t[r <= factor * growth**n * base]
        loops = [p[loop] for loop in loops_of(boundary(kept))]
        rest = np.setdiff1d(np.arange(len(p)), kept)
        if loops and inside_loops(p[rest], loops).all():
            return loops
    return [p[loop] for loop in loops_of(boundary(t))]


def _slices(a: np.ndarray, b: np.ndarray, y: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest x on the line at y within margin of each segment from a to b; least > greatest if none is.

    What lies within margin is two discs and the band between them, and
    convex, so its slice is what the slices of the three span.
    """
    low, high = np.full(len(a), np.inf), np.full(len(a), -np.inf)
    for c in (a, b):
        h = margin**2 - (y - c[:, 1]) ** 2
        w = np.sqrt(np.maximum(h, 0))
        low, high = np.where(h >= 0, np.minimum(low, c[:, 0] - w), low), np.where(h >= 0, np.maximum(high, c[:, 0] + w), high)
    length = np.linalg.norm(b - a, axis=1)
    u = (b - a) / np.where(length > 0, length, 1.0)[:, None]
    from_, to = np.full(len(a), -np.inf), np.full(len(a), np.inf)
    # along the segment in 0..length, across it in -margin..margin: both linear in x
    for slope, at, least, most in ((u[:, 0], (y - a[:, 1]) * u[:, 1], 0.0, length), (u[:, 1], -(y - a[:, 1]) * u[:, 0], -margin, margin)):
        flat = np.abs(slope) < 1e-12
        k = np.where(flat, 1.0, slope)
        p, q = (least - at) / k, (most - at) / k
        never = flat & ((at < least) | (at > most))
        from_ = np.where(never, np.inf, np.where(flat, from_, np.maximum(from_, a[:, 0] + np.minimum(p, q))))
        to = np.where(never, -np.inf, np.where(flat, to, np.minimum(to, a[:, 0] + np.maximum(p, q))))
    band = (length > 0) & (from_ <= to)
    return np.where(band, np.minimum(low, from_), low), np.where(band, np.maximum(high, to), high)


def grown_area(p: np.ndarray, loops: list[np.ndarray], margin: float, pixel: float) -> float:
    """Area of the pixels in a loop or within margin of one, or within margin of a point if there are no loops.

    Row by row: a segment's margin and a loop's inside are runs of pixels, so
    a row costs its segments and its pixels, not their product.
    """
    lo, hi = p.min(0) - margin - pixel, p.max(0) + margin + pixel
    nx, ny = (int((h - k) / pixel) + 1 for h, k in zip(hi, lo, strict=True))
    a = np.vstack(loops) if loops else p
    b = np.vstack([np.roll(x, -1, 0) for x in loops]) if loops else p
    of = np.repeat(np.arange(len(loops)), [len(x) for x in loops]) if loops else np.zeros(0, int)
    total = 0
    for y in lo[1] + pixel * np.arange(ny):
        low, high = _slices(a, b, y, margin)
        if loops:
            cut = np.flatnonzero((a[:, 1] <= y) != (b[:, 1] <= y))
            x = a[cut, 0] + (y - a[cut, 1]) * (b[cut, 0] - a[cut, 0]) / (b[cut, 1] - a[cut, 1])
            x = x[np.lexsort((x, of[cut]))]  # a loop crosses a line an even number of times
            low, high = np.concatenate([low, x[::2]]), np.concatenate([high, x[1::2]])
        live = low <= high
        first = np.maximum(np.ceil((low[live] - lo[0]) / pixel), 0).astype(int)
        last = np.minimum(np.floor((high[live] - lo[0]) / pixel), nx - 1).astype(int)
        some = first <= last
        step = np.bincount(first[some], minlength=nx + 1) - np.bincount(last[some] + 1, minlength=nx + 1)
        total += int((np.cumsum(step)[:nx] > 0).sum())
    return total * pixel * pixel


def dilated_areas(df: DataFrame, keys: Sequence[str], margin: float = 5.0, pixel: float = 1.0, factor: float = 2.5) -> DataFrame:
    """keys, area: raster area of the points' locally adaptive outline in their best plane, grown by margin.

    Holes count as inside. Fewer than three points, or points on a line, give
    a union of discs. Points with a null or infinite coordinate are left out;
    without any other the area is null. The triangulation holds a whole group.
    """

    def fn(pdf: pd.DataFrame) -> list[tuple]:
        x = pdf[["x", "y", "z"]].to_numpy(float)
        x = x[np.isfinite(x).all(1)]
        if not len(x):
            return [(None,)]
        p = to_plane(x) if len(x) > 2 else np.column_stack([np.linalg.norm(x - x[0], axis=1), np.zeros(len(x))])
        return [(grown_area(p, adaptive_loops(p, factor), margin, pixel),)]

    return _per_group(df, keys, "area double", fn)


def point_triangle_distances(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances (n) from points (n x 3) to triangles (corners n x 3), row by row."""
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)

    def segment(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        d = v - u
        s = np.clip(dot(p - u, d) / np.maximum(dot(d, d), 1e-300), 0, 1)
        return np.linalg.norm(p - u - s[:, None] * d, axis=1)

    n = np.cross(b - a, c - a)
    nn = dot(n, n)
    inside = nn > 0
    for u, v in ((a, b), (b, c), (c, a)):
        inside &= dot(np.cross(v - u, p - u), n) >= 0
    edge = np.minimum(np.minimum(segment(a, b), segment(b, c)), segment(c, a))
    return np.where(inside, np.abs(dot(p - a, n)) / np.sqrt(np.maximum(nn, 1e-300)), edge)


def nearest_on_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame, keys: Sequence[str], reach: float, id_col: str = "id") -> DataFrame:
    """keys, id, d: distance to the nearest triangle within reach, by a grid join of points and face boxes."""
    tri = faces
    for i in range(3):
        tri = tri.join(vertices.select(*keys, F.col(id_col).alias(f"v{i}"), *[F.col(k).alias(f"{k}{i}") for k in "xyz"]), [*keys, f"v{i}"])
    cells, pts = tri, points.select(*keys, id_col, "x", "y", "z")
    for k in "xyz":
        lo, hi = F.least(f"{k}0", f"{k}1", f"{k}2") - reach, F.greatest(f"{k}0", f"{k}1", f"{k}2") + reach
        cells = cells.withColumn(f"_c{k}", F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach))))
        pts = pts.withColumn(f"_c{k}", F.floor(F.col(k) / reach))
    met = pts.join(cells, [*keys, "_cx", "_cy", "_cz"])
    inputs = ["x", "y", "z", *[f"{k}{i}" for i in range(3) for k in "xyz"]]

    @F.pandas_udf("double")
    def gap(*columns: pd.Series) -> pd.Series:
        m = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(point_triangle_distances(m[:, :3], m[:, 3:6], m[:, 6:9], m[:, 9:12]))

    d = met.select(*keys, id_col, gap(*inputs).alias("d")).filter(F.col("d") <= reach)
    return d.groupBy(*keys, id_col).agg(F.min("d").alias("d"))
