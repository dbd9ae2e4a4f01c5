import numpy as np
import pytest

from pointloom.operators import geometry, windows
from pointloom.plans import analyses

PTS = "zone int, id long, x double, y double, z double"


def cloud(spark, seed, n, zones=2, scale=40.0):
    r = np.random.default_rng(seed)
    rows = [(z, i, *map(float, r.uniform(-scale, scale, 3))) for z in range(zones) for i in range(n)]
    return spark.createDataFrame(rows, PTS), rows


def sheet(spark, height, zones=2):
    rows = [(z, i * 10 + j, i * 9.0 - 40, j * 9.0 - 40, height + 0.37 * i + 0.11 * j * j) for z in range(zones) for i in range(10) for j in range(10)]
    return spark.createDataFrame(rows, PTS), rows


def brute_window(rows, zone, planes, h, pre, post, limit):
    x = np.array([r[2:] for r in rows if r[0] == zone])
    axes = [np.arange(x[:, k].min(), x[:, k].max() + 1e-9, h) for k in range(3)]
    g = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    f = np.array([[p["nx"], p["ny"], p["nz"], p["c"]] for p in planes if p["zone"] == zone])
    g = g[(g @ f[:, :3].T + f[:, 3] <= 1e-6).all(1)]
    v = []
    for s in (pre, post):
        c = np.array([r[2:] for r in s if r[0] == zone])
        d = np.sqrt(((g[:, None] - c[None]) ** 2).sum(-1))
        v.append((c[d.argmin(1)] - g, d.min(1)))
    return g[((v[0][0] * v[1][0]).sum(1) < 0) & (np.minimum(v[0][1], v[1][1]) <= limit)]


@pytest.fixture(scope="module")
def setting(spark):
    pts, rows = cloud(spark, 1, 60)
    (pre, pre_rows), (post, post_rows) = sheet(spark, -12.0), sheet(spark, 14.0)
    planes, tiles, volume = analyses.window_of(pts, 3.0, ["zone"], pre, post, 18.0)
    got = planes.collect()
    lattices = [brute_window(rows, z, got, 3.0, pre_rows, post_rows, 18.0) for z in (0, 1)]
    return pts, rows, planes, tiles, volume, lattices


def test_volume_and_factors(spark, setting):
    pts, rows, planes, tiles, volume, lattices = setting
    assert {r["zone"]: r["volume"] for r in volume.collect()} == {z: len(g) * 27.0 for z, g in enumerate(lattices)}
    for r in windows.factors(pts, tiles, 3.0, 4.0, 24.0, ["zone"]).collect():
        d = np.sqrt(((lattices[r["zone"]] - np.array(rows[r["zone"] * 60 + r["id"]][2:])) ** 2).sum(1))
        c = (d < r["r"]).sum()
        assert r["in_grid"] == c and r["p"] == pytest.approx(min(1.0, c * 27 / (4 / 3 * np.pi * r["r"] ** 3)) if c else 1.0)


def test_null_and_strange_keys(spark, setting):
    tiles = setting[3]
    foci = spark.createDataFrame([(0, 1, None, 0.0, 0.0), (9, 2, 0.0, 0.0, 0.0), (0, 3, 1e6, 0.0, float("nan"))], PTS)
    got = {(r["id"], r["p"]) for r in windows.factors(foci, tiles, 3.0, 4.0, 8.0, ["zone"]).collect()}
    assert got == {(1, 1.0), (3, 1.0)}
    flat = spark.createDataFrame([(0, i, float(i), float(i * i), 0.0) for i in range(9)], PTS)
    assert analyses.window_of(flat, 1.0, ["zone"])[1].count() == 0
    assert analyses.window_of(flat.limit(0), 1.0, ["zone"])[1].count() == 0


def test_nearest_by_halves():
    r = np.random.default_rng(3)
    p, c = r.normal(size=(700, 3)) * 20, r.normal(size=(900, 3)) * 30
    assert (windows.nearest_of(p, c) == ((p[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all()


def test_monte_carlo_agrees_with_the_grid(spark):
    pts, _ = cloud(spark, 2, 80, 1)
    planes, tiles, _ = analyses.window_of(pts, 1.5, ["zone"])
    on = ["zone", "id", "bin"]
    sampled = windows.monte_carlo_factors(pts, planes, 6.0, 30.0, ["zone"])
    both = sampled.withColumnRenamed("p", "q").join(windows.factors(pts, tiles, 1.5, 6.0, 30.0, ["zone"]), on).collect()
    assert len(both) == 80 * 5
    assert max(abs(r["p"] - r["q"]) for r in both if r["bin"] > 1) < 4 * 0.5 / 384**0.5 + 0.05
    assert sorted(map(tuple, sampled.collect())) == sorted(map(tuple, windows.monte_carlo_factors(pts, planes, 6.0, 30.0, ["zone"]).collect()))


def test_points_outside_are_dropped_in_both_kinds(spark, setting):
    pts, rows, planes, tiles, _, _ = setting
    far = spark.createDataFrame([(z, 1000 + z, 500.0, 500.0, 500.0) for z in (0, 1)], PTS)
    a, b = pts.filter("id % 2 = 0"), pts.filter("id % 2 = 1")
    args = (planes, tiles, 3.0, 4.0, 24.0, ["zone"])
    key = lambda df: sorted((r["zone"], r["family"], r["r"], r["value"] is None, round(r["value"] or 0, 6)) for r in df.collect())
    assert key(analyses.families_in_window(a, b, *args)) == key(analyses.families_in_window(a.unionByName(far), b.unionByName(far), *args))
    alone = far.unionByName(b.filter("zone = 0"))
    assert {r["zone"] for r in analyses.families_in_window(a, alone, *args).select("zone").distinct().collect()} == {0}


def test_two_kinds_nulls_use_the_window(spark, setting):
    pts, rows, planes, tiles, volume, _ = setting
    kinds = pts.withColumn("kind", (pts["id"] % 2).cast("int"))
    curve, tests = analyses.two_kinds_in_window(kinds, planes, tiles, 3.0, 6.0, 24.0, 20, least=20)
    seen = {(r["zone"], r["curve"], r["r"]): r["k"] for r in curve.filter("rep = -1 and `null` = 'labels'").collect()}
    whole = analyses.families_in_window(kinds.filter("kind = 0"), kinds.filter("kind = 1"), planes, tiles, 3.0, 6.0, 24.0, ["zone"])
    for r in whole.filter("family in ('k12', 'k21', 'k_combined')").collect():
        assert seen[(r["zone"], r["family"].lstrip("k").strip("_"), r["r"])] == pytest.approx(r["value"])
    assert {r["null"] for r in tests.collect()} == {"labels", "segregated"}


def test_fusion_sites_in_both_directions(spark, setting):
    pts, rows, planes, tiles, volume, _ = setting
    sites, particles = pts.filter("id % 3 = 0"), pts.filter("id % 3 > 0")
    curve, tests = analyses.fusion_sites_in_window(sites.filter("z > 0"), sites.filter("z <= 0"), particles, pts, planes, tiles, 3.0, 6.0, 24.0, replicates=6, shift=10.0, least=6, snap_limit=30.0)
    kinds = {(r["comparison"], r["family"]) for r in curve.select("comparison", "family").distinct().collect()}
    assert len(kinds) == 4 * 9
    one = analyses.families_in_window(sites.filter("z > 0"), particles, planes, tiles, 3.0, 6.0, 24.0, ["zone"], drop_a=False)
    want = {(r["zone"], r["family"], r["r"]): r["value"] for r in one.collect()}
    for r in curve.filter("comparison = 'observed'").collect():
        assert r["value"] == pytest.approx(want[(r["zone"], r["family"], r["r"])], abs=1e-9) if r["value"] is not None else want[(r["zone"], r["family"], r["r"])] is None
    got = {(r["null"], r["curve"]) for r in tests.collect()}
    assert got == {(n, f"l{s}") for n in ("shift", "labels") for s in ("12", "21", "_combined")}


def test_hull_with_facets_in_one_row(spark):
    pts, rows = cloud(spark, 5, 30, 1)
    planes = geometry.hull_planes(pts.select("zone", "x", "y", "z"), ["zone"])
    assert windows.members(pts, planes, ["zone"]).count() == 30
    out = spark.createDataFrame([(0, 1, 41.0, 0.0, 0.0), (0, 2, None, 0.0, 0.0), (7, 3, 0.0, 0.0, 0.0)], PTS)
    assert windows.members(out, planes, ["zone"]).count() == 0


def test_pair_sums_have_no_row_for_a_pair(spark, monkeypatch):
    from pyspark.sql import functions as F

    from pointloom.operators import ripley

    monkeypatch.setattr(ripley, "CHUNK", 40)  # many chunks
    r = np.random.default_rng(3)
    a = [(z, s, i, *map(float, r.uniform(-30, 30, 3)), [1.0 + i % 3, 2.0, 0.5, 1.0 + i % 2]) for z in range(2) for s in (4, 9) for i in range(90)]
    b = [(z, i, *map(float, r.uniform(-30, 30, 3)), [1.0, 1.0 + i % 5, 3.0, 0.25]) for z in range(2) for i in range(150)]
    a += [(0, 4, 900, None, 0.0, 0.0, [1.0] * 4), (0, 4, 901, float("nan"), 0.0, 0.0, [1.0] * 4)] + [a[0]] * 3
    one = spark.createDataFrame(a, "zone int, part long, id long, x double, y double, z double, w array<double>")
    two = spark.createDataFrame(b, "zone int, id long, x double, y double, z double, w array<double>")
    got = {(x["zone"], x["part"], x["bin"]): (x["w12"], x["w21"]) for x in ripley.pair_sums(one, two, 5.0, 20.0, ["zone"], "part").collect()}
    want = {}
    for z in range(2):
        q = [x for x in b if x[0] == z]
        at, w2 = np.array([x[2:5] for x in q]), np.array([x[5] for x in q])
        for s in (4, 9):
            p = [x for x in a if x[:2] == (z, s) and x[3] is not None and x[3] == x[3]]
            near = np.sqrt(((np.array([x[3:6] for x in p])[:, None] - at[None]) ** 2).sum(-1))
            for k in range(4):
                hit = near < 5.0 * (k + 1)
                if hit.any():
                    want[z, s, k + 1] = (float((hit.sum(1) * np.array([x[6][k] for x in p])).sum()), float((hit.sum(0) * w2[:, k]).sum()))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    all_ = ripley.pair_sums(one, two.filter("zone = 1"), 5.0, 20.0, ["zone"]).agg(F.count(F.lit(1)), F.min("zone")).first()
    assert tuple(all_) == (4, 1) and ripley.pair_sums(one.limit(0), two, 5.0, 20.0, ["zone"], "part").count() == 0
