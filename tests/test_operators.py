import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import names, numeric
from pointloom.operators import clusters, geometry, pairing, ripley, spatial
from pointloom.sinks import tables as sinks


def frame(spark, x, **extra):
    cols = ["id", "x", "y", "z", *extra]
    rows = [(i, *map(float, p), *[v[i] for v in extra.values()]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, cols)


def test_nearest_doubles_its_cells(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 1000, (60, 3)), rng.uniform(0, 1000, (40, 3))
    got = {r["a_id"]: (r["b_id"], r["d"]) for r in spatial.nearest(frame(spark, a), frame(spark, b), cell=5.0).collect()}
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(d.argmin(1).tolist()))


def test_both_ways_of_nearest_agree(spark):
    rng = np.random.default_rng(3)
    clouds = [
        (np.zeros((1, 3)), np.array([[-100.0, 0, 0], [-99.0, 0, 0]])), (rng.normal(-500, 3, (30, 3)), rng.normal(400, 5, (20, 3))), (rng.uniform(-9, 0, (30, 3)), rng.uniform(-9, 0, (30, 3))),
        (np.c_[rng.uniform(0, 50, (25, 2)), np.zeros(25)], np.c_[rng.uniform(0, 50, (25, 2)), np.zeros(25)]),
    ]
    for a, b in clouds:
        left = frame(spark, a).union(spark.createDataFrame([(999, None, 0.0, 0.0)], "id long, x double, y double, z double"))
        rows = lambda **how: sorted((r["a_id"], r["b_id"], round(r["d"], 9)) for r in spatial.nearest(left, frame(spark, b), **how).collect())  # noqa: B023, E731
        direct = rows()
        assert rows(cell=5.0) == direct and len(direct) == len(a)
    assert spatial.nearest(frame(spark, clouds[2][0]), left.filter("x is null"), cell=2.0).count() == 0


def test_within_needs_no_nested_loop(spark):
    p = frame(spark, np.zeros((3, 3)))
    plan = spatial.within(p, p, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_null_points_meet_nothing(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, 0.0, 0.0)], "id long, x double, y double, z double")
    assert spatial.within(p, p, 1.0).count() == 1


def test_components_on_a_long_chain(spark):
    p = frame(spark, [(i * 2.0, 0, 0) for i in range(40)] + [(500.0, 0, 0)])
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(p, 3.0).collect()}
    assert {got[i] for i in range(40)} == {1} and got[40] == -1


def test_core_points(spark):
    p = frame(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3.5, 0, 0), (50, 0, 0)])
    got = {r["id"]: r["cluster"] for r in clusters.dbscan(p, 1.5, min_samples=3, min_size=1).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: -1} or got == {0: 1, 1: 1, 2: 1, 3: -1, 4: -1}


def test_cube_hull(spark):
    cube = [(x, y, z) for x in (0, 2) for y in (0, 2) for z in (0, 2)] + [(1, 1, 1)]
    r = geometry.hull_stats(frame(spark, cube, zone=[0] * 9), ["zone"]).first()
    assert r["area"] == pytest.approx(12.0) and r["volume"] == pytest.approx(8.0)


def test_hull_holds_its_points():
    rng = np.random.default_rng(0)
    for n in (4, 10, 200):
        p = rng.normal(size=(n, 3))
        f = geometry.hull_facets(p)
        a, b, c = p[f[:, 0]], p[f[:, 1]], p[f[:, 2]]
        m = np.cross(b - a, c - a)
        assert ((p @ m.T - (a * m).sum(1)) <= 1e-9).all()
        assert len(f) == 2 * len(np.unique(f)) - 4


def test_delaunay_is_empty_circle():
    p = np.random.default_rng(3).normal(size=(40, 2))
    t = geometry.delaunay(p)
    r = geometry.circumradius(p, t)
    for tri, rad in zip(t, r, strict=True):
        a = np.array([[2 * (p[tri[1]] - p[tri[0]])], [2 * (p[tri[2]] - p[tri[0]])]]).reshape(2, 2)
        c = np.linalg.solve(a, [(p[tri[1]] ** 2).sum() - (p[tri[0]] ** 2).sum(), (p[tri[2]] ** 2).sum() - (p[tri[0]] ** 2).sum()])
        assert (np.linalg.norm(p - c, axis=1) >= rad - 1e-7).all()


def test_sphere_fit():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(300, 3))
    x = np.array([3.0, -2.0, 7.0]) + 20 * u / np.linalg.norm(u, axis=1, keepdims=True)
    c, r = geometry.fit_sphere(x)
    assert c == pytest.approx([3, -2, 7], abs=1e-6) and r == pytest.approx(20, abs=1e-6)


def test_l_inverts_k(spark):
    df = spark.createDataFrame([(1.0, 5.0), (10.0, 4000.0)], "r double, k double")
    back = ripley.k_of_l(ripley.l_of_k(F.col("k"), F.col("r")), F.col("r"))
    assert all(abs(x["b"] - x["k"]) < 1e-6 for x in df.withColumn("b", back).collect())


def test_euler_angles_turn_back():
    rng = np.random.default_rng(2)
    for _ in range(20):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q *= np.sign(np.linalg.det(q))
        a, b, c = np.radians(pairing.zyz_angles(q[None])[0])
        z = lambda t: np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
        y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
        assert np.allclose(z(a) @ y @ z(c), q, atol=1e-9)


def test_independent_set_is_greatest():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 12))
        edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        best = max(sum(1 for _ in s) for k in range(n + 1) for s in itertools.combinations(range(n), k) if not any(i in s and j in s for i, j in edges))
        got, proved = pairing.independent_set(n, edges)
        assert proved and len(got) == best and not any(i in got and j in got for i, j in edges)


def test_independent_set_of_a_dense_ring_is_found():
    n = 120  # each node meets the next three: one of four can stay
    edges = [(i, (i + k) % n) if i < (i + k) % n else ((i + k) % n, i) for i in range(n) for k in (1, 2, 3)]
    got, proved = pairing.independent_set(n, edges)
    assert proved and len(got) == 30
    rng = np.random.default_rng(5)
    hard = [(i, j) for i in range(60) for j in range(i + 1, 60) if rng.random() < 0.2]
    some, proved = pairing.independent_set(60, hard, most=3)
    assert not proved and not any(i in some and j in some for i, j in hard)


def test_local_search_and_the_bound_of_matchings():
    import itertools

    rng = np.random.default_rng(17)
    for _ in range(40):
        n = int(rng.integers(2, 8))
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.4]
        best = max(k for k in range(n // 2 + 1) if any(len({v for p in s for v in p}) == 2 * k for s in itertools.combinations(pairs, k)))
        ceiling = pairing.most_pairs([p[0] for p in pairs], [p[1] for p in pairs])
        assert best <= ceiling <= n // 2
        edges = [(i, j) for i in range(len(pairs)) for j in range(i + 1, len(pairs)) if set(pairs[i]) & set(pairs[j])]
        got, proved = pairing.independent_set(len(pairs), edges, None, ceiling)
        assert proved and len(got) == best and not any(i in got and j in got for i, j in edges)
    assert pairing.most_pairs([1, 2, 3, 9], [2, 3, 4, 1]) == 2 and pairing.most_pairs([1, 1, 1], [2, 3, 4]) == 1
    n = 200  # a path: every second node
    got, proved = pairing.independent_set(n, [(i, i + 1) for i in range(n - 1)], most=0, ceiling=100)
    assert proved and len(got) == 100


def sites_of(spark, n, size, seed):
    x = np.random.default_rng(seed).uniform(0, size, (n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = [(0, i, j, *map(float, (x[i] + x[j]) / 2)) for i in range(n) for j in range(i + 1, n) if d[i, j] < 6]
    return rows, spark.createDataFrame(rows, "zone int, a long, b long, x double, y double, z double")


def test_matchings_have_no_clash(spark):
    import itertools

    rows, sites = sites_of(spark, 10, 8, 8)
    at = {(r[1], r[2]): np.array(r[3:]) for r in rows}
    fits = lambda s: all(not set(p) & set(q) and np.linalg.norm(at[p] - at[q]) >= 3 for p, q in itertools.combinations(s, 2))
    most = max(k for k in range(len(rows) + 1) if k <= 7 and any(fits(s) for s in itertools.combinations(sorted(at), k)))
    exact = pairing.exact_matching(sites, ["zone"], 3.0).collect()
    assert len(exact) == most and fits([(r["a"], r["b"]) for r in exact]) and all(r["proved"] for r in exact)
    greedy = pairing.greedy_matching(sites, ["zone"], 3.0).collect()
    for k in {r["solution"] for r in greedy}:
        s = [(r["a"], r["b"]) for r in greedy if r["solution"] == k]
        assert fits(s) and not any(fits([*s, p]) for p in at if p not in s) and len(s) <= most
    free = pairing.exact_matching(sites.drop("x", "y", "z"), ["zone"]).collect()
    assert len({v for r in free for v in (r["a"], r["b"])}) == 2 * len(free) >= 2 * most
    one = pairing.greedy_matching(spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 0.0), (0, 3, 4, 1.0, 0.0, 0.0)], sites.schema), ["zone"], 5.0).filter("solution = 1")
    assert one.count() == 1  # sites 1 apart


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "tomogram_name string, alignment_dir string, v int")
    new = spark.createDataFrame([("a", "1", 5), ("a", "2", 6)], old.schema)
    once = sinks.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sinks.upsert(once, new).collect())) == [("a", "1", 5), ("a", "2", 6), ("b", "1", 2)]


def test_null_keys_are_equal(spark):
    old = spark.createDataFrame([(None, "1", 1), ("b", None, 2)], "tomogram_name string, alignment_dir string, v int")
    new = spark.createDataFrame([(None, "1", 5)], old.schema)
    once = sinks.upsert(old, new)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(once) == rows(sinks.upsert(once, new)) and once.count() == 2 and sinks.delete(once, new).count() == 1


def test_failed_results_are_replaced(spark):
    schema = "tomogram_name string, alignment_dir string, analysis string, status string"
    old = spark.createDataFrame([("a", "1", "x", "error"), ("b", "1", "x", "completed")], schema)
    new = spark.createDataFrame([("a", "1", "x", "completed"), ("b", "1", "x", "error")], schema)
    assert {(r[0], r[3]) for r in sinks.store(old, new).collect()} == {("a", "completed"), ("b", "completed")}


def test_names(spark):
    want = {"x": "x_nm", "center_x": "center_x_nm", "area_nm2": "area_nm2", "psd_width": "psd_width", "cleft_width": "cleft_width_nm", "area": "area_um2", "sphericity_volume": "sphericity_volume", "volume": "volume_um3",
            "aunp_density": "aunp_density_per_um2", "density": "density", "surface_distance_nm": "surface_distance_nm_um2", "box": "box", "my_point_z": "my_point_z_nm", "centre_x": "centre_x"}
    assert {k: names.with_unit(k) for k in want} == want
    assert names.with_unit("az_distance") == "az_distance_nm" and names.with_unit("x_nm_distance") == "x_nm_distance"
    df = spark.createDataFrame([("0, 2.0 x",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(names.id_list("s")).collect()] == [[0, 2], None, None]
    with pytest.raises(Exception, match="missing"):
        spark.createDataFrame([("nan",)], "s string").select(names.required_key("s")).collect()


def test_nan_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,)], "v double")
    r = df.agg(F.avg(numeric.finite("v")).alias("m"), numeric.sample_std_or_zero("v").alias("s")).first()
    assert r["m"] == 2.0 and r["s"] == pytest.approx(2**0.5)


def test_scramble_takes_large_ids(spark):
    from pointloom.operators import nulls

    ids = [5_000_000_000 + i * 1_000_003 for i in range(6)]
    p = spark.createDataFrame([(0, i) for i in ids], "zone int, id long")
    first = spark.createDataFrame([(0, 3)], "zone int, n1 int")
    got = nulls.permuted_labels(p, 200, ["zone"], first).filter("is_first").groupBy("id").count().collect()
    assert {r["id"] for r in got} == set(ids) and all(70 <= r["count"] <= 130 for r in got)


def test_zone_tables(spark):
    from pointloom.plans import zones

    none = spark.createDataFrame([], "zone int, synaptic_designation string, cluster int, d double")
    z = spark.createDataFrame([(1, 0.0), (2, None), (3, 2.0)], "zone int, post_area double")
    rows = {r["zone"]: r for r in zones.zone_rows(z, none, ["zone"], ["d"]).collect()}
    assert rows[1]["aunp_density"] is None and rows[2]["aunp_density"] is None and rows[3]["aunp_density"] == 0.0 and rows[3]["d_mean"] is None
    with pytest.raises(Exception, match="no pre_area"):
        zones.zone_totals(z.filter("zone <> 2").withColumn("pre_area", F.lit(None).cast("double")).withColumn("span", F.lit(1.0)), []).collect()
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id int, x double, y double, z double")
    far = zones.closest_zone(v, v.limit(0), spark.createDataFrame([], "zone string, id long, x double, y double, z double"), ()).first()
    assert far["zone"] == "unknown" and far["distance"] is None
    pos = zones.zone_by_position(spark.createDataFrame([(7,), (3,), (9,)], "cleft int"), spark.createDataFrame([("b",), ("a",)], "zone string"), ())
    assert sorted(map(tuple, pos.collect())) == [(3, "a"), (7, "b")]


def test_files_are_read_again_as_written(spark, tmp_path):
    from pointloom.sources import text

    p = spark.createDataFrame([(2, 4.0, 5.5, -6.25), (1, 1.0, 2.0, 3.0)], "id long, x double, y double, z double")
    sinks.write_xyz(p, str(tmp_path / "xyz"))
    lines = [x for f in sorted((tmp_path / "xyz").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["1.000000e+00 2.000000e+00 3.000000e+00", "4.000000e+00 5.500000e+00 -6.250000e+00"]
    star = [r["value"] for r in sinks.star_lines(p, ["x", "y"]).collect()]
    assert star == ["", "data_", "", "loop_", "_x #1", "_y #2", "1.0 2.0", "4.0 5.5"] and text is not None
    atoms = [r["value"] for r in sinks.pdb_lines(p.withColumnRenamed("id", "n"), 10.0).orderBy("n").collect()]
    assert float(atoms[0][30:38]) == 10.0 and float(atoms[1][46:54]) == -62.5
    corners = sinks.sphere_atoms(p, 3.0).filter("id = 1").collect()
    assert len(corners) == 8 and all(np.linalg.norm([r["x"] - 1, r["y"] - 2, r["z"] - 3]) == pytest.approx(3.0) for r in corners)


def test_edge_factors_of_a_box_are_those_of_its_grid(spark):
    p = frame(spark, np.random.default_rng(6).uniform(-10, 14, (40, 3)), zone=[i % 2 for i in range(40)])
    plain = lambda df: sorted(map(tuple, df.select("zone", "id", "bin", "r", "in_grid", F.round("p", 9)).collect()))
    assert plain(ripley.box_edge_factors(p, p, 2.0, 3.0, 12.0, ["zone"])) == plain(ripley.edge_factors(p, ripley.lattice(p, 2.0, ["zone"]), 2.0, 3.0, 12.0, ["zone"]))


def test_window_of_a_hull(spark):
    x = np.random.default_rng(7).uniform(0, 30, (60, 3))
    p = frame(spark, x, zone=[0] * 60)
    grid = ripley.window_grid(p, geometry.hull_planes(p.select("zone", "x", "y", "z"), ["zone"]), 1.5, ["zone"])
    volume = ripley.window_volumes(grid, 1.5, ["zone"]).first()["volume"]
    assert volume == pytest.approx(geometry.hull_measures(x)[1], rel=0.05)
    top, bottom = (frame(spark, np.c_[np.random.default_rng(8).uniform(0, 30, (80, 2)), np.full(80, z)], zone=[0] * 80) for z in (10.0, 20.0))
    between = ripley.window_grid(p, geometry.hull_planes(p.select("zone", "x", "y", "z"), ["zone"]), 3.0, ["zone"], bottom, top).collect()
    assert between and all(8 <= r["z"] <= 22 for r in between)


def brute_k(x, one, two, volume, p, radii):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [(d < r) & ~np.eye(len(x), dtype=bool) for r in radii]
    return np.array([volume / (one.sum() * two.sum()) * ((m & two[None]).sum(1)[one] / p[one, k]).sum() for k, m in enumerate(near)])


def test_two_kinds_as_brute_force(spark):
    """Observed curves and null curves of both directions, with edge factors, and their global test."""
    import hashlib

    from pointloom.operators import nulls
    from pointloom.plans import analyses

    rng = np.random.default_rng(17)
    n, step, last = 24, 4.0, 5
    x = rng.uniform(0, 20, (n, 3))
    kind = np.array([i % 3 == 0 for i in range(n)])
    p = frame(spark, x, kind=[0 if k else 1 for k in kind], zone=[3] * n).withColumn("id", F.col("id").cast("long"))
    volume = ripley.volumes(p, ["zone"])
    factors = ripley.box_edge_factors(p, p, 2.0, step, step * last, ["zone"])
    share = {(r["id"], r["bin"]): r["p"] for r in factors.collect()}
    w = np.array([[share[i, b + 1] for b in range(last)] for i in range(n)])
    v, radii = volume.first()["volume"], [step * (b + 1) for b in range(last)]
    curve, tests = analyses.two_kinds(p, volume, factors, step, step * last, 30, least=30)
    got = {(r["null"], r["curve"], r["rep"], r["r"]): r["k"] for r in curve.collect()}
    for rep in (-1, 0, 7, 29):
        order = sorted(range(n), key=lambda i: hashlib.md5(f"{rep}:{i}".encode()).hexdigest())
        one = kind if rep < 0 else np.isin(np.arange(n), order[: kind.sum()])
        k12, k21 = brute_k(x, one, ~one, v, w, radii), brute_k(x, ~one, one, v, w, radii)
        both = (one.sum() * k12 + (~one).sum() * k21) / n
        for c, want in (("12", k12), ("21", k21), ("combined", both)):
            assert [got["labels", c, rep, r] for r in radii] == pytest.approx(want.tolist(), rel=1e-5)
    t = {(r["null"], r["curve"], r["r_range"]): r for r in tests.collect()}
    null = {k: np.array([[got["labels", "21", rep, r] for r in radii] for rep in range(30)]) for k in ("k",)}["k"]
    lift = lambda k: np.cbrt(3 * np.maximum(k, 0) / (4 * np.pi)) - np.array(radii)
    obs, null = lift(np.array([got["labels", "21", -1, r] for r in radii])), lift(null)
    mu = np.vstack([null, obs]).mean(0)
    t_obs, t_null = abs(obs - mu).max(), abs(null - mu).max(1)
    r = t["labels", "21", "full"]
    at = int(np.argmax(abs(obs - mu)))
    assert (r["t_obs"], r["t_crit"], r["p"], r["r_at_max"], r["signed_diff"]) == pytest.approx((t_obs, np.quantile(t_null, 0.99), ((t_null >= t_obs).sum() + 1) / 31, radii[at], (obs - mu)[at]), rel=1e-5)
    assert len(t) == 6 and nulls.mad_test(curve.filter("rep = -1 and curve = '12' and `null` = 'labels'"), curve.filter("rep >= 0 and curve = '12' and `null` = 'labels'"), ["zone"], least=31).first()["status"] == "skipped"


def test_fusion_sites(spark):
    from pointloom.plans import analyses

    rng = np.random.default_rng(18)
    sites, parts = rng.uniform(0, 30, (6, 3)), rng.uniform(0, 30, (20, 3))
    surface = np.array([(a, b, 15.0) for a in range(0, 31, 3) for b in range(0, 31, 3)], float)
    f = lambda x: frame(spark, x, zone=[0] * len(x)).withColumn("id", F.col("id").cast("long"))
    moved = analyses.permuted_sites(f(sites), f(parts), f(surface), 40).collect()
    for rep in range(40):
        mine = [r for r in moved if r["rep"] == rep]
        assert len(mine) == 6
        for r in mine:
            at = np.array([r["x"], r["y"], r["z"]])
            if r["own"]:
                assert at == pytest.approx(sites[r["id"] // 2])
            else:
                want = surface[np.argmin(((surface - parts[r["id"] // 2]) ** 2).sum(1))]
                assert at == pytest.approx(want)
    assert {r["own"] for r in moved} == {True, False} and analyses.permuted_sites(f(sites), f(parts).limit(0), f(surface), 3).count() == 0
    every = f(np.vstack([sites, parts, surface]))
    c = analyses.fusion_sites(f(sites[:3]), f(sites[3:]), f(parts), f(surface), ripley.volumes(every, ["zone"]), every, 3.0, 5.0, 20.0, 5, 6.0, snap_limit=6.0, least=1.0)
    table = analyses.fusion_table(c).collect()
    assert {r["comparison"] for r in table} == {"close", "shift", "labels"} and len(table) == 12
    n = c.groupBy("comparison").agg(F.count_distinct("rep").alias("n")).collect()
    assert {r["comparison"]: r["n"] for r in n} == {"observed": 1, "close": 1, "shift": 5, "labels": 5}
    k = {r["r"]: r["k"] for r in c.filter("comparison = 'close'").collect()}
    share = {(r["id"], r["r"]): r["p"] for r in ripley.box_edge_factors(f(sites[3:]), every, 3.0, 5.0, 20.0, ["zone"]).collect()}
    v = ripley.volumes(every, ["zone"]).first()["volume"]
    for r in k:
        d = np.sqrt(((sites[3:, None] - parts[None]) ** 2).sum(-1)) < r
        assert k[r] == pytest.approx(v / 60 * sum(d[i].sum() / share[i, r] for i in range(3)))


def test_mesh_distance_as_brute_force(spark):
    rng = np.random.default_rng(19)
    v, p = rng.uniform(0, 10, (12, 3)), rng.uniform(0, 10, (15, 3))
    f = [tuple(map(int, rng.choice(12, 3, replace=False))) for _ in range(10)]
    faces = spark.createDataFrame(f, "v0 long, v1 long, v2 long")
    got = {r["id"]: r["d"] for r in geometry.nearest_on_mesh(frame(spark, p), frame(spark, v), faces, [], 20.0).collect()}
    s = rng.dirichlet((0.6, 0.6, 0.6), 60_000)
    for i, q in enumerate(p):
        best = min(np.linalg.norm(s @ v[list(t)] - q, axis=1).min() for t in f)
        assert got[i] <= best + 1e-9 and got[i] == pytest.approx(best, abs=0.15)
    flat = geometry.point_triangle_distances(np.array([[0.2, 0.2, 3.0], [2.0, 0.0, 0.0]]), *[np.array([c, c], float) for c in ((0, 0, 0), (1, 0, 0), (0, 1, 0))])
    assert flat == pytest.approx([3.0, 1.0])


def test_loops_are_closed(spark):
    square = [(0, 1), (1, 2), (2, 3), (0, 3), (5, 6), (6, 7), (5, 7)]
    assert geometry.loops_of(square) == [[0, 1, 2, 3], [5, 6, 7]]
    ring = [(np.cos(t), np.sin(t), 0.0) for t in np.linspace(0, 2 * np.pi, 24, endpoint=False)]
    rows = geometry.alpha_polygons(frame(spark, ring, zone=[0] * 24), ["zone"]).orderBy("loop", "order").collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == 24 and all((b - a) % 24 in (1, 23) for a, b in zip(ids, ids[1:], strict=False))


def test_frames_samples_and_hulls_as_brute_force(spark):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(60, 3)) * [5, 2, 1] + [3, -4, 10]
    p = frame(spark, x, zone=[0] * 60)
    r = geometry.principal_frames(p, ["zone"]).first()
    axes = np.array([[r[f"{a}{k}"] for k in "xyz"] for a in "uvw"])
    cov = np.cov(x.T, bias=True)
    assert np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) == pytest.approx(1) and [r[f"c{k}"] for k in "xyz"] == pytest.approx(x.mean(0))
    turned = axes @ cov @ axes.T
    assert np.allclose(turned, np.diag(np.diag(turned)), atol=1e-9) and (np.diff(np.diag(turned)) <= 0).all()
    order = [q["id"] for q in geometry.farthest_points(p, ["zone"], 6).orderBy("order").collect()]
    want, d = [0], ((x - x[0]) ** 2).sum(1)
    while len(want) < 10:
        want.append(int(np.argmax(d)))
        d = np.minimum(d, ((x - x[want[-1]]) ** 2).sum(1))
    assert order == want
    y = rng.normal(size=(80, 3)) * 4 + [3, -4, 10]
    inside = {q["id"] for q in spatial.inside_hull(frame(spark, y, zone=[0] * 80), geometry.hull_planes(p, ["zone"]), ["zone"]).collect()}
    import itertools

    planes = []  # every plane through three points with all points on one side
    for i, j, k in itertools.combinations(range(60), 3):
        m = np.cross(x[j] - x[i], x[k] - x[i])
        s = (x - x[i]) @ m
        if (s <= 1e-9).all() or (s >= -1e-9).all():
            planes.append((m if (s <= 1e-9).all() else -m, x[i]))
    assert inside == {i for i, q in enumerate(y) if all((q - o) @ m <= 1e-6 for m, o in planes)}
    a = geometry.centre_between(frame(spark, [(0, 0, 0), (1, 0, 0), (0.5, 0, 4), (9, 9, 9)], zone=[0] * 4, side=["pre", "pre", "post", "post"]), ["zone"]).first()
    assert (a["x"], a["y"], a["z"]) in ((0.75, 0.0, 2.0), (0.25, 0.0, 2.0))


def test_shifts_snap_to_the_surface(spark):
    from pointloom.operators import nulls

    grid = [(a, b, 0.0) for a in range(0, 41, 2) for b in range(0, 41, 2)]
    surface = frame(spark, grid, zone=[0] * len(grid)).withColumn("id", F.col("id").cast("long"))
    sites = frame(spark, [(20.0, 20.0, 1.0), (10.0, 30.0, -1.0)], zone=[0, 0]).withColumn("id", F.col("id").cast("long"))
    rows = nulls.shifted_sites(sites, surface, 30, 8.0, snap_limit=3.0).collect()
    assert len(rows) == 60 and all((r["x"], r["y"], r["z"]) in set(grid) for r in rows)
    at = {0: (20.0, 20.0, 1.0), 1: (10.0, 30.0, -1.0)}
    gaps = [np.linalg.norm(np.array(at[r["id"]]) - (r["x"], r["y"], r["z"])) for r in rows]
    assert all(5.0 <= g <= 11.0 for g in gaps) and len({(r["id"], r["x"], r["y"]) for r in rows}) > 8


def test_segregation_grows_by_nearest(spark):
    from pointloom.operators import nulls

    x = np.random.default_rng(21).uniform(0, 10, (12, 3))
    p = frame(spark, x, zone=[0] * 12).withColumn("id", F.col("id").cast("long"))
    rows = nulls.segregated_labels(p, 20, spark.createDataFrame([(0, 5)], "zone int, n1 int")).collect()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)

    def grown(s):
        for start in s:
            got = [start]
            while len(got) < len(s):
                rest = [i for i in range(12) if i not in got]
                got.append(min(rest, key=lambda i: (min(d[i, j] for j in got), i)))
            if set(got) == s:
                return True
        return False

    for rep in range(20):
        one = {r["id"] for r in rows if r["rep"] == rep and r["is_first"]}
        assert len(one) == 5 and (grown(one) or grown(set(range(12)) - one))


def test_orientation_carries_the_ideal_vectors():
    rng = np.random.default_rng(22)
    for _ in range(10):
        q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        q *= np.sign(np.linalg.det(q))
        ideal = np.array([[-0.5, 0.0, 1.0], [0.5, 0.0, 1.0]])
        r = pairing.align((ideal @ q.T)[None], ideal)[0]
        assert np.allclose(r, q, atol=1e-9)


def test_rasters(spark):
    from pointloom.operators import raster

    v = np.random.default_rng(23).normal(size=(5, 4, 3))
    vox = spark.createDataFrame([(z, y, x, float(v[z, y, x])) for z in range(5) for y in range(4) for x in range(3)], "z int, y int, x int, value double")
    mid = {(r["y"], r["x"]): r["value"] for r in raster.central_slice(vox).collect()}
    assert mid == {(y, x): v[2, y, x] for y in range(4) for x in range(3)}
    image = raster.slab(vox, 2, 1, "max").select("y", "x", "value")
    got = {(r["y"], r["x"]): r["value"] for r in raster.crop(image, 0, 0, 4, -1.0).collect()}
    assert len(got) == 16 and got[-1, 0] == -1.0 and got[1, 1] == v[1:4, 1, 1].max()
    c = sorted(r["value"] for r in raster.contrast(image).collect())
    assert c[0] == 0.0 and c[-1] == 1.0
    same = raster.resampled(vox, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], (5, 4, 3)).collect()
    assert all(r["value"] == pytest.approx(v[r["z"], r["y"], r["x"]]) for r in same) and len(same) == 60
    half = raster.resampled(vox, [[1, 0, 0, 0.5], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], (1, 1, 3), 7.0).orderBy("x").collect()
    assert [r["value"] for r in half] == pytest.approx([v[0, 0, :2].mean(), v[0, 0, 1:].mean(), (v[0, 0, 2] + 7) / 2])


def test_templates_and_status(spark):
    poses = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0)], "pose int, rot double, tilt double, psi double, x double, y double, z double")
    atoms = spark.createDataFrame([("C", 1.0, 0.0, 0.0), ("N", -1.0, 0.0, 0.0)], "atom string, x double, y double, z double")
    placed = {r["atom"]: (r["x"], r["y"], r["z"]) for r in pairing.placed_template(poses, atoms).collect()}
    assert placed == {"C": pytest.approx((11.0, 20.0, 30.0)), "N": pytest.approx((9.0, 20.0, 30.0))}
    done = sinks.completed(spark.createDataFrame([("t", "a", "x", "completed"), ("t", "a", "b", "completed"), ("t", "a", "c", "error")], "tomogram_name string, alignment_dir string, analysis string, status string")).first()
    assert done["analyses"] == ["b", "x"]
    old = spark.createDataFrame([("k", 1, 10), ("l", 2, 5)], "name string, v int, updated_at int")
    new = spark.createDataFrame([("k", 7, 11), ("l", 8, 4)], old.schema)
    assert [(r["name"], r["v"]) for r in sinks.last_write_wins(old, new, ["name"]).collect()] == [("k", 7), ("l", 2)]


def test_nearest_is_one_definition(spark):
    """Few pairs, or cells that double, or a bound: rows with NaN, infinite or null coordinates meet nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, i, float(i % 7), float(i % 5) * 2, i * 0.37) for i in range(40)] + [(1, 100, nan, 0.0, 0.0), (1, 101, inf, 0.0, 0.0), (1, 102, None, 0.0, 0.0), (1, 103, 0.0, -inf, nan), (2, 200, nan, 1.0, 1.0)]
    left = spark.createDataFrame(rows, "zone int, id long, x double, y double, z double")
    right = spark.createDataFrame([(z, i + 7, y, x, w) for z, i, x, y, w in rows], "zone int, id long, x double, y double, z double")
    key = lambda df: sorted((r["zone"], r["a_id"], r["b_id"], round(r["d"], 9)) for r in df.collect())
    few = key(spatial.nearest(left, right, ["zone"]))
    assert len(few) == 40 and all(d == d for *_, d in few)
    assert few == key(spatial.nearest(left, right, ["zone"], cell=0.5)) == key(spatial.nearest(left, right, ["zone"], max_distance=50.0))


def test_hulls_of_large_groups_need_their_corners_only(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.vstack([r.normal(size=(60_000, 3)), [[np.nan, 0, 0], [np.inf, 0, 0]]])
    rows = [("big", *map(float, v)) for v in x] + [(None, float(i), float(i * i % 7), float(i % 3)) for i in range(50)] + [("flat", float(i % 9), float(i // 9), 0.0) for i in range(81)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(8)
    kept = {r["g"]: (r["n"], r["m"]) for r in geometry.corners(df, ["g"]).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m")).collect()}
    assert kept["big"][0] < 3000 and {g: m for g, (_, m) in kept.items()} == {"big": 60_000, None: 50, "flat": 81}
    stats = {r["g"]: r for r in geometry.hull_stats(df, ["g"]).collect()}
    area, volume = geometry.hull_measures(x[:-2])
    assert stats["big"]["n_points"] == 60_000 and stats["big"]["volume"] == pytest.approx(volume) and stats["big"]["area"] == pytest.approx(area / 2)
    assert stats["flat"]["volume"] == 0.0 and stats[None]["volume"] > 0
    spans = {r["g"]: r["span"] for r in geometry.spans(df, ["g"]).collect()}
    v = x[:-2][np.unique(geometry.hull_facets(x[:-2]))]
    assert spans["big"] == pytest.approx(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)).max()) and spans["flat"] == pytest.approx(np.sqrt(128))


def test_frames_by_sums(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(500, 3)) * [5, 2, 1] @ np.linalg.qr(r.normal(size=(3, 3)))[0] + 100
    rows = [("a", *map(float, v)) for v in x] + [("a", float("nan"), 0.0, 0.0), ("one", 1.0, 2.0, 3.0), ("none", None, 1.0, 1.0)]
    got = {r["g"]: r for r in geometry.principal_frames(spark.createDataFrame(rows, "g string, x double, y double, z double"), ["g"]).collect()}
    assert set(got) == {"a", "one"} and (got["one"]["cx"], got["one"]["cz"]) == (1.0, 3.0)
    f = np.array([[got["a"][f"{a}{k}"] for k in "xyz"] for a in "uvw"])
    assert np.allclose(f @ f.T, np.eye(3)) and np.linalg.det(f) == pytest.approx(1)
    spread = ((x - x.mean(0)) @ f.T).var(0)
    assert spread[0] > spread[1] > spread[2] and np.allclose(np.cov((x @ f.T).T) - np.diag(np.diag(np.cov((x @ f.T).T))), 0, atol=1e-9)
    assert all(f[i][np.argmax(np.abs(f[i]) > 1e-12)] > 0 for i in (0, 1))


def test_pairs_of_one_key_are_dealt(spark):
    # all rows have one key: blocks of both sides meet by sorting, every pair once
    from pointloom.operators import spatial

    p = spark.range(90).selectExpr("id", "0 AS zone", "id % 7D AS x", "id % 5D AS y", "id % 3D AS z")
    out = spatial.pairs_within_keys(p, p.filter("id < 40"), ["zone"], dealt=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "_i" in plan and "_j" in plan
    assert sorted((r["a_id"], r["b_id"]) for r in out.collect()) == [(a, b) for a in range(90) for b in range(40)]
    assert out.drop("d").columns == ["zone", "a_id", "a_x", "a_y", "a_z", "b_id", "b_x", "b_y", "b_z"]


def test_round_six_is_round(spark):
    from pointloom.functions import numeric

    rng = np.random.default_rng(2)
    tied = [k / 2e6 for k in range(-41, 42)] + [0.1234565, 2.5000005, 1.0000005, 999999.9999995, 1e9 + 0.1, -0.0, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [*tied, *rng.normal(0, 50, 3000), *rng.normal(0, 1e-6, 500), *rng.normal(0, 1e6, 500)]], "v double")
    got = df.select(numeric.round_six("v").alias("a"), F.round("v", 6).alias("b"))
    assert got.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
