import hashlib

import numpy as np
import pytest
from conftest import SF  # noqa: F401
from pyspark.sql import functions as F

from pointloom.operators import nulls


def brute_labels(ids, n1, replicates):
    out = np.zeros((replicates, len(ids)), bool)
    for rep in range(replicates):
        order = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{rep}:{ids[i]}".encode()).hexdigest())  # noqa: B023
        out[rep, order[:n1]] = True
    return out


@pytest.mark.parametrize("scale", [10.0, 200.0])
def test_replicates_over_chunks_as_brute_force(spark, monkeypatch, scale):
    # A zone in many chunks, within one cell or over many; labels are words of 64 replicates, never rows.
    monkeypatch.setattr(nulls, "CHUNK", 16)
    monkeypatch.setattr(nulls, "FILL", 4)
    monkeypatch.setattr(nulls, "ROWS", 7)
    rng, n, n1, reps = np.random.default_rng(5), 90, 37, 70
    x, ids = rng.uniform(-scale, scale, (n, 3)), np.arange(n) * 11 + 3
    p = spark.createDataFrame([(1, int(i), *map(float, v)) for i, v in zip(ids, x, strict=True)], "zone int, id long, x double, y double, z double")
    first = spark.createDataFrame([(1, n1)], "zone int, n1 int")
    bits = nulls.permuted_bits(p, reps, ["zone"], first)
    assert bits.count() == 2 * n
    one = brute_labels(ids, n1, reps)
    rows = {(r["rep"], r["id"]): r["is_first"] for r in nulls.permuted_labels(p, reps, ["zone"], first).collect()}
    assert rows == {(r, int(i)): bool(one[r, k]) for r in range(reps) for k, i in enumerate(ids)}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    bins = np.where(d <= 12, d // 3 + 1, 0).astype(int)
    np.fill_diagonal(bins, 0)
    bins[bins > 4] = 0
    want = {(r, b): int(((bins == b) & one[r][:, None] & ~one[r][None]).sum()) for r in range(reps) for b in range(1, 5)}
    want = {k: v for k, v in want.items() if v}
    for labels in (bits, nulls.permuted_labels(p, reps, ["zone"], first)):
        got = {(r["rep"], r["bin"]): r["n12"] for r in nulls.permuted_counts(p, labels, 3.0, 12.0, ["zone"]).collect()}
        assert got == want
    w = rng.uniform(0.2, 1.0, (n, 4))
    factors = spark.createDataFrame([(1, int(i), b + 1, float(w[k, b])) for k, i in enumerate(ids) for b in range(4)], "zone int, id long, bin int, p double")
    some = nulls.permuted_labels(p, reps, ["zone"], first).filter(F.col("id") % 5 != 0)  # points without a label count nowhere
    known = ids % 5 != 0
    for labels, mask in ((bits, np.ones(n, bool)), (some, known)):
        got = {(r["rep"], r["bin"]): (r["s12"], r["s21"]) for r in nulls.permuted_sums(p, labels, factors, 3.0, 12.0, ["zone"]).collect()}
        for r in (0, 1, 63, 64, 69):
            for b in range(1, 5):
                near = (bins > 0) & (bins <= b) & mask[:, None] & mask[None]
                s12 = ((near & one[r][:, None] & ~one[r][None]).sum(1) / w[:, b - 1]).sum()
                s21 = ((near & ~one[r][:, None] & one[r][None]).sum(1) / w[:, b - 1]).sum()
                assert got.get((r, b), (0, 0)) == pytest.approx((s12, s21), rel=1e-9)


def test_copies_of_rows_are_not_broadcast(spark, tmp_path):
    # 2000 points of a small file become 54000 rows in their cells; Spark takes them for a few kilobytes.
    from pointloom.operators import spatial

    spark.range(2000).selectExpr("id", "0 AS zone", "id % 7D AS x", "id % 5D AS y", "id % 3D AS z").write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    plan = spatial.within(p, p, 1.0, ["zone"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def brute_growth(x, start, size):
    inside, d, order, at = np.zeros(len(x), bool), np.full(len(x), np.inf), [], start
    for _ in range(size):
        inside[at] = True
        order.append(at)
        d = np.minimum(d, ((x - x[at]) ** 2).sum(1))
        at = int(np.argmin(np.where(inside, np.inf, d)))
    return order


@pytest.mark.parametrize("kind", ["apart", "lattice", "copies"])
def test_growth_over_shortest_edges_as_over_all(kind):
    # Ties of a lattice and copies of points too: the same points in the same order, from few edges.
    rng = np.random.default_rng(6)
    x = {"apart": rng.normal(size=(80, 3)), "lattice": rng.integers(0, 5, (80, 3)).astype(float), "copies": np.repeat(rng.normal(size=(8, 3)), 10, 0)}[kind]
    x = x[rng.permutation(80)]
    place, near, gap = nulls._Growth.edges_of(x)
    growth = nulls._Growth(place, near, gap)
    assert all(growth.grown(s, n) == brute_growth(x, s, n) for s in range(80) for n in (0, 1, 33, 80))
    edges, places = sum(map(len, near)) // 2, len(set(place))
    assert edges >= places - 1 and (kind == "lattice" or edges == places - 1)


def test_points_that_are_not_finite_grow_last(spark):
    rows = [(0, i, float(i), 0.0, 0.0) for i in range(6)] + [(0, 9, float("nan"), 0.0, 0.0), (0, 10, None, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "zone int, id long, x double, y double, z double")
    got = nulls.segregated_labels(p, 40, spark.createDataFrame([(0, 8)], "zone int, n1 int")).collect()
    assert len(got) == 320 and {r["rep"] for r in got} == set(range(40))
    g = nulls._Growth(*nulls._Growth.edges_of(np.array([[np.nan, 0, 0], [1, 0, 0], [2, 0, 0], [np.inf, 0, 0]])))
    assert g.grown(2, 4) == [2, 1, 0, 3] and g.grown(3, 4)[0] == 3


def test_segregated_bits_have_a_row_for_a_word(spark):
    x = np.random.default_rng(7).normal(size=(30, 3))
    p = spark.createDataFrame([(0, i, *map(float, v)) for i, v in enumerate(x)], "zone int, id long, x double, y double, z double")
    bits = nulls.segregated_bits(p, 70, spark.createDataFrame([(0, 11)], "zone int, n1 int")).collect()
    assert len(bits) == 60 and all((r["ones"] & r["twos"]) == 0 for r in bits)


def test_sites_move_in_chunks(spark, monkeypatch):
    # Chunks of a few sites, cells with a few points, rows that are not finite: the moves of a site stay its own.
    x = np.random.default_rng(8).normal(size=(150, 3)) * 12
    rows = [(i % 2, i, *map(float, v)) for i, v in enumerate(x)] + [(0, 900, float("nan"), 0.0, 0.0), (1, 901, None, 0.0, 0.0), (5, 902, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "zone int, id long, x double, y double, z double")
    how = {"reach": 6.0, "snap_limit": 4.0, "tries": 10}
    want = {}
    for i in range(150):
        s = x[i % 2 :: 2]
        gap = np.linalg.norm(s - x[i], axis=1)
        local = s[gap <= 6] if (gap <= 6).sum() >= 5 else s[gap <= 12]
        if len(local) < 3:
            continue
        axes = np.linalg.svd(local - local.mean(0), full_matrices=False)[2]
        for rep in range(9):
            for t in nulls._seeded(0, rep, i).uniform(0, 2 * np.pi, 10):
                d = ((s - (x[i] + 8.0 * (np.cos(t) * axes[0] + np.sin(t) * axes[1]))) ** 2).sum(1)
                j = int(np.argmin(d))
                if d[j] <= 16 and gap[j] >= 5:
                    want[i, rep] = tuple(s[j])
                    break
    for size in (3, 512):
        monkeypatch.setattr(nulls, "SITES", size)
        got = nulls.shifted_sites(p, p, 9, 8.0, **how)
        assert {(r["id"], r["rep"]): (r["x"], r["y"], r["z"]) for r in got.collect()} == want and len(want) > 200
    assert "FlatMapCoGroups" in got._jdf.queryExecution().executedPlan().toString()  # sites meet the surface in arrays


def test_foci_of_one_file_are_shared_out(spark):
    # the lattice around a focus is long work for a small row: one partition in, as many tasks as a shuffle has
    from pointloom.operators import ripley

    p = spark.range(60).selectExpr("id", "0 AS zone", "id % 7D AS x", "id % 5D AS y", "id % 3D AS z").coalesce(1)
    out = ripley.box_edge_factors(p, p, 1.0, 1.0, 3.0, ["zone"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_two_null_models_meet_once(spark, monkeypatch):
    # an odd number of shells, and the labels of both models in one set of words
    from pointloom.operators import ripley
    from pointloom.plans import analyses

    met, whole = [], nulls.permuted_sums
    monkeypatch.setattr(nulls, "permuted_sums", lambda *a: met.append(a) or whole(*a))
    rng, n, reps = np.random.default_rng(8), 60, 5
    x = rng.uniform(0, 6, (n, 3))
    p = spark.createDataFrame([(1, i, i % 2, *map(float, v)) for i, v in enumerate(x)], "zone int, id long, kind int, x double, y double, z double")
    curve, _ = analyses.two_kinds(p, ripley.volumes(p, ["zone"]), ripley.box_edge_factors(p, p, 1.0, 1.0, 3.0, ["zone"]), 1.0, 3.0, reps, least=5)
    assert len(met) == 1
    got = {(r["null"], r["rep"], r["r"]): r["k"] for r in curve.filter("curve = '12'").collect()}
    assert len(got) == 2 * (reps + 1) * 3
    share = {(r["id"], r["bin"]): r["p"] for r in ripley.box_edge_factors(p, p, 1.0, 1.0, 3.0, ["zone"]).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    volume, n1 = float(np.prod(x.max(0) - x.min(0))), n // 2
    first = p.filter("kind = 0").groupBy("zone").agg(F.count(F.lit(1)).alias("n1"))
    for name, labels in (("labels", nulls.permuted_labels(p, reps, ["zone"], first)), ("segregated", nulls.segregated_labels(p, reps, first))):
        one = {(r["rep"], r["id"]): r["is_first"] for r in labels.collect()} | {(-1, i): i % 2 == 0 for i in range(n)}
        for rep in range(-1, reps):
            a = np.array([one[rep, i] for i in range(n)])
            for b in (1, 2, 3):
                w = sum(((d[i] < b) & ~a).sum() / share[i, b] for i in np.flatnonzero(a))
                assert got[name, rep, float(b)] == pytest.approx(volume / (n1 * (n - n1)) * w, rel=1e-9)
