import numpy as np
import pytest

from pointloom.operators import clusters, geometry


def brute_area(p, loops, margin, pixel):
    """All pixels against all segments and, by the sum of angles, all loops."""
    lo, hi = p.min(0) - margin - pixel, p.max(0) + margin + pixel
    at = np.array([(x, y) for y in np.arange(lo[1], hi[1] + pixel, pixel) for x in np.arange(lo[0], hi[0] + pixel, pixel)])
    hit = np.zeros(len(at), bool)
    for loop in loops or [p[i : i + 1] for i in range(len(p))]:
        turn = np.zeros(len(at))
        for a, b in zip(loop, np.roll(loop, -1, 0), strict=True):
            ab = b - a
            s = np.clip((at - a) @ ab / max(ab @ ab, 1e-300), 0, 1)
            hit |= np.linalg.norm(at - a - s[:, None] * ab, axis=1) <= margin
            u, v = a - at, b - at
            turn += np.arctan2(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0], (u * v).sum(1))
        hit |= np.abs(turn) > np.pi
    return hit.sum() * pixel**2


@pytest.mark.parametrize("seed", range(4))
def test_raster_by_rows_against_all_pixels(seed):
    rng = np.random.default_rng(seed)
    p = rng.normal(0, 20, (60, 2)) if seed else np.column_stack([np.cos(np.arange(80)), np.sin(np.arange(80))]) * rng.uniform(40, 50, (80, 1))
    loops = geometry.adaptive_loops(p)
    assert loops and (geometry.inside_loops(p + 1e-9, loops) | [any((abs(loop - q) < 1e-9).all(1).any() for loop in loops) for q in p]).all()
    for margin, pixel in ((5.0, 1.0), (2.0, 0.7)):
        assert geometry.grown_area(p, loops, margin, pixel) == pytest.approx(brute_area(p, loops, margin, pixel))
    assert geometry.grown_area(p, [], 5.0, 1.0) == pytest.approx(brute_area(p, [], 5.0, 1.0))


def test_a_ring_counts_whole_and_local_gaps_matter():
    t = np.linspace(0, 2 * np.pi, 120, endpoint=False)
    ring = np.vstack([np.column_stack([np.cos(t), np.sin(t)]) * r for r in (47, 50)])
    loops = geometry.adaptive_loops(ring)
    assert len(loops) == 2  # the hole has an outline, its area counts all the same
    assert geometry.grown_area(ring, loops, 5.0, 1.0) == pytest.approx(np.pi * 55**2, rel=0.01)


def test_clusters_of_all_sizes(spark):
    rng = np.random.default_rng(9)
    rows = [("a", 1, *map(float, q)) for q in rng.normal(0, 15, (40, 3))] + [("a", 2, 0.0, 0.0, 0.0), ("a", 2, 3.0, 4.0, 0.0)]
    rows += [("b", 1, float(i), 0.0, 0.0) for i in range(5)] + [("b", 2, float("nan"), 0.0, 0.0), ("b", -1, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "zone string, cluster int, x double, y double, z double")
    got = {(r["zone"], r["cluster"]): r for r in clusters.concave_summary(df, ["zone"]).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("b", 2)}
    p = geometry.to_plane(np.array([r[2:] for r in rows[:40]]))
    assert got["a", 1]["concave_area"] == pytest.approx(brute_area(p, geometry.adaptive_loops(p), 5.0, 1.0), rel=1e-3)
    assert got["a", 1]["concave_density"] == pytest.approx(40 / got["a", 1]["concave_area"])
    line = np.array([[0.0, 0.0], [5.0, 0.0]])
    assert got["a", 2]["concave_area"] == brute_area(line, [], 5.0, 1.0) and got["b", 1]["concave_area"] > 0 and got["b", 2]["concave_area"] is None
    whole = {(r["zone"], r["cluster"]): r for r in clusters.cluster_summary(df, ["zone"]).collect()}
    assert whole["a", 1]["density"] == pytest.approx(40 / whole["a", 1]["area"]) and whole["a", 2]["area"] is None and whole["a", 2]["span"] == 5.0
    assert whole["b", 1]["area"] is None and whole["b", 1]["span"] == 4.0 and whole["b", 2]["span"] is None


def test_gaps_and_crossings_in_little_memory():
    # A matrix of all distances between these points takes 576 MB.
    import tracemalloc

    rng = np.random.default_rng(9)
    p = np.round(rng.normal(0, 12.5, (6000, 2)), 2)
    p[:50] = p[50:100]
    tracemalloc.start()
    got = geometry.neighbour_gaps(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    for i in range(0, 6000, 7):
        d = np.sqrt(((p - p[i]) ** 2).sum(1))
        d[i] = np.inf
        assert got[i] == d.min()
    assert not len(geometry.neighbour_gaps(p[:0])) and np.isinf(geometry.neighbour_gaps(p[:1])).all()
    assert (geometry.neighbour_gaps(np.zeros((3000, 2))) == 0).all()
    loops = [p[rng.permutation(6000)[:9]] for _ in range(5)]
    odd = np.zeros(6000, bool)
    for a in loops:
        one = np.zeros(6000, bool)
        for u, v in zip(a, np.roll(a, -1, 0), strict=True):
            if u[1] != v[1]:
                one ^= ((u[1] <= p[:, 1]) != (v[1] <= p[:, 1])) & (p[:, 0] < u[0] + (p[:, 1] - u[1]) * (v[0] - u[0]) / (v[1] - u[1]))
        odd |= one
    assert (geometry.inside_loops(p, loops) == odd).all()
