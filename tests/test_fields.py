import numpy as np
import pandas as pd
import pytest

from pointloom.operators import fields


def image_of(spark, masks):
    rows = [(k, int(y), int(x), bool(m[y, x])) for k, m in masks.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    return spark.createDataFrame(rows, "k string, y int, x int, on boolean")


def brute_d2(m):
    at = np.argwhere(m)
    grid = np.argwhere(np.ones_like(m))
    if not len(at):
        return np.full(m.shape, np.nan)
    return ((grid[:, None] - at[None]) ** 2).sum(-1).min(1).reshape(m.shape).astype(float)


def brute_maxima(v):
    """Regions by flood fill: {cell: (least cell, area)}."""
    seen, out = set(), {}
    if np.isnan(v).any() or v.min() == v.max():
        return out
    for start in map(tuple, np.argwhere(np.ones(v.shape))):
        if start in seen:
            continue
        todo, flat, top = [start], {start}, True
        while todo:
            c = todo.pop()
            for d in np.ndindex(*[3] * v.ndim):
                n = tuple(a + b - 1 for a, b in zip(c, d, strict=True))
                if n in flat or any(i < 0 or i >= s for i, s in zip(n, v.shape, strict=True)):
                    continue
                if v[n] > v[c]:
                    top = False
                elif v[n] == v[c]:
                    flat.add(n)
                    todo.append(n)
        seen |= flat
        if top:
            out |= {c: (min(flat), len(flat)) for c in flat}
    return out


MASKS = {
    "sparse": np.random.default_rng(1).random((19, 23)) < 0.03,
    "dense": np.random.default_rng(2).random((15, 15)) < 0.3,
    "lines": np.add.outer(np.arange(17) % 8, np.zeros(21, int)) == 0,
    "none": np.zeros((4, 5), bool),
    "all": np.ones((3, 4), bool),
    "one": np.array([[True]]),
}


def test_distances_and_maxima_against_brute_force(spark):
    field = fields.distance_field(image_of(spark, MASKS), ["k"]).cache()
    got = field.toPandas()
    for k, m in MASKS.items():
        g = got[got["k"] == k].sort_values(["y", "x"])
        np.testing.assert_array_equal(g["d2"].to_numpy(float).reshape(m.shape), brute_d2(m))
    tops = fields.plateaus(field, ["k"]).toPandas()
    off, wide = 1 << 30, 1 << 31
    for k, m in MASKS.items():
        g = tops[tops["k"] == k]
        found = {(r.y, r.x): ((r.region // wide - off, r.region % wide - off), r.area) for r in g.itertuples()}
        assert found == brute_maxima(brute_d2(m))
    assert {"sparse", "dense", "lines"} <= set(tops["k"])


def test_spacing_in_three_axes_and_gaps(spark):
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(-6, 7, (250, 3)), axis=0)
    on = rng.random(len(cells)) < 0.1
    df = spark.createDataFrame(pd.DataFrame({"z": cells[:, 0], "y": cells[:, 1], "x": cells[:, 2], "on": on}))
    got = fields.distance_field(df, [], ("z", "y", "x"), "on", (2.5, 1.0, 0.5), full=False).toPandas().sort_values(["z", "y", "x"])
    scaled = cells * np.array([2.5, 1.0, 0.5])
    want = ((scaled[:, None] - scaled[on][None]) ** 2).sum(-1).min(1)
    np.testing.assert_allclose(got["d2"].to_numpy(), want)


def test_regions_touch_by_corners_and_empty_tables_stay_empty(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("a", 1, 1), ("a", 3, 3), ("b", 0, 1), ("b", 0, 0)], "k string, y int, x int")
    rows = fields.regions(cells, ["k"]).collect()
    assert sorted((r["k"], r["y"], r["x"], r["area"]) for r in rows) == [("a", 0, 0, 2), ("a", 1, 1, 2), ("a", 3, 3, 1), ("b", 0, 0, 2), ("b", 0, 1, 2)]
    empty = spark.createDataFrame([], "k string, y int, x int, on boolean")
    assert fields.classified(empty, ["k"]).count() == 0


def test_classes_follow_the_three_steps(spark):
    got = fields.classified(image_of(spark, MASKS), ["k"], vesicle_area=(1, 2), beyond=1.0, cell_area=3, near=1.5, far=3.0).toPandas()
    for k, m in MASKS.items():
        d2, tops = brute_d2(m), brute_maxima(brute_d2(m))
        for r in got[got["k"] == k].itertuples():
            c = (r.y, r.x)
            area = tops[c][1] if c in tops else 0
            cell = area >= 3 and d2[c] > 1
            kind = "membrane" if m[c] else "intracellular" if d2[c] <= 2.25 else "extracellular" if d2[c] > 9 else "unclassified"
            assert (r.membrane, r.vesicle, r.cell, r.outside, r.refined) == (m[c], 1 <= area <= 2, cell, not cell and not m[c], kind)
            assert r.distance == pytest.approx(np.sqrt(d2[c]), nan_ok=True)
    assert got["vesicle"].any() and got["cell"].any() and set(got["refined"]) == {"membrane", "intracellular", "extracellular", "unclassified"}
