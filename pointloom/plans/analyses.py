"""Whole analyses: vesicles, contact zones, curves with nulls, pooled tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import distance_class, finite, pop_std
from ..operators import curves, geometry, nulls, ripley, spatial, windows
from ..staging import staged


def vesicles(points: DataFrame, surface: DataFrame, keys: Sequence[str], segment: str, max_radius: float) -> DataFrame:
    """keys, vesicle, centre, radius, diameter, volume, sphericity, distance to the surface, class, flags.

    points: keys, segment, x, y, z; surface: keys, id, x, y, z. Spheres that a
    larger one overlaps are left out; the distance is the sphere's gap to the
    nearest surface point, 0 inside, NULL without a surface.
    """
    fits = geometry.sphere_fits(points, [*keys, segment]).filter("error is null")
    balls = staged(fits.select(*keys, F.col(segment).alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), F.col("radius").alias("r"), "diameter", "volume", "sphericity"), "spheres")
    kept = spatial.overlap_survivors(balls, max_radius, keys)
    near = spatial.nearest(balls.select(*keys, "id", "x", "y", "z"), surface, keys)
    d = near.select(*keys, F.col("a_id").alias("id"), F.col("d").alias("_c"))
    out = kept.join(d, [*keys, "id"], "left").withColumn("distance", F.greatest(F.col("_c") - F.col("r"), F.lit(0.0))).drop("_c")
    c = distance_class("distance")
    return out.withColumn("distance_class", c).withColumn("is_fusing", c == "fusing").withColumn("is_close", c.isin("fusing", "close"))


def vesicle_summary(v: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, total volume and population figures of diameters, distances and sphericity."""
    agg = [F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")]
    for c in ("diameter", "distance", "sphericity"):
        agg += [F.avg(finite(c)).alias(f"{c}_mean"), pop_std(c).alias(f"{c}_sd"), F.min(finite(c)).alias(f"{c}_min"), F.max(finite(c)).alias(f"{c}_max")]
    agg += [F.count_if(F.col("distance_class") == k).alias(f"n_{k}") for k in ("fusing", "close", "far", "unknown")]
    return v.groupBy(*keys).agg(*agg)


def families(a: DataFrame, b: DataFrame, volume: DataFrame, step: float, r_max: float, keys: Sequence[str], width: int) -> DataFrame:
    """K, L and g of both directions and of their combination, in long form: keys, family, r, value."""
    k = staged(ripley.symmetric(a, b, volume, step, r_max, keys), "families")
    out = None
    for s in ("12", "21", "_combined"):
        for f in ("k", "l"):
            part = k.select(*keys, F.lit(f"{f}{s}").alias("family"), "r", F.col(f"{f}{s}").alias("value"))
            out = part if out is None else out.unionByName(part)
        g = ripley.pair_correlation(k, keys, width, step, f"k{s}", "value")
        out = out.unionByName(g.select(*keys, F.lit(f"g{s}").alias("family"), "r", "value"))
    return out


def two_kinds(points: DataFrame, volume: DataFrame, factors: DataFrame, step: float, r_max: float, replicates: int, key: str = "zone", least: int = 1000, ranges=nulls.R_RANGES) -> tuple[DataFrame, DataFrame]:
    """Observed and null curves of K12, K21 and their combination (zone, null, curve, rep, r, k, value = L; rep -1 is observed), and the global tests of L over radius windows.

    points: zone, id, kind (0 or 1), x, y, z, all inside their zone's window,
    whose volume and edge factors (zone, id, bin, p) are given. Zones need two
    points of each kind. Nulls are random labels and segregated labels; points
    meet once for both.
    """
    slim = points.select(key, "id", "x", "y", "z")
    first = points.filter("kind = 0").groupBy(key).agg(F.count(F.lit(1)).alias("n1"))
    n = points.groupBy(key).agg(F.count_if(F.col("kind") == 0).alias("c1"), F.count_if(F.col("kind") == 1).alias("c2")).filter("c1 >= 2 and c2 >= 2").join(volume, key)
    models = {"labels": nulls.permuted_bits(slim, replicates, [key], first), "segregated": nulls.segregated_bits(slim, replicates, first, key)}
    own = nulls.packed(points.select(key, F.lit(-1).alias("rep"), "id", (F.col("kind") == 0).alias("is_first")), [key])
    # the models' words lie one after the other, so that points meet once
    span = nulls.WORD * (replicates // nulls.WORD + 1)
    words, names = None, F.array(*[F.lit(name) for name in models])
    for i, labels in enumerate(models.values()):
        part = labels.unionByName(own).groupBy(key, "id", F.col("block") + i * span // nulls.WORD).agg(F.bit_or("ones").alias("ones"), F.bit_or("twos").alias("twos"))
        part = part.toDF(key, "id", "block", "ones", "twos")
        words = part if words is None else words.unionByName(part)
    sums = nulls.permuted_sums(slim, staged(words, "labels"), factors, step, r_max, [key])
    sums = sums.withColumn("null", F.get(names, F.floor((F.col("rep") + 1) / span).cast("int"))).withColumn("rep", F.pmod(F.col("rep") + 1, F.lit(span)) - 1)
    grid = n.withColumn("null", F.explode(names)).withColumn("rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("bin", F.explode(ripley.radius_grid(step, r_max)))
    full = grid.join(sums, [key, "null", "rep", "bin"], "left").withColumn("r", F.col("bin") * F.lit(float(step)))
    scale = F.col("volume") / (F.col("c1") * F.col("c2"))
    full = full.withColumn("k12", scale * F.coalesce("s12", F.lit(0.0))).withColumn("k21", scale * F.coalesce("s21", F.lit(0.0)))
    full = full.withColumn("k_combined", ripley.combined(F.col("c1"), F.col("k12"), F.col("c2"), F.col("k21")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("curve"), F.col(f"k{s}").alias("k")) for c, s in (("12", "12"), ("21", "21"), ("combined", "_combined"))])).alias("_c")
    both = full.select(key, "null", "rep", "r", each).select(key, "null", "_c.curve", "rep", "r", "_c.k")
    both = staged(both.withColumn("value", ripley.l_of_k(F.col("k"), F.col("r"))), "curves")
    tests = nulls.mad_over_ranges(both.filter("rep = -1").drop("rep", "k"), both.filter("rep >= 0").drop("k"), [key, "null", "curve"], ranges, least=least)
    return both, tests


def envelope_table(observed_and_null: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, r, observed and the null's mean, deviation and percentile band."""
    obs = observed_and_null.filter("rep = -1").select(*by, "r", F.col("value").alias("observed"))
    null = observed_and_null.filter("rep >= 0")
    band = curves.percentile_band(null, [*by, "r"], "value")
    sd = null.groupBy(*by, "r").agg(F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return obs.join(band, [*by, "r"]).join(sd, [*by, "r"])


def around_centre(points: DataFrame, centres: DataFrame, volume: DataFrame, step: float, r_max: float, width: int, keys: Sequence[str], least: int = 3) -> DataFrame:
    """keys, r, k, l, g of the particles around one centre for each key; keys with fewer particles are left out."""
    enough = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
    k = ripley.cross_k(centres.withColumn("id", F.lit(0).cast("long")), points.join(enough, list(keys), "left_semi"), volume, step, r_max, keys)
    k = k.withColumn("l", ripley.l_of_k(F.col("k"), F.col("r")))
    g = ripley.pair_correlation(k, keys, width, step).select(*keys, "bin", "g")
    return k.join(g, [*keys, "bin"], "left").select(*keys, "bin", "r", "k", "l", "g")


def compared(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, n, mean absolute error, bias and correlation of two methods' values, and mean and deviation of each."""
    j = a.select(*on, *by, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), list(on))
    d = F.col("x") - F.col("y")
    out = [F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.corr("x", "y").alias("r")]
    out += [f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return j.groupBy(*by).agg(*out)


def permuted_sites(sites: DataFrame, particles: DataFrame, surface: DataFrame, replicates: int, key: str = "zone") -> DataFrame:
    """zone, rep, id, own, x, y, z: in each replicate as many points of sites and particles together are sites as there are sites.

    A particle that becomes a site moves to its nearest surface point, if
    there is a surface; a site that stays one keeps its place. Zones need a
    site and a particle. Ids of sites and particles are numbered apart.
    """
    n1 = sites.groupBy(key).agg(F.count(F.lit(1)).alias("n1"))
    tag = lambda df, own: df.select(key, (F.col("id") * 2 + (0 if own else 1)).alias("id"), "x", "y", "z").withColumn("own", F.lit(own))
    pool = tag(sites, True).unionByName(tag(particles.join(n1.select(key), key, "left_semi"), False))
    pool = pool.join(particles.select(key).distinct(), key, "left_semi")
    snap = spatial.nearest(pool.filter("not own"), surface, [key], payload=["x", "y", "z"]).select(key, F.col("a_id").alias("id"), *[F.col(f"b_{k}").alias(f"s{k}") for k in "xyz"])
    placed = pool.join(snap, [key, "id"], "left").select(key, "id", "own", *[F.coalesce(f"s{k}", k).alias(k) for k in "xyz"])
    chosen = nulls.permuted_labels(pool, replicates, [key], n1).filter("is_first").select(key, "rep", "id")
    return chosen.hint("merge").join(placed, [key, "id"]).select(key, "rep", "id", "own", "x", "y", "z")


def site_curves(sets: DataFrame, particles: DataFrame, volume: DataFrame, window: DataFrame, h: float, step: float, r_max: float, key: str = "zone") -> DataFrame:
    """zone, comparison, rep, n_sites, r, k, l: K of the particles around each set of sites, with edge factors over the grid of the window's box.

    sets: zone, comparison, rep, id, x, y, z. A set's curve is V / (n1 n2)
    times the sum over its sites of counts over edge factors. window: points
    whose box is the window.
    """
    # sites of many sets lie on the same places, so a place's counts over factors serve them all
    at = sets.select(key, "comparison", "rep", F.struct("x", "y", "z").alias("id"))
    places = staged(at.select(key, "id").distinct().select(key, "id", "id.*"), "places")
    factors = ripley.box_edge_factors(places, window, h, step, r_max, [key]).select(key, "id", "bin", "p")
    held = factors.join(ripley.focus_arrays(places, particles, step, r_max, [key]), [key, "id"], "left")
    w = F.coalesce(F.get("counts", F.col("bin") - 1), F.lit(0)) / F.col("p")
    held = held.groupBy(key, "id").agg(F.array_sort(F.collect_list(F.struct("bin", w.alias("w")))).alias("_w"))  # a row for each radius
    n_bins = int(r_max / step + 0.5)
    met = at.hint("merge").join(held, [key, "id"]).groupBy(key, "comparison", "rep").agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(F.get("_w", F.lit(i))["w"]).alias(f"_{i}") for i in range(n_bins)])
    each = F.posexplode(F.array(*[f"_{i}" for i in range(n_bins)])).alias("_b", "w")
    sums = met.select(key, "comparison", "rep", "n_sites", each).withColumn("bin", F.col("_b") + 1).withColumn("r", F.col("bin") * F.lit(float(step))).drop("_b")
    n2 = particles.groupBy(key).agg(F.count(F.lit(1)).alias("n2"))
    out = sums.join(n2, key).join(volume, key).withColumn("k", F.col("volume") / (F.col("n_sites") * F.col("n2")) * F.col("w"))
    return out.select(key, "comparison", "rep", "n_sites", "bin", "r", "k", ripley.l_of_k(F.col("k"), F.col("r")).alias("l"))


def fusion_sets(fusing: DataFrame, close: DataFrame, particles: DataFrame, surface: DataFrame, replicates: int = 100, shift: float = 40.0, key: str = "zone", **how) -> DataFrame:
    """zone, comparison, rep, id, x, y, z: fusing sites (observed) and close ones, both rep -1, tangential shifts and permuted labels."""
    one = lambda df, name: df.select(key, F.lit(name).alias("comparison"), F.lit(-1).alias("rep"), "id", "x", "y", "z")
    moved = nulls.shifted_sites(fusing, surface, replicates, shift, key, **how)
    swapped = permuted_sites(fusing, particles, surface, replicates, key)
    reps = lambda df, name: df.select(key, F.lit(name).alias("comparison"), "rep", "id", "x", "y", "z")
    return staged(one(fusing, "observed").unionByName(one(close, "close")).unionByName(reps(moved, "shift")).unionByName(reps(swapped, "labels")), "sets")


def fusion_sites(fusing: DataFrame, close: DataFrame, particles: DataFrame, surface: DataFrame, volume: DataFrame, window: DataFrame, h: float, step: float, r_max: float, replicates: int = 100, shift: float = 40.0, key: str = "zone", **how) -> DataFrame:
    """site_curves of the fusing sites (observed), of close ones, of tangential shifts and of permuted labels, each replicate a curve; rep is -1 for the first two."""
    sets = fusion_sets(fusing, close, particles, surface, replicates, shift, key, **how)
    return site_curves(sets, particles, volume, window, h, step, r_max, key)


def fusion_table(curve: DataFrame, key: str = "zone", value: str = "l") -> DataFrame:
    """zone, r, comparison, observed and the comparison's mean, deviation, percentile band and number of curves."""
    obs = curve.filter("comparison = 'observed'").select(key, "r", F.col(value).alias("observed"))
    rest = curve.filter("comparison <> 'observed'")
    band = curves.percentile_band(rest, [key, "comparison", "r"], value)
    sd = rest.groupBy(key, "comparison", "r").agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return band.join(sd, [key, "comparison", "r"]).join(obs, [key, "r"], "left")


def density_controls(sites: DataFrame, particles: DataFrame, surface: DataFrame, radii: Sequence[float], offsets: Sequence[float], directions: int = 100, key: str = "zone", length: float = 50.0, samples: int = 100, **how) -> DataFrame:
    """zone, id, radius, offset, real, control, n_controls: the particle density at each site, and its mean over controls moved by each offset.

    The density of a place is that of the line through its nearest surface
    point, by sliding cylinders of each radius; surface has normals. A site
    without a control at an offset has no row there.
    """
    scan = None
    for r in radii:
        part = spatial.cylinder_counts(surface, particles, float(r), [key], length, samples).select(key, F.col("id").alias("_at"), F.lit(float(r)).alias("radius"), "density")
        scan = part if scan is None else scan.unionByName(part)
    scan = staged(scan, "scan")
    # a place's surface point serves all radii; a control lies on one, so its densities are met where it is moved
    real = spatial.nearest(sites, surface, [key]).select(key, F.col("a_id").alias("id"), F.col("b_id").alias("_at"))
    real = real.join(scan, [key, "_at"]).select(key, "id", "radius", F.col("density").alias("real"))
    held = scan.groupBy(key, F.col("_at").alias("id")).agg(*[F.max(F.when(F.col("radius") == float(r), F.col("density"))).alias(f"_d{i}") for i, r in enumerate(radii)])
    held = staged(surface.join(held, [key, "id"]).select(key, "id", "x", "y", "z", F.array(*[f"_d{i}" for i in range(len(radii))]).alias("densities")), "densities")
    control = None
    for o in offsets:
        part = nulls.shifted_means(sites, held, "densities", directions, float(o), key, **how).withColumn("offset", F.lit(float(o)))
        control = part if control is None else control.unionByName(part)
    control = control.select(key, "id", "offset", F.col("n").alias("n_controls"), F.explode(F.arrays_zip(F.array(*[F.lit(float(r)) for r in radii]).alias("radius"), F.col("means").alias("control"))).alias("_c"))
    control = control.select(key, "id", "offset", "n_controls", "_c.radius", "_c.control")
    return real.join(control, [key, "id", "radius"]).select(key, "id", "radius", "offset", "real", "control", "n_controls")


def density_control_table(controls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, radius, offset and the bands of real minus control over the sites."""
    return curves.mean_bands(controls.withColumn("delta", F.col("real") - F.col("control")), [*by, "radius", "offset"], "delta")


def window_of(points: DataFrame, h: float, keys: Sequence[str], pre: DataFrame | None = None, post: DataFrame | None = None, limit: float = 50.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The window of each key: planes of the points' hull, tiles (with surfaces, of what lies between them too), and volumes."""
    planes = staged(geometry.hull_planes(points.select(*keys, "x", "y", "z"), keys), "planes")
    tiles = staged(windows.tiles(points, planes, h, keys, pre, post, limit), "window")
    return planes, tiles, windows.volumes(tiles, h, keys)


def _long(k: DataFrame, by: Sequence[str], step: float, width: int, unsure: dict[str, DataFrame]) -> DataFrame:
    """by, family, r, value from k12, k21 and k_combined (by, bin, r): K, L and g, where g is null in shells with too few lattice points."""
    k = staged(k, "families")
    out = None
    for s in ("12", "21", "_combined"):
        for f, v in (("k", F.col(f"k{s}")), ("l", ripley.l_of_k(F.col(f"k{s}"), F.col("r")))):
            part = k.select(*by, F.lit(f"{f}{s}").alias("family"), "r", v.alias("value"))
            out = part if out is None else out.unionByName(part)
        g = ripley.pair_correlation(k, by, width, step, f"k{s}", "value")
        for side, shells in unsure.items():
            if s in (side, "_combined"):
                on = [*[c for c in by if c in shells.columns], "bin"]
                g = g.join(shells.select(*on, F.col("reliable").alias("_r")), on, "left").withColumn("value", F.when(F.col("_r"), F.col("value"))).drop("_r")
        out = out.unionByName(g.select(*by, F.lit(f"g{s}").alias("family"), "r", "value"))
    return out


def _weighted(shares: DataFrame) -> DataFrame:
    """shares with the inverse factors as w."""
    return shares.withColumn("w", F.transform("p", lambda p: 1.0 / p)).drop("in_grid", "p")


def _curves(base: DataFrame, sums: DataFrame, by: Sequence[str], n1: str, n2: str, step: float, r_max: float) -> DataFrame:
    """base (by, n1, n2, volume) at all radii, with k12, k21 and k_combined of the sums (by, bin, w12, w21)."""
    grid = base.withColumn("bin", F.explode(ripley.radius_grid(step, r_max))).join(sums, [*by, "bin"], "left")
    k, scale = grid.withColumn("r", F.col("bin") * F.lit(float(step))), F.col("volume") / (F.col(n1) * F.col(n2))
    for s in ("12", "21"):
        k = k.withColumn(f"k{s}", scale * F.coalesce(f"w{s}", F.lit(0.0)))
    return k.withColumn("k_combined", ripley.combined(F.col(n1), F.col("k12"), F.col(n2), F.col("k21")))


def families_in_window(a: DataFrame, b: DataFrame, planes: DataFrame, tiles: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], width: int = 1, least_a: int = 2, least_b: int = 2, drop_a: bool = True) -> DataFrame:
    """keys, family, r, value: K, L and g of both directions and their combination, within the window and with its edge factors.

    Points outside the hull are dropped first (of a, only if drop_a); keys
    with fewer points than `least` of either then have no curve. Volumes are
    those of the tiles, so at radii that hold the whole window K is that of a
    random pattern. A g is null where the foci's shells have under 8 lattice
    points, the combined one where either is.
    """
    keys = list(keys)
    sides = [("12", windows.members(a, planes, keys) if drop_a else a, least_a), ("21", windows.members(b, planes, keys), least_b)]
    enough = None
    for _, side, least in sides:
        n = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(*keys)
        enough = n if enough is None else enough.join(n, keys)
    enough, volume = staged(enough, "enough"), windows.volumes(tiles, h, keys)
    kept = {s: staged(side.select(*keys, "id", "x", "y", "z").join(enough, keys, "left_semi"), f"side{s}") for s, side, _ in sides}
    held, unsure = {}, {}
    for s in ("12", "21"):
        held[s] = staged(windows.shares(kept[s], tiles, h, step, r_max, keys), "factors")
        unsure[s] = ripley.shell_reliability(windows.by_radius(held[s], step, keys), keys, width)
    n12, n21 = (kept[s].groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{s}")) for s in ("12", "21"))
    sums = ripley.pair_sums(_weighted(held["12"]), _weighted(held["21"]), step, r_max, keys)
    k = _curves(n12.join(n21, keys).join(volume, keys), sums, keys, "n12", "n21", step, r_max)
    return _long(k, keys, step, width, unsure)


def around_centre_in_window(points: DataFrame, centres: DataFrame, planes: DataFrame, tiles: DataFrame, h: float, step: float, r_max: float, keys: Sequence[str], width: int = 1, least: int = 3) -> DataFrame:
    """families_in_window of one centre for each key (direction 12) and the particles inside its hull; keys with fewer than `least` are left out."""
    return families_in_window(centres.withColumn("id", F.lit(0).cast("long")), points, planes, tiles, h, step, r_max, keys, width, 1, least, drop_a=False)


def two_kinds_in_window(points: DataFrame, planes: DataFrame, tiles: DataFrame, h: float, step: float, r_max: float, replicates: int, key: str = "zone", **how) -> tuple[DataFrame, DataFrame]:
    """two_kinds of the points inside the hull, with the window's volume and edge factors."""
    inside = staged(windows.members(points, planes, [key]), "inside")
    p = staged(windows.factors(inside, tiles, h, step, r_max, [key]), "factors")
    return two_kinds(inside, windows.volumes(tiles, h, [key]), p, step, r_max, replicates, key, **how)


def sets_in_window(sets: DataFrame, particles: DataFrame, planes: DataFrame, tiles: DataFrame, h: float, step: float, r_max: float, key: str = "zone", width: int = 1) -> DataFrame:
    """zone, comparison, rep, n_sites, n_particles, family, r, value of each set of sites against the particles inside the hull, both directions.

    sets: zone, comparison, rep, id, x, y, z; all sites of a set are pooled.
    Pairs are met once for both directions and all sets.
    """
    by = [key, "comparison", "rep"]
    sites = staged(sets.select(*by, F.struct("comparison", "rep", "id").alias("id"), "x", "y", "z"), "sites")
    inside = staged(windows.members(particles, planes, [key]).select(key, "id", "x", "y", "z"), "inside")
    volume = windows.volumes(tiles, h, [key])
    n2 = inside.groupBy(key).agg(F.count(F.lit(1)).alias("n_particles"))
    n1 = sites.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sites"))
    base = staged(n1.join(n2, key).join(volume, key).withColumn("set", F.monotonically_increasing_id()), "sizes")
    p1 = staged(windows.shares(sites.drop("comparison", "rep"), tiles, h, step, r_max, [key]), "site_factors")
    p2 = staged(windows.shares(inside, tiles, h, step, r_max, [key]), "particle_factors")
    named = p1.select("*", F.col("id.comparison").alias("comparison"), F.col("id.rep").alias("rep"))
    sums = ripley.pair_sums(_weighted(named).join(base.select(*by, "set"), by), _weighted(p2), step, r_max, [key], "set")
    k = _curves(base, sums.join(base.select(key, "set", "comparison", "rep"), [key, "set"]).drop("set"), by, "n_sites", "n_particles", step, r_max)
    shells = windows.by_radius(named, step, [*by], "id")
    unsure = {"12": ripley.shell_reliability(shells, by, width), "21": ripley.shell_reliability(windows.by_radius(p2, step, [key]), [key], width)}
    return _long(k, [*by, "n_sites", "n_particles"], step, width, unsure)


def fusion_sites_in_window(fusing: DataFrame, close: DataFrame, particles: DataFrame, surface: DataFrame, planes: DataFrame, tiles: DataFrame, h: float, step: float, r_max: float, replicates: int = 100, shift: float = 40.0, key: str = "zone", least: int = 100, ranges=nulls.R_RANGES, **how) -> tuple[DataFrame, DataFrame]:
    """sets_in_window of fusing sites, close ones, shifted ones and permuted labels, and the global tests of each L family against the shifts and the labels."""
    sets = fusion_sets(fusing, close, particles, surface, replicates, shift, key, **how)
    curve = staged(sets_in_window(sets, particles, planes, tiles, h, step, r_max, key), "site_families")
    rows = curve.filter(F.col("family").startswith("l")).select(key, "comparison", "rep", F.col("family").alias("curve"), "r", "value")
    null = rows.filter(F.col("comparison").isin("shift", "labels")).withColumnRenamed("comparison", "null")
    seen = rows.filter("comparison = 'observed'").drop("comparison", "rep").join(null.select(key, "null").distinct(), key)
    return curve, nulls.mad_over_ranges(seen, null, [key, "null", "curve"], ranges, least=least)
