"""Null models and tests over curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import Draws, Near
from ..functions.numeric import finite
from ..staging import staged


def scramble(id_: Column, rep: Column) -> Column:
    """A text that orders ids anew for each replicate: the hash of both, which any engine repeats."""
    return F.md5(F.concat_ws(":", rep.cast("string"), id_.cast("string")))


#: Replicates in a word of labels.
WORD = 64


def permuted_bits(points: DataFrame, replicates: int, keys: Sequence[str], first: DataFrame, id_col: str = "id") -> DataFrame:
    """keys, id, block, ones, twos: permuted_labels as bits; bit i of a block is replicate 64 block + i - 1.

    A task orders the ids of a key for one word of replicates, so no row is
    made for a point in a replicate.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    blocks = F.explode(F.sequence(F.lit(0), F.lit(replicates // WORD)))
    # names of its own, so that ids of any type are hashed as Spark writes them
    ids = points.select(*keys, F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("_text")).join(first.select(*keys, "n1"), list(keys)).withColumn("block", blocks)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ids.select(*keys, "id").schema]

    def run(table: pa.Table) -> pa.Table:
        block, n1 = table["block"][0].as_py(), table["n1"][0].as_py() or 0
        tails = [b"" if t is None else f":{t}".encode() for t in table["_text"].to_pylist()]
        ones, known = np.zeros(len(tails), np.uint64), 0
        for i in range(WORD):
            rep = block * WORD + i - 1
            if not 0 <= rep < replicates:
                continue
            known |= 1 << i
            head = str(rep).encode()
            code = np.frombuffer(b"".join([hashlib.md5(head + t).digest() for t in tails]), ">u8").reshape(-1, 2).astype(np.uint64)
            if n1 >= len(code):
                taken = np.ones(len(code), bool)
            elif n1 <= 0:
                continue
            else:
                last = np.partition(code[:, 0], n1 - 1)[n1 - 1]
                taken, tied = code[:, 0] < last, np.flatnonzero(code[:, 0] == last)
                by_id = sorted(tied.tolist(), key=lambda j: (int(code[j, 1]), table["id"][j].as_py())) if len(tied) > 1 else tied  # noqa: B023
                taken[by_id[: n1 - int(taken.sum())]] = True
            ones |= taken.astype(np.uint64) << np.uint64(i)
        twos = ~ones & np.uint64(known)
        cols = [*[table[c] for c in [*keys, "id", "block"]], pa.array(ones.view(np.int64)), pa.array(twos.view(np.int64))]
        return pa.table(cols, names=[*keys, "id", "block", "ones", "twos"])

    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = ids.repartition(parts, *keys, "block")  # small rows, long work
    return ids.groupBy(*keys, "block").applyInArrow(run, ", ".join([*kinds, "block int, ones long, twos long"]))


def permuted_labels(points: DataFrame, replicates: int, keys: Sequence[str], first: DataFrame, id_col: str = "id") -> DataFrame:
    """keys, rep, id, is_first: in each replicate just n1 points of the pool are of the first kind.

    first: keys, n1. The order depends on the ids and the replicate only.
    """
    return _rows(permuted_bits(points, replicates, keys, first, id_col), keys, id_col)


def _rows(bits: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """keys, rep, id, is_first of labels in bits."""
    each = bits.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).withColumn("rep", F.col("block") * WORD + F.col("_i") - 1)
    at = lambda c: F.expr(f"(shiftrightunsigned({c}, _i) & 1) = 1")
    return each.filter(at("ones") | at("twos")).select(*keys, "rep", F.col("id").alias(id_col), at("ones").alias("is_first"))


def packed(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, id, block, ones, twos of labels in rows (keys, rep from -1, id, is_first), as permuted_bits has them."""
    bit = F.expr(f"shiftleft(1L, pmod(rep + 1, {WORD}))")
    own = labels.select(*keys, "id", F.floor((F.col("rep") + 1) / WORD).cast("int").alias("block"), F.when(F.col("is_first"), bit).otherwise(F.lit(0).cast("long")).alias("ones"), F.when(~F.col("is_first"), bit).otherwise(F.lit(0).cast("long")).alias("twos"))
    return own.groupBy(*keys, "id", "block").agg(F.bit_or("ones").alias("ones"), F.bit_or("twos").alias("twos"))


#: Points of a chunk, those a cell should hold at least on average, and rows of a product.
CHUNK, FILL, ROWS = 2048, 512, 512
#: Counts of two shells in one float: digits of this base, of which a float holds two.
DIGIT = 4096


def _met(points: DataFrame, labels: DataFrame, r: float, keys: list[str], run, schema: str, factors: DataFrame | None = None) -> DataFrame:
    """run over every two chunks of a key's points that can be within r, each pair of chunks once, with the points' labels and factors.

    Points lie in cells of side r or more, and a cell is dealt to chunks of
    CHUNK points, so a task holds two chunks, however dense a key is.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = labels if "block" in labels.columns else packed(labels, keys)
    words = F.sort_array(F.collect_list(F.struct("block", "ones", "twos")))  # one point's words
    held = labels.groupBy(*keys, "id").agg(words.alias("_w"))
    held = held.select(*keys, "id", *[F.col(f"_w.{c}").alias(c) for c in ("block", "ones", "twos")])
    at = points.select(*keys, "id", *[finite(k).alias(k) for k in "xyz"]).dropna(subset=list("xyz"))
    if factors is not None:
        p = factors.groupBy(*keys, "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "p"))), lambda x: x["p"]).alias("p"))  # one focus's radii
        held = held.join(p, [*keys, "id"])
    box = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[(F.max(k) - F.min(k) + F.lit(float(r))).alias(f"_s{k}") for k in "xyz"])
    side = F.greatest(F.lit(float(r)), F.cbrt(F.col("_sx") * F.col("_sy") * F.col("_sz") * FILL / F.col("_n")))
    cells = [f"_c{k}" for k in "xyz"]
    at = at.join(box.select(*keys, side.alias("_side")), keys).select(*keys, "id", *"xyz", *[F.floor(F.col(k) / F.col("_side")).alias(f"_c{k}") for k in "xyz"])
    sizes = at.groupBy(*keys, *cells).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_k"))
    dealt = at.join(sizes, [*keys, *cells]).withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_k"))).withColumn("_chunk", F.concat_ws(",", *cells, "_sub"))
    dealt = staged(dealt.join(held, [*keys, "id"]).drop("_k", "_sub"), "dealt")
    chunks = dealt.select(*keys, *cells, "_chunk").distinct()
    around = chunks.withColumnRenamed("_chunk", "_a")
    for c in cells:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    pairs = around.join(chunks.withColumnRenamed("_chunk", "_b"), [*keys, *cells]).filter("_a <= _b").select(*keys, "_a", "_b")
    slim, on = dealt.drop(*cells), [*keys, "_a", "_b"]
    sides = [slim.withColumnRenamed("_chunk", s).join(pairs, [*keys, s]).select(*on, *[c for c in slim.columns if c not in (*keys, "_chunk")]) for s in ("_a", "_b")]
    # names of its own for each side, so that the sides do not share columns
    left, right = (s.select(*[F.col(c).alias(c) for c in s.columns]).repartition(parts, *on) for s in sides)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys).schema]

    def both(key: tuple, a, b):
        import pyarrow as pa

        types = {"int": pa.int32(), "smallint": pa.int16(), "long": pa.int64(), "double": pa.float64()}
        got = run(_Chunk(a), _Chunk(b), key[len(keys)].as_py() == key[len(keys) + 1].as_py()) if len(a) and len(b) else {}
        n = len(next(iter(got.values()), ()))
        out = {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key, strict=False)}
        return pa.table({**out, **{c: pa.array(got.get(c, []), types[t]) for c, t in (f.split() for f in schema.split(", "))}})

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(both, ", ".join([*kinds, schema]))


class _Chunk:
    """Coordinates, ids, labels (points x replicates, from -1) and weights of a chunk's points."""

    def __init__(self, table):
        import numpy as np

        self.ids = table["id"].to_numpy()
        self.x = [table[k].to_numpy() for k in "xyz"]
        lists = [table[c].combine_chunks() for c in ("block", "ones", "twos")]
        block, *words = [c.flatten().to_numpy(zero_copy_only=False) for c in lists]
        row = np.repeat(np.arange(len(self.ids)), np.diff(lists[0].offsets.to_numpy()))
        self.ones, self.twos = (np.zeros((len(self.ids), block.max(initial=0) + 1), "<i8") for _ in words)
        for held, w in zip((self.ones, self.twos), words, strict=True):
            held[row, block] = w
        p = table["p"].combine_chunks() if "p" in table.column_names else None
        self.weight = None if p is None else 1.0 / p.flatten().to_numpy().reshape(len(self.ids), -1)

    def labels(self, words: int):
        """Ones and twos as floats, for so many words of replicates."""
        import numpy as np

        out = []
        for w in (self.ones, self.twos):
            wide = np.zeros((len(w), words), "<i8")
            wide[:, : w.shape[1]] = w
            out.append(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").astype(np.float32))
        return out


def _bins(a: _Chunk, b: _Chunk, rows: slice, step: float, r_max: float):
    """Distance bins (from 1) of some points of a and all of b; 0 beyond r_max and for a point with itself."""
    import numpy as np

    d = sum(((u[rows, None] - v[None]) ** 2 for u, v in zip(a.x, b.x, strict=True)), 0.0)
    d = np.sqrt(d, out=d)
    last = int(r_max / step + 0.5)
    out = np.floor(d / float(step)) + 1
    out[(d > r_max) | (out > last) | (a.ids[rows, None] == b.ids[None])] = 0
    return out.astype(np.int16)


def permuted_counts(points: DataFrame, labels: DataFrame, step: float, r_max: float, keys: Sequence[str]) -> DataFrame:
    """keys, rep, bin, n12: ordered pairs from the first kind to the second in each replicate, by distance bin.

    labels: rows (keys, rep from -1, id, is_first) or words as permuted_bits
    has them. Two chunks of points meet in a task, where distances are binned
    in arrays and the counts of all replicates are products of matrices; no
    row is made for a pair, nor for a point in a replicate. Where all points
    of both chunks have a label, one product serves both kinds.
    """
    import numpy as np

    keys = list(keys)

    def run(a: _Chunk, b: _Chunk, same: bool) -> dict:
        words = max(a.ones.shape[1], b.ones.shape[1])
        (a1, a2), (b1, b2) = a.labels(words), b.labels(words)
        last = int(r_max / step + 0.5)
        n = np.zeros((last, a1.shape[1]))
        whole = ((a1 + a2).min(0) == 1) & ((b1 + b2).min(0) == 1)
        some = np.flatnonzero(~whole & ((a1 + a2).max(0) > 0) & ((b1 + b2).max(0) > 0))
        full = np.flatnonzero(whole)
        a1f, a1s, a2s = a1[:, full], a1[:, some], a2[:, some]
        b1f, b1s, b2s = b1[:, full], b1[:, some], b2[:, some]
        for i in range(0, len(a.ids), ROWS):
            rows = slice(i, i + ROWS)
            bins = _bins(a, b, rows, step, r_max)
            for k in range(last):
                has = (bins == k + 1).astype(np.float32)
                if not has.any():
                    continue
                if len(full):
                    firsts, deg, one = has @ b1f, has.sum(1)[:, None], a1f[rows]
                    n[k, full] += (one * (deg - firsts)).sum(0, dtype=np.float64)
                    if not same:
                        n[k, full] += ((1 - one) * firsts).sum(0, dtype=np.float64)
                if len(some):
                    n[k, some] += (a1s[rows] * (has @ b2s)).sum(0, dtype=np.float64)
                    if not same:
                        n[k, some] += (a2s[rows] * (has @ b1s)).sum(0, dtype=np.float64)
        k, rep = np.nonzero(n)
        return {"rep": rep - 1, "bin": k + 1, "n": n[k, rep].astype(np.int64)}

    met = _met(points, labels, r_max, keys, run, "rep int, bin smallint, n long")
    return met.groupBy(*keys, "rep", "bin").agg(F.sum("n").alias("n12"))


def permuted_sums(points: DataFrame, labels: DataFrame, factors: DataFrame, step: float, r_max: float, keys: Sequence[str]) -> DataFrame:
    """keys, rep, bin, s12, s21: for each direction, the sum over foci of their partners within the radius, over the focus's edge factor.

    factors: keys, id, bin, p for every point. As permuted_counts, chunks of
    points meet once, and all replicates are products of matrices. One product
    counts two shells, as the digits of a number that a float holds exactly.
    """
    import numpy as np

    keys, last = list(keys), int(r_max / step + 0.5)

    def one_way(a: _Chunk, b: _Chunk, foci: tuple, partners: tuple, s12, s21) -> None:
        (f1, f2), (p1, p2) = foci, partners
        whole = [bool(((u + v).min(0) == (u + v).max(0)).all()) for u, v in (foci, partners)]  # all or none have a label
        known = [(u + v).max(0)[None].astype(np.float64) for u, v in (foci, partners)]
        ends = range(0, len(b.ids), DIGIT - 1)
        for i in range(0, len(a.ids), ROWS):
            rows = slice(i, i + ROWS)
            bins, w = _bins(a, b, rows, step, r_max), a.weight[rows]
            sums = [np.zeros((len(w), p1.shape[1]), np.float32) for _ in range(1 if whole[1] else 2)]
            degree, first = np.zeros(len(w)), f1[rows].astype(np.float64)
            for k in range(0, last, 2):
                low, high = bins == k + 1, bins == k + 2
                both = low + high * np.float32(DIGIT)
                upper = []
                for p, held in zip((p1, p2), sums, strict=False):
                    upper.append(np.zeros_like(held))
                    for j in ends:
                        n = both[:, j : j + DIGIT - 1] @ p[j : j + DIGIT - 1]
                        digit = np.floor(n * np.float32(1 / DIGIT))
                        upper[-1] += digit
                        held += n - digit * np.float32(DIGIT)
                for at, near in ((k, low), (k + 1, high)):
                    if at >= last:
                        break
                    if at > k:
                        for held, more in zip(sums, upper, strict=True):
                            held += more
                    degree += near.sum(1)
                    ones, each = sums[0].astype(np.float64), w[:, at]
                    taken = each @ (first * ones)
                    s12[at] += (each * degree) @ first * known[1][0] - taken if whole[1] else each @ (first * sums[1])
                    s21[at] += each @ ones * known[0][0] - taken if whole[0] else each @ (f2[rows] * ones)

    def run(a: _Chunk, b: _Chunk, same: bool) -> dict:
        words = max(a.ones.shape[1], b.ones.shape[1])
        of_a, of_b = a.labels(words), b.labels(words)
        s12, s21 = np.zeros((last, of_a[0].shape[1])), np.zeros((last, of_a[0].shape[1]))
        one_way(a, b, of_a, of_b, s12, s21)
        if not same:
            one_way(b, a, of_b, of_a, s12, s21)
        k, rep = np.nonzero((s12 > 0) | (s21 > 0))
        return {"rep": rep - 1, "bin": k + 1, "s12": s12[k, rep], "s21": s21[k, rep]}

    met = _met(points, labels, r_max, keys, run, "rep int, bin int, s12 double, s21 double", factors)
    return met.groupBy(*keys, "rep", "bin").agg(F.sum("s12").alias("s12"), F.sum("s21").alias("s21"))


#: Radius windows of the global test: name, least and greatest radius.
R_RANGES = (("full", None, None), ("30-50nm", 30.0, 50.0))


def mad_test(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], confidence: float = 0.99, least: int = 1000, low: float | None = None, high: float | None = None) -> DataFrame:
    """keys, n_null, t_obs, t_crit, ratio, p, rejects, r_at_max, signed_diff, status: greatest absolute deviation from the mean of all curves.

    observed: keys, r, value; nulls: keys, rep, r, value. low and high bound
    the radii, both inclusive. With fewer than `least` null curves or a missing
    observed value the status says skipped and the figures are null.
    signed_diff is the deviation at the first radius where it is greatest.
    """
    k = list(keys)
    inside = F.lit(True) if low is None else F.col("r") >= F.lit(float(low))
    inside = inside if high is None else inside & (F.col("r") <= F.lit(float(high)))
    observed, nulls = observed.filter(inside), nulls.filter(inside)
    every = nulls.select(*k, "r", "value").union(observed.select(*k, "r", "value"))
    centre = every.groupBy(*k, "r").agg(F.avg("value").alias("mu"))
    t_null = nulls.join(centre, [*k, "r"]).groupBy(*k, "rep").agg(F.max(F.abs(F.col("value") - F.col("mu"))).alias("t"))
    off = F.col("value") - F.col("mu")
    obs = observed.join(centre, [*k, "r"]).groupBy(*k).agg(
        F.max(F.abs(off)).alias("t_obs"), F.max_by(F.struct("r", off.alias("d")), F.struct(F.abs(off), -F.col("r"))).alias("_at"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("_bad")
    )
    joined = t_null.join(obs, k) if k else t_null.crossJoin(obs)  # one observed row
    out = joined.groupBy(*k, "t_obs", "_at", "_bad").agg(F.count(F.lit(1)).alias("n_null"), F.percentile("t", F.lit(confidence)).alias("t_crit"), F.count_if(F.col("t") >= F.col("t_obs")).alias("_ge"))
    ok = (F.col("n_null") >= least) & (F.col("_bad") == 0)
    only = lambda c: F.when(ok, c)
    return out.select(
        *k, "n_null", only(F.col("t_obs")).alias("t_obs"), only(F.col("t_crit")).alias("t_crit"), only(F.when(F.col("t_crit") > 0, F.col("t_obs") / F.col("t_crit"))).alias("ratio"),
        only((F.col("_ge") + 1) / (F.col("n_null") + 1)).alias("p"), only(F.col("t_obs") > F.col("t_crit")).alias("rejects"),
        only(F.col("_at.r").cast("double")).alias("r_at_max"), only(F.col("_at.d")).alias("signed_diff"), F.when(ok, "ok").otherwise("skipped").alias("status"),
    )


def mad_over_ranges(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[str, float | None, float | None]] = R_RANGES, confidence: float = 0.99, least: int = 1000) -> DataFrame:
    """The global test for each radius window, with its name as r_range."""
    out = None
    for name, low, high in ranges:
        part = mad_test(observed, nulls, keys, confidence, least, low, high).withColumn("r_range", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def mad_curves(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], confidence: float = 0.99) -> DataFrame:
    """keys, r, observed, mean of all curves, the nulls' envelope lo and hi, and the deviation in units of the envelope's wider half."""
    k, tail = [*keys, "r"], (1.0 - confidence) / 2
    band = nulls.groupBy(*k).agg(F.percentile("value", F.lit(tail)).alias("lo"), F.percentile("value", F.lit(1.0 - tail)).alias("hi"), F.sum("value").alias("_s"), F.count("value").alias("_n"))
    both = observed.select(*k, F.col("value").alias("observed")).join(band, k)
    both = both.withColumn("mean", (F.col("_s") + F.col("observed")) / (F.col("_n") + 1))
    half = F.greatest(F.col("mean") - F.col("lo"), F.col("hi") - F.col("mean"), F.lit(1e-12))
    return both.select(*k, "observed", "mean", "lo", "hi", ((F.col("observed") - F.col("mean")) / half).alias("normalized"))


def monte_carlo_p(observed: DataFrame, nulls: DataFrame, by: Sequence[str], two_sided: bool = True) -> DataFrame:
    """by, p: (number of nulls at least as extreme + 1) / (n + 1). Columns: value in both."""
    size = F.abs if two_sided else (lambda c: c)
    both = nulls.select(*by, F.col("value").alias("v")).join(observed.select(*by, F.col("value").alias("o")), list(by))
    return both.groupBy(*by).agg(((F.count_if(size(F.col("v")) >= size(F.col("o"))) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def average_rank(value: Column, by: Sequence[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    ranked = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_rx", average_rank(F.col(x), by)).withColumn("_ry", average_rank(F.col(y), by))
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def kendall(df: DataFrame, by: Sequence[str], x: str, y: str, id_col: str) -> DataFrame:
    """tau-b over all pairs of a group, null where a column is constant; groups are samples, so pairs within them are few."""
    a = df.select(*by, F.col(id_col).alias("i"), F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = df.select(*by, F.col(id_col).alias("j"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    p = a.join(b, list(by)).filter("i < j")
    sx, sy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    return p.groupBy(*by).agg((F.try_divide(F.sum(sx * sy), F.sqrt(F.sum(F.abs(sx)) * F.sum(F.abs(sy))))).alias("tau"))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def wilcoxon_signed(df: DataFrame, by: Sequence[str], delta: str) -> DataFrame:
    """by, n, w_plus, z, p: signed-rank test by the normal approximation with ties; all zero gives p = 1, fewer than two NULL. samples.signed_rank is exact for small samples."""
    live = df.filter(F.col(delta).isNotNull())
    total = live.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    nz = live.filter(F.abs(delta) > 1e-12).withColumn("_a", F.abs(delta))
    nz = nz.withColumn("_r", average_rank(F.col("_a"), by)).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, "_a")))
    s = nz.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie"))
    mean = F.col("n") * (F.col("n") + 1) / 4.0
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("_tie") / 48.0
    z = F.try_divide(F.col("w_plus") - mean, F.sqrt(var))
    out = total.join(s, list(by), "left").withColumn("z", F.when(F.col("n") > 0, z))
    p = F.when(F.col("_all") < 2, None).when(F.col("n").isNull(), 1.0).otherwise(two_sided_p(F.col("z")))
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "w_plus", "z", p.alias("p"))


def two_sided_p(z: Column) -> Column:
    """2 (1 - Phi(|z|)) by a rational form of the error function, exact to 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return poly * F.exp(-x * x)


def mann_whitney(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """by, n1, n2, u, z, p by the normal approximation for the rows whose boolean group is true against the others; p is 1 with fewer than two on a side. samples.rank_sum is exact for small samples."""
    r = df.filter(F.col(value).isNotNull()).withColumn("_r", average_rank(F.col(value), by)).withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy(*by, value)))
    s = r.groupBy(*by).agg(
        F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n2"), F.sum(F.when(F.col(group), F.col("_r")).otherwise(0.0)).alias("_s"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_tie")
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2.0
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.coalesce(F.try_divide(F.col("_tie"), n * (n - 1)), F.lit(0.0)))
    z = F.try_divide(u - F.col("n1") * F.col("n2") / 2.0, F.sqrt(var))
    return s.select(*by, "n1", "n2", u.alias("u"), z.alias("z"), F.when(F.least("n1", "n2") < 2, 1.0).otherwise(F.coalesce(two_sided_p(z), F.lit(1.0))).alias("p"))


# sequential null models: one group is one zone and replicate, seeded by its numbers
def _seeded(*parts: int):
    import numpy as np

    return np.random.default_rng([int(p) & 0xFFFFFFFF for p in parts])


class _Growth:
    """A cluster of points grown by nearest neighbours from any point, over the shortest edges alone.

    Edges lie between distinct places: those with which Prim's steps reach all
    of them, and those as short as the longest step between their ends. Other
    edges are never the shortest way out of a cluster, so growing over these
    takes the same points in the same order, ties to the least id. Points are
    in the order of their ids; one that is not finite is near to none.
    """

    def __init__(self, place: Sequence[int], near: Sequence[Sequence[int]], gap: Sequence[Sequence[float]]):
        self.place, self.held = place, {}
        for i, p in enumerate(place):
            self.held.setdefault(p, []).append(i)
        # a place has the number of its first point, so a tie of gaps goes to the least id
        self.edges = {p: list(zip(gap[p], near[p], strict=True)) for p in self.held}

    @staticmethod
    def edges_of(x) -> tuple[list[int], list[list[int]], list[list[float]]]:
        """Place (the first point there), neighbours and squared gaps for each point (for a place's first alone) of x (n x 3)."""
        import numpy as np

        n = len(x)
        place, near, gap = np.arange(n), [[] for _ in range(n)], [[] for _ in range(n)]
        fine = np.flatnonzero(np.isfinite(x).all(1))
        if not len(fine):
            return place.tolist(), near, gap
        _, at, back = np.unique(x[fine] + 0.0, axis=0, return_index=True, return_inverse=True)
        place[fine] = fine[at[back.ravel()]]
        own = np.unique(place[fine])
        u, v, w = (np.ascontiguousarray(c) for c in x[own].T)
        inside = np.zeros(len(own), bool)
        out, longest = np.full(len(own), np.inf), np.full(len(own), -1.0)  # way to the tree; longest step since a place came in
        k, step = 0, -1.0
        for _ in range(len(own)):
            d = (u - u[k]) ** 2 + (v - v[k]) ** 2 + (w - w[k]) ** 2
            np.maximum(longest, step, out=longest, where=inside)
            for j in np.flatnonzero(inside & (d == longest)).tolist():
                a, b = int(own[k]), int(own[j])
                near[a].append(b)
                near[b].append(a)
                gap[a].append(float(d[j]))
                gap[b].append(float(d[j]))
            inside[k], out[k] = True, np.inf
            np.minimum(out, d, out=out, where=~inside)
            k = int(np.argmin(out))
            step = out[k]
        return place.tolist(), near, gap

    def grown(self, start: int, size: int) -> list[int]:
        """The first `size` points from start on."""
        import heapq

        taken, heap, seen, spare = [], [], set(), 0
        at = self.place[start]
        while len(taken) < size:
            seen.add(at)
            held = self.held[at]
            taken += held if len(held) == 1 else sorted(held, key=lambda i: (i != start, i))  # copies come at once
            for e in self.edges[at]:
                if e[1] not in seen:
                    heapq.heappush(heap, e)
            at = None
            while heap:
                p = heapq.heappop(heap)[1]
                if p not in seen:
                    at = p
                    break
            while at is None and len(taken) < size:  # what is left is near to none
                at = self.place[spare] if self.place[spare] not in seen else None
                spare += 1
        return taken[:size]


def segregated_bits(points: DataFrame, replicates: int, first: DataFrame, key: str = "zone", seed: int = 0, id_col: str = "id") -> DataFrame:
    """key, id, block, ones, twos: segregated_labels as bits, as permuted_bits has them.

    The edges over which clusters grow are found once for a key, in memory
    that grows with its points and time with their square; a replicate then
    passes along edges of its cluster alone.
    """
    import numpy as np
    import pyarrow as pa

    slim = points.select(key, F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).join(first.select(key, "n1"), key)
    kind = dict(points.dtypes)[key]

    def edges(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = np.column_stack([table[c].to_numpy() for c in "xyz"])
        place, near, gap = _Growth.edges_of(x)
        cols = [table[key], table["id"], table["n1"], pa.array(place, pa.int32()), pa.array(near, pa.list_(pa.int32())), pa.array(gap, pa.list_(pa.float64()))]
        return pa.table(cols, names=[key, "id", "n1", "place", "near", "gap"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        n, block = len(table), table["block"][0].as_py()
        n1 = min(n, table["n1"][0].as_py() or 0)
        growth = _Growth(*[table[c].to_pylist() for c in ("place", "near", "gap")])
        least, known, ones = table["id"][0].as_py(), 0, np.zeros(n, np.uint64)
        for i in range(WORD):
            rep = block * WORD + i - 1
            if not 0 <= rep < replicates:
                continue
            known |= 1 << i
            rng = _seeded(seed, rep, least, n)
            first_compact, at = bool(rng.integers(2)), int(rng.integers(n))
            compact = np.zeros(n, bool)
            compact[growth.grown(at, n1 if first_compact else n - n1)] = True
            ones |= (compact == first_compact).astype(np.uint64) << np.uint64(i)
        twos = ~ones & np.uint64(known)
        cols = [table[key], table["id"], table["block"], pa.array(ones.view(np.int64)), pa.array(twos.view(np.int64))]
        return pa.table(cols, names=[key, "id", "block", "ones", "twos"])

    n1_kind = dict(first.dtypes)["n1"]
    tied = slim.groupBy(key).applyInArrow(edges, f"{key} {kind}, id long, n1 {n1_kind}, place int, near array<int>, gap array<double>")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = tied.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(replicates // WORD)))).repartition(parts, key, "block")  # small rows, long work
    return tied.groupBy(key, "block").applyInArrow(run, f"{key} {kind}, id long, block int, ones long, twos long")


def segregated_labels(points: DataFrame, replicates: int, first: DataFrame, key: str = "zone", seed: int = 0, id_col: str = "id") -> DataFrame:
    """key, rep, id, is_first: one kind, chosen by a coin, is a cluster grown from a random point by its nearest neighbours.

    The next point is the one nearest to any in the cluster, ties to the least
    id; the cluster has as many points as its kind. first: key, n1. A point
    without finite coordinates comes after all others.
    """
    return _rows(segregated_bits(points, replicates, first, key, seed, id_col), [key], "id")


#: Sites of a task.
SITES = 512


def shifted_sites(sites: DataFrame, surface: DataFrame, replicates: int, step: float, key: str = "zone", seed: int = 0, reach: float = 30.0, snap_limit: float = 5.0, least: float = 5.0, tries: int = 40, id_col: str = "id") -> DataFrame:
    """key, id, rep, x, y, z: sites moved by `step` along the surface's tangent plane and snapped to it.

    The plane comes from surface points within reach (twice that with fewer
    than five). A move is taken if it snaps by no more than snap_limit and
    ends at least `least` away; a site without such a move in `tries` is
    absent. SITES sites of a cell meet the surface around the cell in a task;
    no row is made for a site and a surface point.
    """
    import pyarrow as pa

    def rows(ids, of, rep, at, surface: pa.Table) -> dict:
        return {"id": pa.array(ids[of]), "rep": pa.array(rep.astype("int32")), **{k: surface[k].take(pa.array(at)) for k in "xyz"}}

    return _shifted(sites, surface, replicates, step, key, seed, reach, snap_limit, least, tries, id_col, rows, "id long, rep int, x double, y double, z double")


def shifted_means(sites: DataFrame, surface: DataFrame, value: str, replicates: int, step: float, key: str = "zone", seed: int = 0, reach: float = 30.0, snap_limit: float = 5.0, least: float = 5.0, tries: int = 40, id_col: str = "id") -> DataFrame:
    """key, id, means, n: the mean of the surface's value (an array of doubles, as long in every row) over the points that shifted_sites moves a site to, without a row for each move."""
    import numpy as np
    import pyarrow as pa

    def rows(ids, of, rep, at, surface: pa.Table) -> dict:
        own, back, n = np.unique(of, return_inverse=True, return_counts=True)
        held = surface[value].combine_chunks()
        width = len(held.flatten()) // max(len(held), 1)
        values = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        sums = np.stack([np.bincount(back.ravel(), values[at, i], len(own)) for i in range(width)], 1) if width else np.zeros((len(own), 0))
        return {"id": pa.array(ids[own]), "means": pa.array((sums / n[:, None]).tolist(), pa.list_(pa.float64())), "n": pa.array(n.astype(np.int64))}

    return _shifted(sites, surface, replicates, step, key, seed, reach, snap_limit, least, tries, id_col, rows, "id long, means array<double>, n long", [value])


#: Moves that a task looks for together.
MOVES = 50_000


def _shifted(sites: DataFrame, surface: DataFrame, replicates: int, step: float, key: str, seed: int, reach: float, snap_limit: float, least: float, tries: int, id_col: str, rows, schema: str, carried: Sequence[str] = ()) -> DataFrame:
    """key and what `rows` makes of the moves of a task: ids of its sites, and for each move the site's number, the replicate and the row of the surface that it ends on."""
    import numpy as np
    import pyarrow as pa

    parts = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side, cells = F.lit(float(max(2 * reach, step + snap_limit))), ["_cx", "_cy", "_cz"]
    kind = dict(sites.dtypes)[key]

    def placed(df: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
        at = df.select(key, F.col(id_col).alias("id"), *[finite(k).alias(k) for k in "xyz"], *carried).dropna(subset=list("xyz"))
        return at.select("*", *[F.floor(F.col(k) / side).alias(f"_c{k}") for k in "xyz"])

    at, around = placed(sites), placed(surface, carried)
    sizes = at.groupBy(key, *cells).agg(F.ceil(F.count(F.lit(1)) / SITES).alias("_k"))
    dealt = at.join(sizes, [key, *cells]).withColumn("_sub", F.pmod(F.xxhash64("id"), F.col("_k"))).drop("_k")
    for c in cells:
        around = around.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    on = [key, *cells, "_sub"]
    around = around.hint("merge").join(dealt.select(*on).distinct(), [key, *cells])
    # names of its own for each side, so that the sides do not share columns
    left, right = (df.select(*[F.col(c).alias(c) for c in [*on, "id", *"xyz", *more]]).repartition(parts, *on) for df, more in ((dealt, ()), (around, carried)))

    def moves(p: np.ndarray, ids: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the site, replicate and row of the surface of each move that is taken."""
        planes, fit = np.zeros((len(p), 2, 3)), np.zeros(len(p), bool)
        for i in range(len(p)):
            gap = np.linalg.norm(every - p[i], axis=1)
            local = every[gap <= reach] if (gap <= reach).sum() >= 5 else every[gap <= 2 * reach]
            if len(local) >= 3:
                planes[i], fit[i] = np.linalg.svd(local - local.mean(0), full_matrices=False)[2][:2], True
        near, out = Near(every), []
        fit, each = np.flatnonzero(fit), max(1, MOVES // max(replicates, 1))
        for first in range(0, len(fit), each):
            of = np.repeat(fit[first : first + each], replicates)
            rep = np.tile(np.arange(replicates), len(of) // max(replicates, 1))
            draws = Draws(np.stack([np.full(len(of), seed & 0xFFFFFFFF), rep, ids[of] & 0xFFFFFFFF]).astype(np.uint32))
            for _ in range(tries):
                if not len(of):
                    break
                t = 2 * np.pi * draws.random()
                to = p[of] + step * (np.cos(t)[:, None] * planes[of, 0] + np.sin(t)[:, None] * planes[of, 1])
                at, _ = near(to, snap_limit)  # what is within snap_limit of a move's end is the nearest of all
                ok = (at >= 0) & (np.linalg.norm(every[at] - p[of], axis=1) >= least)
                out.append((of[ok], rep[ok], at[ok]))
                of, rep = of[~ok], rep[~ok]
                draws.keep(~ok)
        of, rep, at = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64) for _ in range(3))
        return of, rep, at

    def run(of: tuple, sites: pa.Table, surface: pa.Table) -> pa.Table:
        surface = surface.sort_by("id")
        p, every = (np.column_stack([t[k].to_numpy() for k in "xyz"]) for t in (sites, surface))
        ids = sites["id"].to_numpy().astype(np.int64)
        met = moves(p, ids, every) if len(p) and len(every) else (np.zeros(0, np.int64) for _ in range(3))
        columns = rows(ids, *met, surface)
        return pa.table({key: pa.array([of[0].as_py()] * len(columns["id"]), of[0].type), **columns})

    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, f"{key} {kind}, {schema}")
