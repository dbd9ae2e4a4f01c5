"""Mixing sources to target weights by entropy balancing.

The rate of a document (expected copies, 0 to cap) is cap * sigmoid(lambda *
c), with c the document's size in units of its source's typical size: the
odds are tilted exponentially by the token count. This maximises the sum of
the documents' binary entropies under one token constraint for each source;
the convex dual is solved by distributed Newton steps over a histogram of
sizes. Rates become whole copies by one threshold for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_staged, numbered, ranked, staged, without

WEIGHTS, TOTAL, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
BINS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _spread(doc_id: Column, text: Column) -> Column:
    """A fixed number in [0, 1) for each document."""
    h = F.xxhash64(F.lit(20), doc_id, text)
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def _unrepeated(marked: DataFrame, sized: DataFrame) -> DataFrame | None:
    """marked with a spread of its own for each of several equal rows, or None if no rows are equal.

    The k-th of them is moved by k golden sections, so that any number of them
    is spread evenly. They are numbered by range, however many there are.
    """
    again = sized.groupBy("source", "spread").count().filter("count > 1").select(F.col("source").alias("_rs"), F.col("spread").alias("_rp"))
    if not again.limit(1).count():
        return None
    again = staged(again, "repeats")
    on = F.col("_s").eqNullSafe(F.col("_rs")) & (F.col("_spread") == F.col("_rp"))
    rows = numbered(marked.join(again, on, "left_semi"), [F.col("_s"), F.col("_spread")], "_at")
    first = rows.groupBy(F.col("_s").alias("_rs"), F.col("_spread").alias("_rp")).agg(F.min("_at").alias("_first"))
    moved = F.col("_spread") + (F.col("_at") - F.col("_first")) * F.lit((5**0.5 - 1) / 2)
    told = rows.join(first, on).withColumn("_spread", moved - F.floor(moved)).select(*marked.columns)
    return marked.join(again, on, "left_anti").unionByName(told)


def targets(sources: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """sources (source, source_size, ...; one row each, staged) with weight and target.

    Weights repeat over the sources by code point, null last. What a source
    cannot take within cap times its size is reshared by weight. A source is
    capped if cap * size / weight is under the common level; the level rises
    until it no longer changes, so only scalars live in the driver.
    """
    n = len(weights)
    lookup = F.array(*[F.lit(float(w)) for w in weights])
    order = ranked(sources, [F.col("source").asc_nulls_last()], "_rank")
    weighed = order.withColumn("weight", F.get(lookup, (F.col("_rank") % n).cast("int"))).drop("_rank")
    full = F.col("source_size") * F.lit(cap)
    everything = F.lit(total) * F.sum("source_size")
    level, before = 0.0, -1.0
    while level != before:
        capped = full / F.col("weight") < F.lit(level)
        row = weighed.agg(
            everything.alias("t"), F.sum(F.when(capped, full)).alias("taken"), F.sum(F.when(~capped, F.col("weight"))).alias("w")
        ).first()
        before, level = level, max(level, (row["t"] - (row["taken"] or 0.0)) / row["w"]) if row["w"] else level
    return weighed.withColumn("target", F.least(full, F.col("weight") * F.lit(level)))


def _same(a: str, b: str = "source") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def solve(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, steps: int = 25, within: float = 1e-4) -> DataFrame:
    """sized (source, size, spread; staged) to one staged row for each source: source, source_size, target, unit, tilt, cut.

    tilt is the dual variable (null where the target is all copies), cut the
    rounding threshold of spread minus the rate's fraction.
    """
    hist = staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = staged(
        hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("_sq")),
        "sources",
    )
    base = targets(sources, weights, total, cap).select(
        F.col("source").alias("s"), "source_size", "target", F.greatest(F.col("_sq") / F.greatest("source_size", F.lit(1)), F.lit(1.0)).alias("unit")
    )
    whole = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = staged(base.withColumn("tilt", F.when(~whole, 0.0)).withColumn("lo", F.lit(-60.0)).withColumn("hi", F.lit(60.0)).withColumn("gap", F.lit(1.0)), "dual")
    for _ in range(steps):
        c = F.col("size") / F.col("unit")
        share = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("tilt") * c))
        tokens = F.col("size") * F.col("n") * F.lit(cap)
        sums = (
            hist.join(state.filter("tilt is not null").select("s", "unit", "tilt"), _same("source", "s"))
            .groupBy("s")
            .agg(F.sum(tokens * share).alias("v"), F.sum(tokens * c * share * (1 - share)).alias("d"))
            .withColumnRenamed("s", "s2")
        )
        off = F.col("v") - F.col("target")
        lo, hi = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off >= 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - off / F.greatest(F.col("d"), F.lit(1e-12))
        inside = (step > F.col("lo2")) & (step < F.col("hi2"))
        new = (
            state.join(sums, _same("s", "s2"), "left")
            .withColumn("lo2", F.when(F.col("v").isNull(), F.col("lo")).otherwise(lo))
            .withColumn("hi2", F.when(F.col("v").isNull(), F.col("hi")).otherwise(hi))
            .withColumn("gap2", F.coalesce(F.abs(off) / F.greatest(F.col("target"), F.lit(1.0)), F.lit(0.0)))
            .withColumn("tilt2", F.when(F.col("gap2") <= within, F.col("tilt")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2))
            .select("s", "source_size", "target", "unit", F.when(F.col("tilt").isNotNull(), F.col("tilt2")).alias("tilt"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("gap2").alias("gap"))
        )
        new = staged(new, "dual")
        drop_staged(state)
        state = new
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= within:
            break
    cut = state.withColumn("low", F.lit(-1.0)).withColumn("width", F.lit(2.0))
    rate, key = rate_of(cap), F.col("spread") - (rate_of(cap) - F.floor(rate_of(cap)))
    for last in (False, True):
        keyed = sized.join(cut, _same("source", "s")).select("s", "size", "target", rate.alias("r"), key.alias("v"), "low", "width")
        place = F.when(F.col("v") < F.col("low"), -1).otherwise(F.least(F.lit(BINS), F.floor((F.col("v") - F.col("low")) / F.col("width") * BINS)))
        bins = (
            keyed.withColumn("bin", place.cast("int"))
            .groupBy("s", "target", "bin")
            .agg(F.sum("size").alias("extra"), F.sum(F.col("size") * F.floor("r")).alias("always"))
        )
        w = Window.partitionBy("s").orderBy("bin")  # BINS + 2 rows at most for each source
        run = bins.withColumn("upto", F.sum("extra").over(w)).withColumn("need", F.col("target") - F.sum("always").over(Window.partitionBy("s")))
        best = F.expr("min_by(bin, struct(abs(upto - need), bin))") if last else F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), F.col("bin"))), F.max("bin"))
        found = run.groupBy("s").agg(best.alias("bin"), F.min(F.abs(F.col("upto") - F.col("need"))).alias("miss"), F.first(F.abs("need")).alias("none")).withColumnRenamed("s", "s3")
        step = F.col("width") / BINS
        if last:
            at = F.when(F.col("none") <= F.col("miss"), F.lit(-2.0)).otherwise(F.col("low") + step * (F.greatest(F.col("bin"), F.lit(-1)) + 1))
            cut = cut.join(found, _same("s", "s3"), "left").select(F.col("s").alias("source"), "source_size", "target", "unit", "tilt", F.coalesce(at, F.lit(0.0)).alias("cut"))
        else:
            low = F.col("low") + step * F.least(F.greatest(F.coalesce("bin", F.lit(0)), F.lit(0)), F.lit(BINS - 1))
            cut = cut.join(found, _same("s", "s3"), "left").select(*state.columns, low.alias("low"), step.alias("width"))
        cut = staged(cut, "cut")
    for df in (hist, sources, state):
        drop_staged(df)
    return cut


def rate_of(cap: float = CAP) -> Column:
    return F.when(F.col("tilt").isNull(), F.lit(cap)).otherwise(F.lit(cap) / (F.lit(1.0) + F.exp(-F.col("tilt") * F.col("size") / F.col("unit"))))


def copies_of(cap: float = CAP) -> Column:
    rate = rate_of(cap)
    extra = F.when(F.col("_spread") - (rate - F.floor(rate)) < F.col("cut"), 1).otherwise(0)
    return F.least(F.floor(rate) + extra, F.lit(int(cap))).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """df with size, source_size, target, rate, copies and taken; columns of these names are replaced.

    A null source is a source, ordered last. Null and empty texts have size 0
    and take nothing. Rows of one source that agree in id and text are spread evenly
    over the copies their rate gives; which of them has more is open. A source's taken words differ from its target by about one
    document; reruns give the same copies. An empty table stays empty.
    """
    names = ["size", "source_size", "target", "rate", "copies", "taken", "_s", "_size", "_spread", "unit", "tilt", "cut"]
    base = without(df, [n for n in names if n not in (id_col, text_col, source_col)])
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    marked = base.withColumn("_s", source).withColumn("_size", size_of(text)).withColumn("_spread", _spread(F.col(f"`{id_col}`"), text))
    slim = lambda m: m.select(F.col("_s").alias("source"), F.col("_size").alias("size"), F.col("_spread").alias("spread"))
    sized = staged(slim(marked), "sized")
    if (apart := _unrepeated(marked, sized)) is not None:
        drop_staged(sized)
        marked = apart
        sized = staged(slim(marked), "sized")
    plan = solve(sized, weights, total, cap).withColumnRenamed("source", "_s2")
    drop_staged(sized)
    out = marked.join(plan, F.col("_s").eqNullSafe(F.col("_s2"))).withColumnRenamed("_size", "size")
    out = out.withColumn("rate", rate_of(cap)).withColumn("copies", copies_of(cap))
    return out.withColumn("taken", F.col("copies") * F.col("size")).select(*[F.col(f"`{c}`") for c in base.columns], "size", "source_size", "target", "rate", "copies", "taken")


def mixed_rows(mixed: DataFrame) -> DataFrame:
    """One row for each copy that the mix takes."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
