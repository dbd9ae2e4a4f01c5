"""A Merkle manifest of a table: a tree of fanout 3 for each source, and one over the sources' roots.

Exact ranks come from histograms of the ids' digits (base 256), top digit
first: an id's rank is the count below its cell at each level, then its place
in a cell of 256 ids. No sort over the table is needed. A rank in base 3 is the
path of a leaf, and a node's key is a prefix of it; nodes are reduced by their
longest prefix, FANOUT**STEPS ranks to a cell, so a cell never holds more however large
a source is. Paths of siblings come down the same cells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_made, made, numbered, staged

#: A cell holds FANOUT**STEPS ranks: that many levels of the tree.
FANOUT, STEPS = 3, 6
DIGIT = 8
#: Cells of 256 ids hold more rows than this only where ids repeat; such cells are numbered by range.
MANY = 1 << 16
#: known is 0 for the null source, so that it comes first.
SOURCE = ["known", "src"]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _sha(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*values).cast("binary"), 256))


def leaves(df: DataFrame, doc_id: str, source: str, lang: str, n_chars: str, text: str) -> DataFrame:
    """known, src, doc_id, leaf, and alt: the leaf of the tampered text where that differs."""
    c = {n: F.col(f"`{n}`") for n in (doc_id, source, lang, n_chars, text)}
    ahead = [_field(c[n]) for n in (doc_id, source, lang, n_chars)]
    tampered = c[doc_id].isNotNull() & (F.crc32(c[doc_id].cast("string").cast("binary")) % 2 == 0) & (F.instr(c[text], "\n") > 0)
    return df.select(
        c[source].isNotNull().cast("int").alias("known"),
        F.coalesce(c[source], F.lit("")).alias("src"),
        c[doc_id].cast("long").alias("doc_id"),
        _sha([*ahead, _field(c[text])]).alias("leaf"),
        F.when(tampered, _sha([*ahead, _field(F.replace(c[text], F.lit("\n"), F.lit("")))])).alias("alt"),
    )


def ranks(rows: DataFrame) -> DataFrame:
    """rows (known, src, doc_id, leaf, ...) with n, their source's rows, and r, their rank there by doc_id (nulls first), then leaf."""
    keyed = rows.withColumn("given", F.col("doc_id").isNotNull().cast("int")).withColumn("cell", F.shiftright(F.coalesce("doc_id", F.lit(0)), DIGIT))
    top = [*SOURCE, "given"]
    hist = [staged(keyed.groupBy(*top, "cell").agg(F.count(F.lit(1)).alias("m")), "digits")]
    seen = hist[0].agg(F.min("cell").alias("lo"), F.max("cell").alias("hi"), F.max("m").alias("most")).first()
    lo, hi = seen["lo"] or 0, seen["hi"] or 0
    while lo >> DIGIT != hi >> DIGIT and len(hist) < 64 // DIGIT - 1:
        lo, hi = lo >> DIGIT, hi >> DIGIT
        hist.append(hist[-1].groupBy(*top, F.shiftright("cell", DIGIT).alias("cell")).agg(F.sum("m").alias("m")))
    # at the top a source has at most 256 cells and that of null ids
    all_ = Window.partitionBy(*SOURCE)
    before = Window.unboundedPreceding, -1
    at = hist[-1].select(
        *top, "cell", "m", F.sum("m").over(all_).alias("n"), F.coalesce(F.sum("m").over(all_.orderBy("given", "cell").rowsBetween(*before)), F.lit(0)).alias("below")
    )
    for level in reversed(hist[:-1]):
        up = at.select(*top, F.col("cell").alias("up"), "n", F.col("below").alias("first"))
        inside = Window.partitionBy(*top, "up").orderBy("cell").rowsBetween(*before)
        at = level.withColumn("up", F.shiftright("cell", DIGIT)).join(up, [*top, "up"])
        at = at.select(*top, "cell", "m", "n", (F.col("first") + F.coalesce(F.sum("m").over(inside), F.lit(0))).alias("below"))
    cells = [*top, "cell"]
    met = keyed.join(at, cells)
    few = met.filter(F.col("m") <= MANY) if (seen["most"] or 0) > MANY else met
    place = F.row_number().over(Window.partitionBy(*cells).orderBy("doc_id", "leaf")) - 1
    out = few.withColumn("r", F.col("below") + place).select(*rows.columns, "n", "r")
    if (seen["most"] or 0) > MANY:
        many = numbered(met.filter(F.col("m") > MANY), [F.col(c) for c in (*cells, "doc_id", "leaf")], "at")
        firsts = many.groupBy(*cells).agg(F.min("at").alias("start"))
        out = out.unionByName(many.join(firsts, cells).withColumn("r", F.col("below") + F.col("at") - F.col("start")).select(*rows.columns, "n", "r"))
    return out


def _up(values: list[bytes], n: int, steps: int) -> list[list[bytes]]:
    """The levels over a cell's nodes, as hex text; n nodes are in the whole tree at this level."""
    levels = [values]
    while len(levels) <= steps and (n > FANOUT**steps or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([hashlib.sha256(b"".join(last[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(last), FANOUT)])
    return levels


def _siblings(levels: list[list[bytes]], pos: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the node at pos, level by level."""
    out = []
    for level in levels[:-1]:
        first = pos - pos % FANOUT
        out.append((b"".join(level[first:pos]), b"".join(level[pos + 1 : first + FANOUT])))
        pos //= FANOUT
    return out


def _coded(path: list[tuple[bytes, bytes]]) -> str:
    return "".join(f"{a.decode()},{b.decode()};" for a, b in path)


def _decoded(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(x.encode() for x in step.split(",")) for step in path.split(";")[:-1]]


def _folded(value: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        value = hashlib.sha256(left + value + right).hexdigest().encode()
    return value


def _tops(steps: int):
    span = FANOUT**steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(3).to_pylist()
            tops = [_up([x["value"].encode() for x in batch.column(4)[i].as_py()], n[i], steps)[-1][0].decode() for i in range(len(batch))]
            over = [1 if x <= span else -(-x // span) for x in n]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(over, pa.int64()), pa.array(tops, pa.string())], names=["known", "src", "r", "n", "value"])

    return run


def climb(nodes: DataFrame, steps: int = STEPS) -> tuple[list[DataFrame], DataFrame]:
    """Reduce nodes (known, src, n, r, value and more) to one for each (known, src).

    Returns the cells of each round (known, src, cell, n, items) and the tops
    (known, src, value). Rounds shrink by the size of a cell.
    """
    span, rounds = FANOUT**steps, []
    while True:
        item = F.struct((F.col("r") % span).alias("pos"), *[c for c in nodes.columns if c not in (*SOURCE, "n", "r")])
        cells = staged(nodes.groupBy(*SOURCE, F.floor(F.col("r") / span).alias("cell"), "n").agg(F.sort_array(F.collect_list(item)).alias("items")), "cells")
        rounds.append(cells)
        values = cells.select(*SOURCE, "cell", "n", F.transform("items", lambda x: F.struct(x["value"].alias("value"))).alias("items"))
        nodes = staged(values.mapInArrow(_tops(steps), "known int, src string, r long, n long, value string"), "tops")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes.select(*SOURCE, "value")


def _paths(steps: int):
    """known, src, cell, n, items, path, subroot to known, src, cell, path, subroot of each item, which is a cell of the round below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                known, src, cell, n, items, path, subroot = (batch.column(k)[i].as_py() for k in range(7))
                levels, m = _up([x["value"].encode() for x in items], n, steps), len(items)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([known] * m, pa.int32()), pa.array([src] * m, pa.string()), pa.array([cell * FANOUT**steps + p for p in range(m)], pa.int64()),
                        pa.array([_coded(_siblings(levels, p)) + path for p in range(m)], pa.string()), pa.array([subroot] * m, pa.string()),
                    ],
                    names=["known", "src", "cell", "path", "subroot"],
                )

    return run


def descend(rounds: list[DataFrame], paths: DataFrame, steps: int = STEPS) -> DataFrame:
    """The cells' paths of siblings, from those of the tops (known, src, cell, path, subroot) down through the rounds."""
    for cells in reversed(rounds):
        paths = cells.join(paths, [*SOURCE, "cell"]).select(*SOURCE, "cell", "n", "items", "path", "subroot").mapInArrow(_paths(steps), "known int, src string, cell long, path string, subroot string")
    return paths


PROOF = "source string, rank long, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(root: str, steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                known, src, cell, n, items, path, subroot = (batch.column(k)[i].as_py() for k in range(7))
                levels = _up([x["value"].encode() for x in items], n, steps)
                over = _decoded(path)
                beside, whole = b"".join(a + b for a, b in over), {}
                out = {k: [] for k in ("leaf", "proof", "folded")}
                for pos, x in enumerate(items):
                    own = _siblings(levels, pos)
                    top = _folded(x["alt"].hex().encode() if x["alt"] is not None else levels[0][pos], own)
                    if top not in whole:  # leaves that fold to one cell top fold on alike
                        whole[top] = _folded(top, over)
                    out["leaf"].append(levels[0][pos].decode())
                    out["proof"].append(hashlib.sha256(b"".join(a + b for a, b in own) + beside).hexdigest())
                    out["folded"].append(whole[top].decode())
                m = len(items)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([src if known else None] * m, pa.string()), pa.array([cell * FANOUT**steps + p for p in range(m)], pa.int64()), pa.array([x["doc_id"] for x in items], pa.int64()),
                        pa.array(out["leaf"]), pa.array([subroot] * m), pa.array([root] * m), pa.array(out["proof"]), pa.array(out["folded"]), pa.array([x == root for x in out["folded"]]),
                    ],
                    names=["source", "rank", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return run


def manifest(df: DataFrame, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", text: str = "text", steps: int = STEPS) -> DataFrame:
    """source, rank, doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row.

    Null ids come first in their source, have no decimal and are not tampered
    with. Rows that tie in id lie by leaf; rows that agree there too have each
    their own rank. Null and empty texts differ (`-` and `0:`), a null source
    and an empty one are two. An empty table gives no rows. Other columns play
    no part.
    """
    before, spark = made(), df.sparkSession
    # leaves hash whole texts: staged, they are made once
    ranked = ranks(staged(leaves(df, doc_id, source, lang, n_chars, text), "leaves"))
    docs, subroots = climb(ranked.select(*SOURCE, "n", "r", "doc_id", F.lower(F.hex("leaf")).alias("value"), "alt"), steps)
    sources = numbered(subroots, [F.col(c) for c in SOURCE], "r")
    n = sources.count()
    one = [F.lit(1).alias("known"), F.lit("").alias("src")]
    over, roots = climb(sources.select(*one, F.lit(n).cast("long").alias("n"), "r", "value"), steps)
    top = roots.first()
    root = top["value"] if top else ""
    start = spark.createDataFrame([(1, "", 0, "", "")], "known int, src string, cell long, path string, subroot string")
    at = descend(over, start, steps).select(F.col("cell").alias("r"), "path")
    paths = sources.join(at, "r").select(*SOURCE, F.lit(0).cast("long").alias("cell"), "path", F.col("value").alias("subroot"))
    met = docs[0].join(descend(docs[1:], paths, steps), [*SOURCE, "cell"]).select(*SOURCE, "cell", "n", "items", "path", "subroot")
    out = staged(met.mapInArrow(_proofs(root, steps), PROOF), "manifest")
    drop_made(spark, before, out)
    return out
