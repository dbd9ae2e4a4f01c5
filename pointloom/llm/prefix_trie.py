"""The trie of all conversations' prefixes, from chained digests.

A conversation's turns are chained: the digest of a prefix is SHA-256 over the
digest of the prefix before and the digest of its last turn (16 bytes of it are
kept). Equal prefixes have equal digests, so grouping all prefixes by (depth,
digest) gives the nodes.

Sums over subtrees: a node belongs to the path of its smallest member, and that
path is a run of nodes down to the member's end. What the nodes of a path hold
is summed, each path's sum is exploded to all paths above it (at the depth where
it leaves them), and sums from the end upwards finish each path. Exploding
single nodes to all their ancestors would give the same sums with rows that
grow with the square of a conversation's length; paths above a path are never
more than the turns before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_made, made, numbered, staged

#: Turns that are chained in one task at a time; longer conversations chain the digests of such runs, and so on.
RUN = 1024
#: Conversation c takes its first turns from conversation c - c % FAMILY, at most HEADS - 1 of them.
FAMILY, HEADS = 100, 6
#: Ids in a piece of the text that ends_sha256 hashes.
IDS = 4096
ROOT = bytes(16)


def _digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:16]


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % F.lit(HEADS)


def originals(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, n, pos, turn digest td and code points cp of every turn, in the order of turns."""
    role_, text_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    td = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256))
    turns = df.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), td.alias("td"), F.length(text_).cast("long").alias("cp"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("td")]
    rows = numbered(turns.filter("conv_id IS NOT NULL"), order, "at").drop("turn")
    sizes = rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    return staged(rows.join(sizes, "conv_id").select("conv_id", "n", (F.col("at") - F.col("first")).alias("pos"), "td", "cp"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, len) and their turns (conv_id, len, pos, td, cp) after their heads are exchanged."""
    sizes = turns.select("conv_id", "n").distinct()
    c = sizes.withColumn("h", head_length(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = sizes.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = staged(
        c.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs"
    )
    own = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", "len", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "td", "cp")
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs, "base").filter("pos < taken").select("conv_id", "len", "pos", "td", "cp")
    return convs.select("conv_id", "len"), own.unionByName(lent)


PREFIX = "conv_id long, len long, pos long, digest binary, parent binary, cp long"


def _batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k in ("digest", "parent") else pa.int64()) for k, v in rows.items()], names=list(rows))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests along each run of turns, from the start of the run."""
    names = ("conv_id", "len", "pos", "digest", "parent", "cp")
    out = {k: [] for k in names}
    for batch in batches:
        for i in range(len(batch)):
            conv, size, run = (batch.column(k)[i].as_py() for k in range(3))
            turns, at = batch.column(3)[i].as_py(), ROOT
            for t in turns:
                out["parent"].append(at)
                at = _digest(at, t["td"])
                out["digest"].append(at)
            out["conv_id"] += [conv] * len(turns)
            out["len"] += [size] * len(turns)
            out["pos"] += [t["pos"] for t in turns]
            out["cp"] += [t["cp"] for t in turns]
            if len(out["cp"]) >= 8192:
                yield _batch(out)
                out = {k: [] for k in names}
    yield _batch(out)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole prefixes from those of the runs before and those within a run."""
    for batch in batches:
        row = batch.to_pydict()
        for k in ("digest", "parent"):
            # the prefix that ends with a run is the prefix of runs itself, so it has one digest as a node and as a parent
            row[k] = [d if b is None else b if d == ROOT else _digest(b, d) for d, b in zip(row[k], row["before"], strict=True)]
        del row["before"]
        yield _batch(row)


def chained(turns: DataFrame, longest: int) -> DataFrame:
    """conv_id, len, pos, digest, parent and cp of every prefix; no task holds more than RUN turns of a conversation.

    longest: turns of the longest conversation.
    """
    runs = turns.groupBy("conv_id", "len", F.floor(F.col("pos") / RUN).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "td", "cp"))).alias("turns"))
    local = runs.mapInArrow(_chain, PREFIX)
    if longest <= RUN:
        return local
    local = staged(local, "runs")
    ends = local.filter(F.col("pos") % RUN == RUN - 1).select("conv_id", "len", F.floor(F.col("pos") / RUN).alias("pos"), F.col("digest").alias("td"), F.lit(0).cast("long").alias("cp"))
    upto = chained(ends, -(-longest // RUN)).select("conv_id", (F.col("pos") + 1).alias("run"), F.col("digest").alias("before"))
    placed = local.withColumn("run", F.floor(F.col("pos") / RUN)).join(upto, ["conv_id", "run"], "left").drop("run")
    whole = placed.mapInArrow(_joined, PREFIX)
    # the last prefix of a run takes the digest under which the next run knows it
    final = whole.withColumn("run", F.floor((F.col("pos") + 1) / RUN)).join(upto, ["conv_id", "run"], "left")
    return final.select("conv_id", "len", "pos", F.when((F.col("pos") + 1) % RUN == 0, F.col("before")).otherwise(F.col("digest")).alias("digest"), "parent", "cp")


def _runs_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id to pieces of comma-joined ids."""
    node, ids = None, []

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=["depth", "digest", "first", "ids"])

    for batch in batches:
        for depth, digest, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if ids and ((depth, digest) != node or len(ids) == IDS):
                yield piece()
                ids = []
            node = (depth, digest)
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id to one hash for each node; a piece is held at a time."""
    node, state, out = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.string())], names=["depth", "digest", "ends_sha256"])

    for batch in batches:
        for depth, digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (depth, digest) != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(out) >= 4096:
            yield rows()
            out = []
    if state:
        out.append((*node, state.hexdigest()))
    if out:
        yield rows()


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, digest and ends_sha256 of the nodes at which conversations end.

    SHA-256 reads its text in order, so a node's pieces meet in one task; they
    hold thousands of ids each, and pass through one at a time.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", "digest", "conv_id"]
    pieces = ends.select(*key).repartitionByRange(parts, *key).sortWithinPartitions(*key).mapInArrow(_runs_of_ids, "depth long, digest binary, first long, ids string")
    return pieces.repartition(parts, "depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")


def trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, and digest (32 hex digits of the
    prefix, zeros for the root).

    Turns lie by turn, nulls first; turns that tie lie in the order of the
    SHA-256 of their role and text. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation. Repeated rows are turns of
    their own. An empty table has no node. Other columns play no part.
    """
    before = made()
    turns = originals(df, conv_id, turn, role, text)
    convs, parts = rebuilt(turns)
    first = convs.agg(F.min("conv_id").alias("conv_id"), F.max("len").alias("longest"), F.count(F.lit(1)).alias("n")).first()
    top, longest = first["conv_id"], first["longest"] or 0
    prefixes = staged(chained(parts, longest).select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "parent", "cp", (F.col("pos") + 1 == F.col("len")).alias("is_end")), "prefixes")

    groups = prefixes.groupBy("depth", "digest", "parent", "cp").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = staged(groups, "nodes")
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # every first turn has the root above it: that needs no join
    root = df.sparkSession.createDataFrame(
        [] if top is None else [(0, bytearray(ROOT), None, 0, first["n"], top, None)], "depth long, digest binary, parent binary, cp long, n_convs long, conv_id long, parent_conv_id long"
    )
    known = nodes.filter("depth = 1").withColumn("parent_conv_id", F.lit(top).cast("long")).unionByName(nodes.filter("depth > 1").join(above, ["depth", "parent"])).unionByName(root)
    childless = F.col("n_children").isNull()
    own = staged(
        known.join(kids, ["depth", "digest"], "left").select(
            "conv_id", "depth", "digest", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            childless.cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("cp")).alias("saved"),
        ),
        "own",
    )

    # what a path's own nodes hold goes to every path above it, at the depth where the path leaves that one
    paths = own.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).filter("top > 0")
    upward = prefixes.select("conv_id", "depth", "digest").join(paths.filter("top > 1"), "conv_id").filter("depth < top")
    met = upward.join(nodes.select("depth", "digest", F.col("conv_id").alias("over")), ["depth", "digest"]).select("conv_id", "over", "depth", "leaf", "saved")
    met = met.unionByName(paths.select("conv_id", F.lit(top).cast("long").alias("over"), F.lit(0).cast("long").alias("depth"), "leaf", "saved"))
    left = met.groupBy("conv_id", "over", "leaf", "saved").agg(F.max("depth").alias("depth"))
    given = left.groupBy(F.col("over").alias("conv_id"), "depth").agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    held = own.join(given, ["conv_id", "depth"], "left").withColumn("run", F.floor(F.col("depth") / RUN))
    held = staged(held.withColumn("leaf", F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).drop("more_leaf", "more_saved"), "held")

    # sums from a path's end upwards: within runs of depths, and over the runs below
    below = Window.partitionBy("conv_id").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("conv_id", "run").agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("l").over(below), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(below), F.lit(0)).alias("s"))
    inside = Window.partitionBy("conv_id", "run").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = held.join(runs, ["conv_id", "run"]).withColumn("n_leaves", F.sum("leaf").over(inside) + F.col("l")).withColumn("saved_tokens", F.sum("saved").over(inside) + F.col("s"))

    ends = prefixes.filter("is_end").select("depth", "digest", "conv_id")
    empty = convs.filter("len = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("digest"), "conv_id")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = summed.join(end_hashes(ends.unionByName(empty)), ["depth", "digest"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest")
    )
    out = staged(out, "trie")
    drop_made(df.sparkSession, before, out)
    return out
