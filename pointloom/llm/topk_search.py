"""Exact top-k by inner product: dual cover-tree search over blocks of queries and blocks of candidates.

A node of a cover tree has a centre (one of its vectors), a covering radius
and children whose centres are more than half of that radius apart. For nodes
Q and C no inner product exceeds qc + Rq |c| + Rc |q| + Rq Rc, so a pair goes
if that is under the worst kth score of Q's queries.

Blocks are the upper level of the trees: vectors are dealt by their nearest
pivot, and a block has a centre and a radius. Every query block first meets
the candidate block whose centre suits it best; the kth scores found there
are lower bounds for all other blocks, most of which may then go unread.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, map_columns, ranked, staged

SCALE, TOP, EVERY = 1024, 10, 100
CANDIDATE_BLOCK, QUERY_BLOCK, LEAF = 4096, 1024, 24
#: Pivots at most; they are a draw by hash, and only say which vectors lie together.
PIVOTS = 256
EXACT = 2.0**52  # products under this are exact in doubles
LONG = (1 << 63) - 1


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    points: np.ndarray  # row numbers under the node
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms: np.ndarray | None = None


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, first: int | None = None) -> Node:
    """Tree over the rows of x; equal rows share a leaf."""
    points = np.arange(len(x)) if points is None else points
    at = int(points[0]) if first is None else first
    far = np.sqrt(((x[points] - x[at]) ** 2).sum(1))
    node = Node(x[at], float(far.max()), points)
    if len(points) <= LEAF or node.radius == 0:
        return node
    half, left = node.radius / 2, points
    groups = []
    while len(left):
        c = at if at in left[:1] or not groups else int(left[0])
        near = ((x[left] - x[c]) ** 2).sum(1) <= half * half
        near |= left == c
        groups.append((c, left[near]))
        left = left[~near]
    if len(groups) == 1:
        return node
    node.children = [cover_tree(x, g, c) if len(g) > 1 else Node(x[c], 0.0, g) for c, g in groups]
    node.centres = np.stack([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    node.norms = np.sqrt((node.centres**2).sum(1))
    return node


class Best:
    """The k best (score, id) so far of every query of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.worst = k, np.full(n, -np.inf)
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        take = scores >= self.worst[q]  # equal scores may win by a smaller id
        if not take.any():
            return
        s, i = np.concatenate([self.scores[q], scores[take]]), np.concatenate([self.ids[q], ids[take]])
        best = np.lexsort((i, -s))[: self.k]
        self.scores[q], self.ids[q] = s[best], i[best]
        if len(best) == self.k:
            self.worst[q] = max(self.worst[q], self.scores[q][-1])


def dual_search(qx: np.ndarray, qids: np.ndarray, qtree: Node, cx: np.ndarray, cids: np.ndarray, ctree: Node, k: int = TOP, floor: np.ndarray | None = None) -> Best:
    """The k best candidates of each query by (score descending, id), its own id left out; those under floor may be missing."""
    best = Best(len(qx), k)
    if floor is not None:
        best.worst = floor.copy()

    def leaf(q: Node, rows: np.ndarray) -> None:
        dots = qx[q.points] @ cx[rows].T
        ids = cids[rows]
        for j, i in enumerate(q.points.tolist()):
            other = ids != qids[i]
            best.offer(i, dots[j][other], ids[other])

    def visit(q: Node, c: Node) -> None:
        if q.children and (q.radius >= c.radius or not c.children):
            for x in q.children:
                visit(x, c)
            return
        norm = float(np.sqrt(q.centre @ q.centre))
        if not c.children:
            leaf(q, c.points)
            return
        bound = c.centres @ q.centre + q.radius * c.norms + c.radii * norm + q.radius * c.radii
        bound += 1e-9 * np.abs(bound) + 1e-6  # over any rounding of the bound
        singles: list[int] = []
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < best.worst[q.points].min():
                break
            child = c.children[i]
            if child.children:
                visit(q, child)
            else:
                singles.append(i)
                if len(singles) == 64:
                    leaf(q, np.concatenate([c.children[s].points for s in singles]))
                    singles = []
        if singles:
            leaf(q, np.concatenate([c.children[s].points for s in singles]))

    if _bound(qtree.centre, qtree.radius, ctree.centre, ctree.radius) >= best.worst.min():
        visit(qtree, ctree)
    return best


def _bound(q: np.ndarray, rq: float, c: np.ndarray, rc: float) -> float:
    """Over every product of a vector within rq of q and one within rc of c, whatever the rounding."""
    v = float(q @ c) + rq * math.sqrt(float(c @ c)) + rc * math.sqrt(float(q @ q)) + rq * rc
    return v + 1e-9 * abs(v) + 1e-6


def _pack(ids: list[int], x: np.ndarray) -> bytes:
    return struct.pack("<qq", len(ids), x.shape[1]) + np.asarray(ids, "<i8").tobytes() + x.astype("<f8").tobytes()


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors as they came, not yet scaled."""
    n, d = struct.unpack_from("<qq", b)
    return np.frombuffer(b, "<i8", n, 16), np.frombuffer(b, "<f8", n * d, 16 + 8 * n).reshape(n, d)


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles, exact for what is_large leaves out."""
    return np.floor(x * SCALE)


def scaled_ints(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as Python's integers, for finite x of any size."""
    return np.array([[math.floor(v * SCALE) if abs(v) < 2.0**43 else int(v) * SCALE for v in row] for row in x.tolist()], object).reshape(x.shape)


def is_large(x: np.ndarray) -> np.ndarray:
    """Vectors whose products with their like may not be exact in doubles."""
    top = np.abs(x).max(1, initial=0.0)
    return ~((top * SCALE + 1) ** 2 * max(1, x.shape[1]) < EXACT) if len(x) else np.zeros(0, bool)


_BLOCK = "dim int, large boolean, n int, centre array<double>, radius double, block binary"


def _blocks(size: int):
    """Sorted rows (pivot, id, x) to blocks of equal dimension and size class; a new pivot begins a block that is not small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[list, list, list]] = {}

        def out(key: tuple[int, bool]) -> pa.RecordBatch:
            _, ids, rows = held.pop(key)
            x = np.array(rows, float).reshape(len(ids), key[0])
            centre, radius = np.zeros(key[0]), 0.0
            if not key[1]:
                y = scaled(x)
                centre = y.mean(0) if key[0] else centre
                radius = float(np.sqrt(((y - centre) ** 2).sum(1)).max()) * (1 + 1e-9) + 1e-6
            row = {"dim": key[0], "large": key[1], "n": len(ids), "centre": centre.tolist(), "radius": radius, "block": _pack(ids, x)}
            kinds = pa.schema([("dim", pa.int32()), ("large", pa.bool_()), ("n", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("block", pa.binary())])
            return pa.RecordBatch.from_pylist([row], kinds)

        for batch in batches:
            for pivot, i, v in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                key = (len(v), bool(is_large(np.array([v], float).reshape(1, -1))[0]))
                old = held.get(key)
                if old and (len(old[1]) >= size or (len(old[1]) >= size // 4 and old[0][-1] != pivot)):
                    yield out(key)
                pivots, ids, rows = held.setdefault(key, ([], [], []))
                pivots.append(pivot)
                ids.append(i)
                rows.append(v)
        for key in list(held):
            yield out(key)

    return run


def _search(k: int):
    """Rows (query block, floors of its queries or null, candidate block) to the best of each query in that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[bytes, Node] = {}  # the last candidate block's tree serves the query blocks that follow
        for batch in batches:
            for row in range(batch.num_rows):
                q, floors, c = (batch.column(j)[row].as_py() for j in range(3))
                (qi, qv), (ci, cv) = _unpack(q), _unpack(c)
                if not (is_large(qv).any() or is_large(cv).any()):
                    qx, cx = scaled(qv), scaled(cv)
                    if c not in trees:
                        trees = {c: cover_tree(cx)}
                    floor = None if floors is None else np.array([-np.inf if f is None else float(f) for f in floors])
                    best = dual_search(qx, qi, cover_tree(qx), cx, ci, trees[c], k, floor)
                    found = [(int(qi[j]), int(i), int(s), False) for j in range(len(qi)) for i, s in zip(best.ids[j], best.scores[j], strict=True)]
                else:  # components too large for doubles: Python's integers
                    cx, found = scaled_ints(cv), []
                    for j, qx in enumerate(scaled_ints(qv)):
                        rows = sorted((-s, int(i)) for s, i in zip(cx @ qx, ci, strict=True) if i != qi[j])[:k]
                        found += [(int(qi[j]), i, -s, True) for s, i in rows]
                # a product that no long holds: the text of its digits keeps the order
                digits = [str(x[2]) if x[3] and abs(x[2]) > LONG else None for x in found]
                arrays = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([max(-LONG - 1, min(LONG, x[2])) for x in found], pa.int64()), pa.array(digits, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score", "digits"])

    return run


_FOUND = "query_id long, vec_id long, score long, digits string"


def _best_of(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the k best of each query; scores beyond a long are compared by sign, length and digits."""
    below = F.when(F.col("digits").isNull(), F.when(F.col("score") < 0, 0).otherwise(0)).when(F.col("score") < 0, -F.length("digits")).otherwise(F.length("digits"))
    by_digits = F.when(F.col("score") < 0, F.translate("digits", "0123456789", "9876543210")).otherwise(F.col("digits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(below), F.desc(by_digits), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of every query, ties to the smaller id.

    Components become floor(1024 * x). Queries are the rows whose id is
    divisible by `every`; candidates are all rows of the same dimension whose
    id differs. Null ids, null vectors and vectors with null or non-finite
    components take no part. Products are exact whatever the size of the
    components; one that no long holds is ranked by its value and returned as
    the long's bound. An empty vector's product is 0. Rows that repeat an id
    and a vector each count as a candidate. Extra columns, whatever their
    names, are ignored; an empty table gives an empty result.

    Candidates go to query blocks in blocks. A pair of blocks is dealt to a
    task of its own, and only if the product of its centres and radii can
    still beat the worst of the query block's kth scores.
    """
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    doubles = F.transform(v, lambda x: x.cast("double"))
    good = i.isNotNull() & v.isNotNull() & ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    slim = df.filter(good).select(i.cast("long").alias("id"), doubles.alias("x"))
    spark, parts = df.sparkSession, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = slim.orderBy(F.xxhash64(F.lit(7), "id", "x")).limit(PIVOTS).collect()  # PIVOTS rows
    pivots = {}
    for r in drawn:
        pivots.setdefault(len(r["x"]), []).append(r["x"])
    pivots = {d: np.array(p, float).reshape(len(p), d) for d, p in pivots.items()}

    def nearest(x: pa.Array) -> list:
        out = []
        for row in x.to_pylist():
            p = pivots.get(len(row))
            with np.errstate(over="ignore", invalid="ignore"):
                out.append(0 if p is None or not len(row) else int(np.nanargmin(np.append(((p - np.array(row)) ** 2).sum(1), np.inf))))
        return [out]

    near = staged(map_columns(slim, ["x"], "pivot int", nearest).select("pivot", "id", "x"), "vectors")

    def blocks(rows: DataFrame, size: int, name: str, number: str) -> DataFrame:
        dealt = rows.repartitionByRange(parts, "pivot", F.xxhash64("id")).sortWithinPartitions("pivot", "id")
        made = staged(dealt.mapInArrow(_blocks(size), _BLOCK), name)
        numbered = ranked(made, [F.xxhash64("block")], number)
        out = staged(numbered, name)
        drop_staged(made)
        return out

    asked = near.filter(F.col("id") % every == 0)
    # queries are few: as few tasks make their blocks, so that a block is full
    n = asked.count()
    if not n:
        drop_staged(near)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    made = staged(asked.repartitionByRange(max(1, -(-n // (4 * QUERY_BLOCK))), "pivot", F.xxhash64("id")).sortWithinPartitions("pivot", "id").mapInArrow(_blocks(QUERY_BLOCK), _BLOCK), "queries")
    queries = staged(ranked(made, [F.xxhash64("block")], "qb"), "queries")
    drop_staged(made)
    candidates = blocks(near, CANDIDATE_BLOCK, "candidates", "cb")
    count = queries.count()
    side = lambda t, s, name: t.select(F.col(name), F.col("dim"), *[F.col(c).alias(f"{s}_{c}") for c in ("large", "n", "centre", "radius")])
    # pairs of blocks, described by their centres alone
    numbers = side(candidates, "c", "cb").withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = staged(numbers.join(side(queries, "q", "qb"), ["qb", "dim"]).withColumn("dot", _dot("q_centre", "c_centre")), "pairs")
    best = Window.partitionBy("qb").orderBy(F.desc(F.col("c_n") > k), F.desc("dot"), "cb")
    seeds = pairs.filter("not q_large and not c_large").withColumn("_k", F.row_number().over(best)).filter("_k = 1").select("qb", "cb")
    q_rows, c_rows = queries.select("qb", F.col("block").alias("q")), candidates.select("cb", F.col("block").alias("c"))
    none = F.lit(None).cast("array<long>")
    seeded = seeds.join(q_rows, "qb").join(c_rows, "cb").repartition(parts, "qb", "cb").select("q", none.alias("floors"), "c", "qb")
    first = staged(seeded.select("q", "floors", "c").mapInArrow(_search(k), _FOUND), "first")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("kth")).filter(F.col("_n") >= k).select("query_id", "kth")

    def ids_of(block: pa.Array) -> list:
        return [[_unpack(b)[0].tolist() for b in block.to_pylist()]]

    listed = map_columns(q_rows, ["q"], "ids array<long>", ids_of).select("qb", F.posexplode("ids").alias("_at", "query_id"))
    floors = listed.join(kth, "query_id", "left").groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("_at", "kth"))).alias("_f"), F.min(F.coalesce("kth", F.lit(-(1 << 62)))).alias("least"))  # one block
    floors = staged(floors.select("qb", F.transform("_f", lambda x: x["kth"]).alias("floors"), "least"), "floors")
    size = lambda c: F.sqrt(_dot(c, c))
    bound = F.col("dot") + F.col("q_radius") * size("c_centre") + F.col("c_radius") * size("q_centre") + F.col("q_radius") * F.col("c_radius")
    alive = F.col("q_large") | F.col("c_large") | (bound + F.abs(bound) * 1e-9 + 1e-6 >= F.col("least"))
    rest = pairs.join(floors, "qb").filter(alive).join(seeds.withColumn("_s", F.lit(True)), ["qb", "cb"], "left").filter("_s is null").select("qb", "cb", "floors")
    dealt = rest.join(q_rows, "qb").join(c_rows, "cb").repartition(parts, "qb", "cb").select("q", "floors", "c")
    more = dealt.mapInArrow(_search(k), _FOUND)
    out = staged(_best_of(first.union(more), k).select("query_id", "rank", "vec_id", "score"), "topk")
    for t in (near, queries, candidates, pairs, first, floors):
        drop_staged(t)
    return out
