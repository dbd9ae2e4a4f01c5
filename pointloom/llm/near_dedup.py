"""Near duplicates: DartMinHash signatures, banded candidates, exact verification, distributed components.

Texts are sets (or multisets) of shingles of five words. Darts are thrown
from hashes of the shingles: every unit cell of an element's weight and rank
plane gets a Poisson(1) number of darts, fixed by the cell's hash. A document
keeps the darts under its weights and a rank bound that yields about
k ln k + 2k of them; each dart has a coordinate, and the dart of least rank
wins it. Two documents agree in a coordinate with the probability of their
(weighted) Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_staged, map_columns, staged, unwrapped, wrapped

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 meets in no band with probability (1 - 0.8^5)^24 = 7e-5.
BANDS, ROWS = 24, 5
HUBS = 3
#: Bits of a set's parity marks, in words of 64.
MARKS = 16
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, known: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text with words is one shingle; no words, none."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        out = mixed(out * _M3 + h[i : i + n])
    return out


def weighted(hashes: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct elements and their weights: 1 each, or how often they occur."""
    if counted:
        u, n = np.unique(hashes, return_counts=True)
        return u, n.astype(np.float64)
    u = np.unique(hashes)
    return u, np.ones(len(u))


def dart_sketch(elements: list[np.ndarray], weights: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures (documents x k) of weighted sets; every set must have positive weight."""
    out = np.zeros((len(elements), k), np.uint64)
    todo = np.arange(len(elements))
    darts = k * math.log(k) + 2 * k
    while len(todo):
        sizes = np.array([len(elements[i]) for i in todo])
        e, w = np.concatenate([elements[i] for i in todo]), np.concatenate([weights[i] for i in todo])
        doc = np.repeat(np.arange(len(todo)), sizes)
        bound = darts / np.bincount(doc, w, len(todo))
        hashes, ranks, owners = [], [], []
        nu = 0
        while True:  # weights in [2^nu - 1, 2^(nu + 1) - 1), ranks in slots of height 2^-nu: cells of area 1
            at = np.flatnonzero(w > 2.0**nu - 1)
            if not len(at):
                break
            slots = np.ceil(bound[doc[at]] * 2.0**nu).astype(np.int64)
            cell_of = np.repeat(at, slots)
            slot = np.arange(len(cell_of)) - np.repeat(np.cumsum(slots) - slots, slots)
            cell = mixed(mixed(e[cell_of] + np.uint64(((nu + 1) * int(_M3)) % (1 << 64))) + slot.astype(np.uint64) * _M2)
            count = np.searchsorted(_POISSON, _unit(cell), "right")
            hit = np.repeat(np.arange(len(cell)), count)
            j = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(cell[hit] + (j.astype(np.uint64) + np.uint64(1)) * _M1)
            rank = (slot[hit] + _unit(mixed(dart + _M1))) * 2.0**-nu
            inside = rank <= bound[doc[cell_of[hit]]]
            inside &= 2.0**nu - 1 + _unit(mixed(dart + _M2)) * 2.0**nu <= w[cell_of[hit]]
            hashes.append(dart[inside])
            ranks.append(rank[inside])
            owners.append(doc[cell_of[hit[inside]]])
            nu += 1
        h, r, d = np.concatenate(hashes), np.concatenate(ranks), np.concatenate(owners)
        place = d * k + (mixed(h + _M3) % np.uint64(k)).astype(np.int64)
        latest = np.lexsort((h, r))[::-1]  # the least rank is written last
        won, filled = np.zeros(len(todo) * k, np.uint64), np.zeros(len(todo) * k, bool)
        won[place[latest]] = h[latest]
        filled[place] = True
        full = filled.reshape(-1, k).all(1)
        out[todo[full]] = won.reshape(-1, k)[full]
        todo, darts = todo[~full], darts * 2
    return out


def bands_of(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * _M3
    for i in range(rows):
        key = mixed(key * _M2 + parts[:, :, i])
    return key.view(np.int64)


def _signed(counted: bool):
    def run(known: WordHashes, text: pa.Array) -> list:
        nodes, sizes, sets, weights, at = [], [], [], [], []
        for i, t in enumerate(as_bytes(text)):
            e, w = weighted(shingles(t, known), counted)
            if len(e):
                nodes.append(hashlib.blake2b(e.tobytes() + (w.tobytes() if counted else b""), digest_size=16).digest())
                sets.append(e)
                weights.append(w)
                at.append(i)
            else:
                nodes.append(None)
            sizes.append(float(w.sum()))
        keys = np.zeros((0, BANDS), np.int64)
        if at:
            step = 256  # bounds the darts in memory
            keys = np.concatenate([bands_of(dart_sketch(sets[i : i + step], weights[i : i + step], BANDS * ROWS)) for i in range(0, len(at), step)])
        held = dict(zip(at, range(len(at)), strict=True))
        return [nodes, sizes, [keys[held[i]] if i in held else None for i in range(len(nodes))]]

    return run


def parity(elements: np.ndarray) -> np.ndarray:
    """Whether an odd number of the elements falls on each of 64 * MARKS places, as bits of MARKS words.

    Elements that two sets share cancel, so two marks differ in no more places
    than the sets differ in elements.
    """
    odd = np.bincount((mixed(elements) % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shingle_sets(counted: bool):
    def run(known: WordHashes, text: pa.Array) -> list:
        sets, marks = [], []
        for t in as_bytes(text):
            h = shingles(t, known)
            if counted:  # the n-th occurrence of a shingle is an element of its own: Jaccard of these sets is the weighted one
                h = np.sort(h)
                first = np.searchsorted(h, h)
                h = mixed(h + (np.arange(len(h)) - first).astype(np.uint64) * _M3)
            h = np.unique(h)
            sets.append(h.view(np.int64))
            marks.append(parity(h))
        return [sets, marks]

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): the least node of each component.

    Each round takes the least label among a node and its neighbours, then the
    label's own label; both are joins and partial aggregates, staged.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "comp").union(labels.select("node", "comp"))
        near = seen.groupBy("node").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        new = near.join(jump, "near").select("node", F.least("near", "far").alias("comp"))
        old = labels.withColumnRenamed("comp", "was")
        new = staged(new.join(old, "node"), "labels")
        moved = new.filter("comp <> was").limit(1).count()
        drop_staged(labels)
        labels = new.select("node", "comp")
        if not moved:
            drop_staged(both)
            return labels


def scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the exact similarity j of their sets."""
    a, b = sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), sets.select(F.col("node").alias("b"), F.col("sh").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("j"))


def open_pairs(inside: DataFrame, labels: DataFrame, known: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of a bucket in different components that may still be similar enough.

    Of two members of a bucket in different components, one is outside the
    bucket's largest component; so these meet all members. The join itself
    rules out what cannot be a link, so it puts out little more than links.
    Both rules are exact. 1 - similarity is a metric, so members whose
    similarities to a hub differ by more than 1 - similarity are no pair;
    steps of the similarity to the first hub are part of the join's key. And
    sets of sizes n and m with that similarity differ in at most
    (n + m) (1 - s) / (1 + s) elements, so their parity marks do too. For texts
    of thousands of words the marks fill up and rule out less.
    """
    slack = 1.0 - similarity + 1e-9
    placed = inside.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = counts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("band", "main")
    hubs = placed.join(split, "band").select("band", "main", "node", "size", "comp", F.posexplode("hubs").alias("i", "hub"))
    key = hubs.withColumn("a", F.least("node", "hub.node")).withColumn("b", F.greatest("node", "hub.node"))
    met = key.join(known, ["a", "b"], "left").withColumn("j", F.when(F.col("node") == F.col("hub.node"), 1.0).otherwise(F.col("j")))
    sims = [F.max(F.when(F.col("i") == i, F.col("j"))).alias(f"j{i}") for i in range(HUBS)]
    open_ = met.groupBy("band", "main", "node", "size", "comp").agg(*sims).withColumn("step", F.floor(F.col("j0") / slack).cast("int"))
    # a similarity to the first hub that was not asked (sizes too far apart) is in every step
    every = F.sequence(F.lit(0), F.lit(int(1.0 / slack) + 1))
    steps = F.when(F.col("step").isNull(), every).otherwise(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1))
    open_ = staged(open_.join(marks, "node"), "open")
    one = lambda s: [F.col(c).alias(c + s) for c in ("node", "size", "comp", *[f"j{i}" for i in range(HUBS)])] + [F.col("marks")[i].alias(f"m{i}{s}") for i in range(MARKS)]
    left = open_.filter("comp <> main").select("band", F.explode(F.when(F.col("step").isNull(), every).otherwise(F.array("step"))).alias("step"), *one("_l"))
    right = open_.select("band", F.explode(steps).alias("step"), *one("_r"))
    ok = (F.col("comp_l") != F.col("comp_r")) & _alike("size_l", "size_r", similarity)
    for i in range(HUBS):
        ok = ok & F.coalesce(F.abs(F.col(f"j{i}_l") - F.col(f"j{i}_r")) <= slack, F.lit(True))
    differ = sum((F.bit_count(F.col(f"m{i}_l").bitwiseXOR(F.col(f"m{i}_r"))) for i in range(1, MARKS)), F.bit_count(F.col("m0_l").bitwiseXOR(F.col("m0_r"))))
    ok = ok & (differ <= (F.col("size_l") + F.col("size_r")) * F.lit((1.0 - similarity) / (1.0 + similarity)) + F.lit(1e-6))
    joined = left.alias("l").join(right.alias("r"), (F.col("l.band") == F.col("r.band")) & (F.col("l.step") == F.col("r.step")) & ok)
    pairs = joined.select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()
    out = staged(pairs.join(known, ["a", "b"], "left_anti"), "rest")
    drop_staged(open_)
    return out


def _alike(x: str, y: str, similarity: float):
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, counted: bool = False
) -> DataFrame:
    """One row (id, th, class_id, class_size, is_first) for each row of df; th is xxhash64 of the text.

    A class is a component of the links between texts whose sets of five-word
    shingles have a Jaccard similarity of `similarity` or more (with counted:
    of multisets). class_id is the least id of the class, is_first marks the
    one document that stays: the least id, then the least hash of the text
    (all of the rows that agree in both). Null texts and texts without words
    are alone, with class_id their own id; a null id is less than any other,
    and gives a null class_id. An empty table stays empty.

    Texts with equal shingle sets are one node from the start, so copies never
    meet in pairs. Each bucket of a band links its members to HUBS hubs. In
    buckets that still hold more than one component afterwards, the pairs
    across components are compared unless their similarities to the hubs or
    their parity marks rule them out, so a bucket loses no link, whatever its
    size. Other columns of df play no part, whatever their names.
    """
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    slim = df.select(doc.alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    marks = map_columns(slim, ["text"], "node binary, size double, bands array<long>", _signed(counted), WordHashes, rows=2048)
    rows = staged(marks.select("id", "th", "node", "size", "bands"), "marks")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct("id", "th")).alias("rep"))
    nodes = staged(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *[F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("o"), "node", "size")).alias(f"hub{i}") for i in range(HUBS)])
    buckets = staged(shared.filter("n > 1"), "buckets")
    inside = staged(members.join(buckets, "band").select("band", "node", "size", F.array(*[F.struct(F.col(f"hub{i}.node").alias("node"), F.col(f"hub{i}.size").alias("size")) for i in range(HUBS)]).alias("hubs")), "inside")
    pairs = inside.select("node", "size", F.explode(F.array_distinct("hubs")).alias("hub")).filter(F.col("node") != F.col("hub.node")).filter(_alike("size", "hub.size", similarity))
    pairs = staged(pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct(), "pairs")
    # texts of the nodes that share a bucket
    wanted = inside.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep.id").alias("rid"), F.col("rep.th").alias("rth"))
    texts = slim.join(wanted, slim["id"].eqNullSafe(F.col("rid")) & (slim["th"] == F.col("rth"))).select("node", "text")
    sets = map_columns(texts, ["text"], "sh array<long>, marks array<long>", _shingle_sets(counted), WordHashes, rows=2048).select("node", "sh", "marks")
    sets = staged(sets.dropDuplicates(["node"]), "sets")
    known = staged(scored(pairs, sets), "scored")
    links = known.filter(F.col("j") >= similarity).select("a", "b")
    labels = components(links)
    # what hubs did not join
    rest = open_pairs(inside, labels, known, sets.select("node", "marks"), similarity)
    more = staged(scored(rest, sets).filter(F.col("j") >= similarity).select("a", "b"), "links")
    if more.limit(1).count():
        drop_staged(labels)
        labels = components(links.union(more))
    sized = rows.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("rows_"))
    per = nodes.select("node", "rep").join(sized, "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = staged(per.select("node", "rep", "rows_", "comp"), "members")
    # both sides are plain tables, so that Spark can split the rows of a large component
    classes = staged(per.groupBy("comp").agg(F.min("rep").alias("first"), F.sum("rows_").alias("class_size")), "classes")
    by_node = staged(per.join(classes, "comp").select("node", "first", "class_size"), "by_node")
    found = rows.join(by_node, "node", "left").select(
        "id", "th", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("first").isNull() | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))).alias("is_first"),
    )
    out = staged(found, "near")
    for x in (rows, nodes, buckets, inside, pairs, sets, known, rest, more, labels, per, classes, by_node):
        drop_staged(x)
    return out


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of df that stay, with the columns and values of df: one document of each class.

    Rows that repeat a kept document whole (id and text) stay once. Null texts
    and texts without words are each alone and stay. Columns of df may have any
    names; an empty table stays empty.
    """
    found = near_duplicates(df, id_col, text_col, similarity)
    first = found.filter("is_first").groupBy("id", "th").agg(F.count(F.lit(1)).alias("n")).withColumnsRenamed({"id": "_first_id", "th": "_first_th", "n": "_first_n"})
    keep = [id_col, text_col]
    rows = wrapped(df, keep)
    kept = rows.join(first, F.col(f"`{id_col}`").eqNullSafe(F.col("_first_id")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("_first_th")))
    repeated = kept.filter("_first_n > 1").dropDuplicates(["_first_id", "_first_th"])
    return unwrapped(kept.filter("_first_n = 1").union(repeated), df, keep)
