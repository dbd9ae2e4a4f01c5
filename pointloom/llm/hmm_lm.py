"""Hidden Markov language model over all training texts, with exact likelihoods.

Tokens are bytes words, lower-cased in A-Z, and one end for each text. A token
has a class: itself if it is among the HEAD most frequent, else one of TAILS
classes by its last two bytes. Latent states emit classes, and a class emits
its tokens in proportion to their counts plus one (with one place for unseen
tokens), so state tables stay bounded while the counts cover the vocabulary:

    log p(text) = log p_HMM(classes) + sum of log((c + 1) / D(class))

Every Baum-Welch step sums its counts over the partitions of all training
texts, each text whole: the segments of a long one pass their states on by
transfer matrices. The scaled forward recursion gives log p_HMM over the whole
text. The counts of the KNOWN most frequent tokens go to the workers; rarer
tokens meet the count table in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_staged, map_columns, staged

HEAD, TAILS, STATES = 4096, 256, 4
#: Tokens at most whose counts the workers hold, 16 bytes each.
KNOWN = 1_000_000
#: Baum-Welch steps, each over all training texts; segments of long texts; about as many tokens are held at a time.
STEPS, SEGMENT, HELD = 14, 512, 1_000_000
END = b"\n"  # no word has it


def hash_of(token: bytes) -> int:
    h = xxhash.xxh64_intdigest(token)
    return h - (1 << 64) if h >> 63 else h


def tail_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % TAILS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts, joined within a task until they reach a bound."""

    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([hash_of(t) for t in c], pa.int64()), pa.array([tail_of(t) for t in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["h", "b", "n"]
        )

    held: Counter = Counter()
    for batch in batches:
        for t in as_bytes(batch.column(0)):
            held.update((t or b"").lower().split())
            held[END] += 1
            if len(held) > 300_000:
                yield out(held)
                held = Counter()
    if held:
        yield out(held)


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(h, b, c): hash, tail class and count of every training token."""
    parts = df.select(F.col(text_col)).mapInArrow(_counts, "h long, b int, n long")
    return parts.groupBy("h", "b").agg(F.sum("n").alias("c"))


class Codes(dict):
    """Numbers for tokens as they come; their classes, hashes and counts are arrays by number."""

    def __init__(self, head: dict[int, int], known: tuple[np.ndarray, np.ndarray] | None = None, most: int = 300_000):
        super().__init__()
        self.head, self.known, self.most = head, known, most
        self.words: list[bytes] = []
        self.cls, self.hash, self.log_c1 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def __missing__(self, token: bytes) -> int:
        self[token] = i = len(self.cls) + len(self.words)
        self.words.append(token)
        return i

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of the texts, one after the other, and how many each text has."""
        if len(self) > self.most:
            self.clear()
            self.words = []
            self.cls, self.hash, self.log_c1 = self.cls[:0], self.hash[:0], self.log_c1[:0]
        get, flat, sizes = self.__getitem__, [], []
        for t in texts:
            words = t.lower().split() if t else []
            flat.append(np.fromiter(map(get, words), np.int64, len(words)))
            sizes.append(len(words))
        if self.words:
            self._learn()
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), np.array(sizes, np.int64)

    def _learn(self) -> None:
        hashes = [hash_of(w) for w in self.words]
        cls = [c if (c := self.head.get(h)) is not None else HEAD + tail_of(w) for h, w in zip(hashes, self.words, strict=True)]
        h = np.array(hashes, np.int64)
        log_c1 = np.full(len(h), np.nan)  # NaN: not among the known
        if self.known is not None and len(self.known[0]):
            at = np.minimum(np.searchsorted(self.known[0], h), len(self.known[0]) - 1)
            log_c1 = np.where(self.known[0][at] == h, self.known[1][at], np.nan)
        self.cls, self.hash, self.log_c1 = np.append(self.cls, np.array(cls, np.int64)), np.append(self.hash, h), np.append(self.log_c1, log_c1)
        self.words = []


@dataclass
class Params:
    start: np.ndarray  # K: of a text
    move: np.ndarray  # K x K
    emit: np.ndarray  # classes x K


CLASSES = HEAD + TAILS + 1
END_CLASS = CLASSES - 1


def first_params(freq: np.ndarray, seed: int = 8) -> Params:
    rng = np.random.default_rng(seed)
    e = freq[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, STATES)))
    k = np.full((STATES, STATES), 0.05)
    np.fill_diagonal(k, 1.0)
    return Params(np.full(STATES, 1 / STATES), k / k.sum(1, keepdims=True), e / e.sum(0))


def _packed(seqs: list[np.ndarray]):
    """Longest first, and how many are as long as each step."""
    sizes = np.array([len(s) for s in seqs])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left") if len(sizes) else np.zeros(0, int)
    return order, flat, starts, active


def log_likelihoods(p: Params, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 p of each sequence (none empty) by the scaled forward recursion."""
    order, flat, starts, active = _packed(seqs)
    total = np.zeros(len(seqs))
    a, move, emit = np.repeat(p.start[:, None], len(seqs), 1), np.ascontiguousarray(p.move.T), np.ascontiguousarray(p.emit.T)
    for t, n in enumerate(active):
        a = (move @ a[:, :n] if t else a) * emit.take(flat[starts[:n] + t], 1)
        c = a.sum(0)
        a *= 1.0 / c
        total[:n] += np.log10(c)
    out = np.zeros(len(seqs))
    out[order] = total
    return out


def _transfer(p: Params, flat: np.ndarray, starts: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Matrices (n x K x K, up to a factor) of packed segments, from the state that their first token is drawn in to that of the next token."""
    n = len(starts)
    a = np.repeat(np.eye(STATES)[:, :, None], n, 2)  # state, entry state, segment
    out = np.empty((STATES, STATES, n))
    emit = np.ascontiguousarray(p.emit.T)
    for t, m in enumerate(active):
        a = a[:, :, :m] * emit[:, flat[starts[:m] + t]][:, None, :]
        a = (p.move.T @ a.reshape(STATES, -1)).reshape(STATES, STATES, m)
        a /= a.sum((0, 1))
        ends = active[t + 1] if t + 1 < len(active) else 0
        out[:, :, ends:m] = a[:, :, ends:]
    return np.ascontiguousarray(out.transpose(2, 1, 0))


def _left(p: Params, segs: np.ndarray) -> np.ndarray:
    """The state (K x n) that the token after each of n segments of one length is drawn in, where the segments begin texts."""
    a, move, emit = p.start[:, None], np.ascontiguousarray(p.move.T), np.ascontiguousarray(p.emit.T)
    for of in np.ascontiguousarray(segs.T).astype(np.int64):
        a = move @ (a * emit.take(of, 1))
        a *= 1.0 / a.sum(0)
    return a


def _needed(p: Params, segs: list[np.ndarray]) -> np.ndarray:
    """The likelihood (K x n, up to a factor) of segments that end texts, given the state of their first token."""
    order, flat, starts, active = _packed(segs)
    emit, v = np.ascontiguousarray(p.emit.T), np.ones((STATES, 0))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        v = p.move @ np.concatenate([v, np.ones((STATES, n - v.shape[1]))], 1) if n > v.shape[1] else p.move @ v
        v *= emit.take(flat[starts[:n] + t], 1)
        v *= 1.0 / v.sum(0)
    out = np.empty_like(v)
    out[:, order] = v
    return out


def _boundaries(p: Params, seqs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Segments of all texts, the state that each begins in, what follows each (given the state after it; 0 where nothing does), and which begin a text."""
    segs, counts = [], []
    for s in seqs:
        k = max(1, -(-len(s) // SEGMENT))
        counts.append(k)
        segs += [s[i * SEGMENT : (i + 1) * SEGMENT] for i in range(k)]
    counts = np.array(counts)
    at = np.cumsum(counts) - counts
    first = np.zeros(len(segs), bool)
    first[at] = True
    begin, after = np.repeat(p.start[:, None], len(segs), 1), np.zeros((STATES, len(segs)))
    long = np.flatnonzero(counts > 1)
    if len(long):
        # only what lies between a text's first and last segment needs its matrix
        heads, ends = at[long], at[long] + counts[long] - 1
        u, v = _left(p, np.stack([segs[k] for k in heads])), _needed(p, [segs[k] for k in ends])
        begin[:, heads + 1], after[:, ends - 1] = u, v
        mine = np.concatenate([np.arange(i + 1, j) for i, j in zip(heads, ends, strict=True)])
        if len(mine):
            order, flat, starts, active = _packed([segs[k] for k in mine])
            m = np.empty((len(mine), STATES, STATES))
            m[order] = _transfer(p, flat, starts, active)
            matrix = dict(zip(mine.tolist(), m, strict=True))
        for i, j in zip(heads.tolist(), ends.tolist(), strict=True):
            for k in range(i + 1, j):
                u = begin[:, k] @ matrix[k]
                begin[:, k + 1] = u / u.sum()
            for k in range(j - 1, i, -1):
                v = matrix[k] @ after[:, k]
                after[:, k - 1] = v / v.sum()
    return segs, begin, after, first


def expected(p: Params, seqs: list[np.ndarray], likelihood: bool = True):
    """Baum-Welch counts over whole texts: starts, moves, emissions and, if asked for, the log likelihood."""
    segs, begin, after, first = _boundaries(p, seqs)
    order, flat, starts, active = _packed(segs)
    begin, after, first = begin[:, order], after[:, order], first[order]
    at = np.concatenate([[0], np.cumsum(active)])
    step = [slice(i, j) for i, j in zip(at, at[1:])]
    obs = np.concatenate([flat[starts[:n] + t] for t, n in enumerate(active)])
    scaled, alphas, c = np.ascontiguousarray(p.emit.T).take(obs, 1), np.empty((STATES, len(obs))), np.empty(len(obs))
    a, move = begin, np.ascontiguousarray(p.move.T)
    for t, n in enumerate(active):
        here = step[t]
        a = np.multiply(move @ a[:, :n] if t else a, scaled[:, here], out=alphas[:, here])
        a.sum(0, out=c[here])
        inverse = 1.0 / c[here]
        a *= inverse
        scaled[:, here] *= inverse
    # the last state of a segment that another follows: weighed by what follows, and moved once more
    last = np.concatenate([np.repeat(t, n - (active[t + 1] if t + 1 < len(active) else 0)) for t, n in enumerate(active)])[::-1]  # by segment
    end = alphas[:, at[last] + np.arange(len(segs))]
    goes_on = after.any(0)
    ahead = np.where(goes_on, p.move @ after, 1.0)
    weight = (end * ahead).sum(0)
    moves = (end[:, goes_on] / weight[goes_on]) @ after[:, goes_on].T
    final = ahead / weight
    beta = final[:, : active[-1]]
    for t in range(len(active) - 2, -1, -1):
        n = active[t + 1]
        be = scaled[:, step[t + 1]] * beta
        moves += alphas[:, step[t]][:, :n] @ be.T
        alphas[:, step[t + 1]] *= beta
        beta = np.concatenate([p.move @ be, final[:, n : active[t]]], 1)
    alphas[:, step[0]] *= beta
    emit = np.stack([np.bincount(obs, g, CLASSES) for g in alphas], 1)
    return alphas[:, step[0]][:, first].sum(1), moves * p.move, emit, float(np.log(c).sum()) if likelihood else None


def updated(starts: np.ndarray, moves: np.ndarray, emit: np.ndarray, freq: np.ndarray) -> Params:
    s, m = starts + 1.0, moves + 1.0
    e = emit + 10.0 * freq[:, None]
    return Params(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def _full_step(p: Params):
    """Counts of one task as rows by class: 0.. the emissions, then one row for starts and the moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for whole in batches:
            seqs = [np.frombuffer(x, "<u2") for x in whole.column(0).to_pylist()]
            part = np.cumsum([len(s) for s in seqs]) // HELD
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(seqs)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    got = expected(p, seqs[i:j], False)[:3]
                    sums = got if sums is None else tuple(x + y for x, y in zip(sums, got, strict=True))
        if sums is not None:
            v = np.concatenate([sums[2], sums[0][None], sums[1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), *[pa.array(v[:, k]) for k in range(STATES)]], names=["row", *[f"v{k}" for k in range(STATES)]])

    return run


@dataclass
class Vocabulary:
    head: dict[int, int]  # hash to class
    known: tuple[np.ndarray, np.ndarray]  # sorted hashes of the most frequent tokens, log10(c + 1) of each
    log_d: np.ndarray  # log10 D of each class
    train_tokens: int
    distinct: int
    end_count: int

    @property
    def freq(self) -> np.ndarray:
        d = 10.0**self.log_d
        return d / d.sum()


@dataclass
class Model:
    params: Params
    vocabulary: Vocabulary


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Classes and what the workers have to know of the staged token counts."""
    end = hash_of(END)
    row = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("h") == end, F.col("c"))).alias("e")).first()
    total, distinct, end_count = row["n"] or 0, row["v"], row["e"] or 0
    top = counts.filter(F.col("h") != end).orderBy(F.desc("c"), "h").limit(HEAD).collect()
    head = {r["h"]: i for i, r in enumerate(top)}
    d = np.ones(CLASSES)
    d[: len(top)] = [r["c"] + 1 for r in top]
    spent = {}
    for r in top:
        n, v = spent.get(r["b"], (0, 0))
        spent[r["b"]] = (n + r["c"], v + 1)
    for r in counts.filter(F.col("h") != end).groupBy("b").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n, v = spent.get(r["b"], (0, 0))
        d[HEAD + r["b"]] = (r["n"] - n) + (r["v"] - v) + 1
    d[END_CLASS] = end_count + 1
    return Vocabulary(head, _known(counts, KNOWN), np.log10(d), total, distinct, end_count)


def train(seqs: DataFrame, voc: Vocabulary) -> Params:
    """Parameters after STEPS Baum-Welch steps over all rows of the staged column seq."""
    p = first_params(voc.freq)
    if not voc.end_count:
        return p
    for _ in range(STEPS):
        sums = seqs.mapInArrow(_full_step(p), "row int, " + ", ".join(f"v{k} double" for k in range(STATES)))
        got = sums.groupBy("row").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(STATES)]).orderBy("row").toPandas()  # CLASSES + STATES + 1 rows
        v = got[[f"v{k}" for k in range(STATES)]].to_numpy()
        p = updated(v[CLASSES], v[CLASSES + 1 :], v[:CLASSES], voc.freq)
    return p


def fit(docs: DataFrame, text_col: str, counts: DataFrame) -> Model:
    """Model from the training rows and their staged token counts."""
    voc = vocabulary(counts)
    seqs = staged(coded(docs.select(F.col(f"`{text_col}`").alias("text")), voc).select("seq"), "classes")
    p = train(seqs, voc)
    drop_staged(seqs)
    return Model(p, voc)


def _known(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log10(c + 1) of all tokens of a count or more, the least count such that they are `most` at most.

    How many tokens have each count is a table of a few rows, as counts repeat:
    n different ones need n (n + 1) / 2 tokens.
    """
    by = counts.groupBy(F.least("c", F.lit(most)).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).collect()
    least, held = None, 0
    for r in by:
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    top = counts.filter(F.col("c") >= least).select("h", "c").toArrow()
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], np.log10(c[order] + 1.0)


_TAIL = pa.struct([("h", pa.int64()), ("n", pa.int64())])


def _code(voc: Vocabulary, codes: Codes, text: pa.Array) -> list:
    ids, sizes = codes.of(as_bytes(text))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    cls, log_c1 = codes.cls[ids], codes.log_c1[ids]
    rare = np.isnan(log_c1)
    # the rare tokens of each text, once with their number
    both, n = np.unique(doc[rare] * np.int64(len(codes.cls) + 1) + ids[rare], return_counts=True)
    owner, token = both // (len(codes.cls) + 1), both % (len(codes.cls) + 1)
    offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
    tails = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(codes.hash[token], pa.int64()), pa.array(n, pa.int64())], fields=list(_TAIL)))
    total = lambda w: np.bincount(doc, w, len(sizes))
    known = total((~rare).astype(float)).astype(np.int64) + int(voc.end_count > 0)
    small, end, at, seqs = cls.astype("<u2"), np.array([END_CLASS], "<u2").tobytes(), 0, []
    for k in sizes.tolist():
        seqs.append(small[at : at + k].tobytes() + end)
        at += k
    s0 = total(np.where(rare, 0.0, log_c1)) + math.log10(voc.end_count + 1)
    d0 = total(voc.log_d[cls]) + voc.log_d[END_CLASS]
    return [pa.array(seqs, pa.binary()), pa.array(sizes + 1), pa.array(known), pa.array(s0), pa.array(d0), tails]


_CODED = "seq binary, n_tokens long, known long, s0 double, d0 double, tail array<struct<h long, n long>>"


def coded(df: DataFrame, voc: Vocabulary) -> DataFrame:
    """df (text, ...) with the classes of each whole text and its end, the sums of what the workers know, and the rare tokens, in place of the text."""
    shared = df.sparkSession.sparkContext.broadcast(voc)  # HEAD and KNOWN entries at most
    return map_columns(df, ["text"], _CODED, lambda codes, t: _code(shared.value, codes, t), lambda: Codes(shared.value.head, shared.value.known), rows=8192).drop("text")


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows that are not held out. Null and empty texts are the
    end alone. Without training rows every token has probability 1 in the base
    and the state tables keep their first values. Rows that agree in id and
    text get the same figures; an empty table stays empty, and other columns
    play no part. The rare tokens of a text meet the counts in a join on the
    token's hash; frequent tokens are scored where the text is read, so no key
    of the join is hot.
    """
    text = F.col(f"`{text_col}`")
    base = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    counts = staged(token_counts(base.filter(~F.col("held_out")), "text"), "tokens")
    voc = vocabulary(counts)
    texts = staged(coded(base.withColumn("th", F.xxhash64("text")), voc), "classes")
    params = train(texts.filter(~F.col("held_out")).select("seq"), voc)
    shared = df.sparkSession.sparkContext.broadcast(params)

    def likelihood(seq: pa.Array) -> list:
        return [pa.array(log_likelihoods(shared.value, [np.frombuffer(x, "<u2") for x in seq.to_pylist()]) if len(seq) else np.zeros(0))]

    scored = map_columns(texts, ["seq"], "hmm double", likelihood, rows=8192).withColumn("hmm", F.col("hmm") - F.col("d0"))
    mark = F.struct(F.xxhash64("id", "th", F.lit("mark")).alias("h"), F.lit(0).cast("long").alias("n"))
    rows = scored.select("id", "th", "held_out", "n_tokens", "known", "s0", "hmm", F.explode(F.concat(F.array(mark), "tail")).alias("x"))
    only = lambda c: F.when(F.col("x.n") == 0, F.col(c)).alias(c)
    rows = rows.select("id", "th", F.col("x.h").alias("h"), F.col("x.n").alias("n"), *[only(c) for c in ("held_out", "n_tokens", "known", "s0", "hmm")])
    met = rows.join(counts.select("h", "c"), "h", "left")
    seen = F.col("c").isNotNull() & (F.col("n") > 0)
    per = met.groupBy("id", "th").agg(
        F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("times"),
        F.first("held_out", True).alias("held_out"), *[F.max(c).alias(c) for c in ("n_tokens", "known", "s0", "hmm")],
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("rare"), F.sum(F.when(seen, F.col("n") * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("s1"),
    )
    total = F.col("s0") + F.col("s1") / F.col("times")
    z = math.log10(voc.train_tokens + voc.distinct + 1)
    return per.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + (F.col("rare") / F.col("times")).cast("long")).alias("n_known"),
        F.lit(voc.train_tokens).cast("long").alias("train_tokens"), (total - F.col("n_tokens") * z).alias("base_score"), (F.col("hmm") + total).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_copy"),
    ).drop("_copy")
