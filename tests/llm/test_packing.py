import zlib

import numpy as np
import pytest
from conftest import SF

from pointloom.llm import curve_packing as C
from pointloom.llm import queries as Q

TOKENIZER = "word_bpe_49k.json"


def whole(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path(TOKENIZER))
    tok.encode_special_tokens = False
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in docs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def held(rows, docs):
    """Every id of every document lies in one piece, sequences are gapless, none is padded."""
    ids = dict(docs)
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(own) and r["length"] > 0
        assert crc(own[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    full = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == full.get(r["sequence_id"], 0)
        full[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(full) == list(range(len(full)))
    assert all(n <= C.LENGTH and n & (n - 1) == 0 for n in full.values())


def test_every_id_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = Q.op11_curve_packing(spark, SF).collect()
    held(rows, list(zip([d["doc_id"] for d in docs], whole([d["text"] for d in docs]), strict=True)))


def test_neighbours_are_alike(spark):
    """Sequences hold fewer languages than documents dealt at random would give."""
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    by = {}
    for r in Q.op11_curve_packing(spark, SF).collect():
        by.setdefault(r["sequence_id"], []).append(r)
    same = pairs = 0
    for rows in by.values():
        rows = [r["doc_id"] for r in sorted(rows, key=lambda r: r["offset"])]
        for a, b in zip(rows, rows[1:], strict=False):
            same, pairs = same + (lang[a] == lang[b]), pairs + 1
    names = list(lang.values())
    chance = sum((names.count(x) / len(names)) ** 2 for x in set(names))
    assert same / pairs > chance + 0.2


def test_curve_is_a_walk():
    """Every cell once, and each step goes to a cell beside the last."""
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        n = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(n)] * d, indexing="ij"), -1).reshape(-1, d)
        place = C.hilbert((cells + 0.5) / n, bits)
        assert sorted(place.tolist()) == list(range(n**d))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_equal_texts_share_a_place():
    p = C.Projector()
    ids = np.array([5, 9, 9, 70, 5, 9, 9, 70, 400])
    places = C.hilbert(p.points(p.counts(ids, np.array([0] * 4 + [1] * 4 + [2]), 4)))
    assert places[0] == places[1] != places[2]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 1 << 16)
    texts = [None, "", " ", "word " * 9000, "long" * 50000, "ünï “quoted” don't 12345", "tie", "tie", "\n\n"]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(100 + i, "copy of one text " * 20, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length long")
    got = C.packed_digest(df, Q.tokenizer_path(TOKENIZER), 1).collect()
    held(got, list(zip([r[0] for r in rows], whole([r[1] for r in rows]), strict=True)))
    copies = {r["sequence_id"] for r in got if r["doc_id"] >= 100}
    assert len(copies) < 30


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "c"), (3, "same"), (3, "same"), (3, "other")]
    got = C.packed_digest(spark.createDataFrame(rows, "doc_id long, text string"), Q.tokenizer_path(TOKENIZER), 1).collect()
    want = whole([r[1] for r in rows])
    assert sum(r["length"] for r in got) == sum(map(len, want))
    tokens = {(r["doc_id"], r["doc_tokens"]) for r in got}
    assert tokens == {(r[0], len(w)) for r, w in zip(rows, want, strict=True)}


def test_empty(spark):
    assert C.packed_digest(spark.createDataFrame([], "doc_id long, text string"), Q.tokenizer_path(TOKENIZER), 1).collect() == []


@pytest.mark.parametrize("n", [1, 5, 2047, 2048])
def test_powers(n):
    assert sum(C._powers(n)) == n and all(p & (p - 1) == 0 for p in C._powers(n))
