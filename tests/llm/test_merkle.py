import hashlib
import random
import zlib

import pytest
from conftest import SF, same_rows

from pointloom.llm import merkle as M
from pointloom.llm import queries as Q

DDL = "doc_id long, text string, lang string, source string, n_chars long, root string"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(level):
    """All levels of a tree."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        at = i - i % 3
        yield level[at:i], level[i + 1 : at + 3]
        i //= 3


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        other = text.replace("\n", "") if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else text
        groups.setdefault((source is not None, (source or "").encode()), []).append(((doc_id is not None, doc_id or 0), leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, other, lang, source, n_chars), doc_id))
    if not groups:
        return []
    names = sorted(groups)
    trees = {s: grown([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    top = grown([trees[s][-1][0] for s in names])
    root, out = top[-1][0], []
    for k, s in enumerate(names):
        for i, (_, own, other, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:2])):
            at, beside = other, []
            for left, right in [*steps(trees[s], i), *steps(top, k)]:
                at = H(*left, at, *right)
                beside += [*left, *right]
            out.append((doc_id, own, trees[s][-1][0], root, H(*beside), at, at == root))
    return sorted(out, key=str)


def found(spark, rows, **more):
    out = M.manifest(spark.createDataFrame(rows, DDL), **more)
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def table_of(seed, n, sources, ids):
    r = random.Random(seed)
    return [(r.choice(ids), r.choice(["a\nb", "", None, "x", "\n", "ü\n" * 3]), r.choice(["en", None]), r.choice(sources), r.choice([None, 3, -4]), "clash") for _ in range(n)]


def test_sql(spark, duck):
    same_rows(Q.op13_merkle_manifest(spark, SF), duck.sql(Q.oracle_sql()["op13_merkle_manifest"]))


def test_ranks_below_the_oracle(spark):
    out = Q.op13_merkle_manifest(spark, SF)
    assert 0 < out.filter("verified").count() < out.count()


@pytest.mark.parametrize("n", [1, 3, 4, 800])
def test_one_source(spark, n):
    rows = [(i * 37, f"t{i}\n", "en", "s", i, None) for i in range(n)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_odd_rows(spark, seed):
    ids = [None, 0, 1, -1, 7, 255, 256, 70000, -(2**63), 2**63 - 1, 5_000_000_000]
    rows = table_of(seed, 300, [None, "", "a", "é", "z", "\U0001f600"], ids)
    assert found(spark, rows) == brute(rows)


def test_rounds_of_cells_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "MANY", 20)
    rows = table_of(3, 120, ["hot"], list(range(0, 5000, 7))) + table_of(4, 90, [f"s{i}" for i in range(30)], [4, None]) + [(9, "same\n", "en", "hot", 1, None)] * 60
    assert found(spark, rows, steps=2) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
