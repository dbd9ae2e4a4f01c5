import hashlib
import random
import zlib

import pytest
from conftest import SF, same_rows

from pointloom.llm import prefix_trie as P
from pointloom.llm import queries as Q

DDL = "conv_id long, turn long, role string, text string, digest string"


def brute(rows):
    """Node rows by plain prefixes of plain lists."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), h, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids, out = {}, []
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        under = [q for q in members if q[: len(p)] == p]
        return sum(q not in kids for q in under), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q)

    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *sums(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(spark, rows):
    out = P.trie(spark.createDataFrame(rows, DDL))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def table_of(seed, convs, longest, words):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 450), convs) + [0, 100]:
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "bot"]) if t % 3 else "user", r.choice(words), "clash"))
    r.shuffle(rows)
    return rows


def test_sql(spark, duck):
    same_rows(Q.op12_prefix_trie(spark, SF), duck.sql(Q.oracle_sql()["op12_prefix_trie"]))


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    rows = table_of(seed, 60, 9, ["a", "b", "", "ä\U0001f600"])
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("run", [2, 3])
def test_runs_of_runs(spark, monkeypatch, run):
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P, "IDS", 2)
    rows = table_of(7, 40, 30, ["x", "y"]) + [(500 + i, t, "user", "same", None) for i in range(9) for t in range(27)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation", None),
        (1, None, None, None, None), (1, 0, "user", "u", None), (1, 0, "user", "u", None), (1, 0, "bot", "tie", None),
        (200, 2, "user", "long " * 20000, None), (200, None, "user", "first", None),
        (203, 1, "user", "", None), (-7, 1, "a", "b", None), (-7, 1, "ab", "", None),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert found(spark, []) == []
    # heads are taken from an absent conversation, so short conversations end at the root
    short = [c for c in range(301, 340) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "gone", None) for c in short]
    assert found(spark, rows) == [(min(short), 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, short)).encode()).hexdigest())]


def test_one_conversation_holds_most_rows(spark):
    rows = [(300, t, "user", f"turn {t % 7}", None) for t in range(3000)]
    rows += [(301 + i, t, "user", f"turn {t % 7}", None) for i in range(3) for t in range(40)]
    assert found(spark, rows) == brute_deep(rows)


def brute_deep(rows):
    """As brute, for long conversations: by tries of dictionaries."""
    own = {}
    for c, t, role, text, _ in rows:
        own.setdefault(c, []).append((t, role, text))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    root = {"kids": {}, "members": [], "ends": [], "text": "", "depth": 0, "up": None}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        at = root
        at["members"].append(c)
        for x in own.get(c - c % 100, [])[:h] + own[c][h:]:
            at = at["kids"].setdefault(x, {"kids": {}, "members": [], "ends": [], "text": x[1], "depth": at["depth"] + 1, "up": at})
            at["members"].append(c)
        at["ends"].append(c)
    order, stack = [], [root]
    while stack:
        stack += (n := stack.pop())["kids"].values()
        order.append(n)
    for n in reversed(order):
        n["leaves"] = sum(k["leaves"] for k in n["kids"].values()) or 1
        n["saved"] = sum(k["saved"] for k in n["kids"].values()) + (len(n["members"]) - 1) * len(n["text"])
    ends = lambda n: hashlib.sha256(",".join(map(str, n["ends"])).encode()).hexdigest()
    return sorted(((n["members"][0], n["depth"], n["up"] and n["up"]["members"][0], len(n["members"]), len(n["kids"]), n["leaves"], n["saved"], ends(n)) for n in order), key=str)
