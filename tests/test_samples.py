import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from pointloom.operators import nulls
from pointloom.operators import samples as S


def ranks(x):
    order = sorted(x)
    return [(order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in x]


def brute_signed(d):
    r = ranks([abs(x) for x in d])
    w = sum(k for k, x in zip(r, d, strict=True) if x > 0)
    all_w = [sum(k for k, s in zip(r, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
    return min(1.0, 2 * min(sum(x <= w for x in all_w), sum(x >= w for x in all_w)) / len(all_w))


def brute_sum(a, b):
    r = ranks(a + b)
    own, pool = sum(r[: len(a)]), list(itertools.combinations(r, len(a)))
    return min(1.0, 2 * min(sum(sum(c) <= own + 1e-9 for c in pool), sum(sum(c) >= own - 1e-9 for c in pool)) / len(pool))


def of(df, *names):
    return {r["g"]: tuple(r[n] for n in names) for r in df.collect()}


def test_signed_rank(spark):
    r = random.Random(1)
    groups = {f"n{n}": [r.uniform(-1, 2) for _ in range(n)] for n in (2, 5, 9)} | {"five": [1.0, 2.0, 3.0, 4.0, 5.0], None: [1.0, -2.0, 3.5]}
    odd = {"zero": [0.0, 0.0, 1e-10], "single": [1.0], "tied": [1.0, 1.0, -1.0, 2.0], "lost": [None, float("nan")]}
    rows = [(g, x) for g, xs in (groups | odd).items() for x in xs]
    got = of(S.signed_rank(spark.createDataFrame(rows, "g string, x double"), ["g"], "x"), "n", "p", "exact", "least_p")
    for g, xs in groups.items():
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(brute_signed(xs)) and got[g][2]
    assert got["five"][1] == 0.0625 == got["five"][3]
    assert got["zero"][1] == 1.0 and got["single"][1] is None and got["lost"][:2] == (0, None)
    z = (7.5 - 5) / math.sqrt(4 * 5 * 9 / 24 - (27 - 3) / 48)  # |1|, |1|, |1| share rank 2
    assert not got["tied"][2] and got["tied"][1] == pytest.approx(math.erfc(abs((2 + 2 + 4 - 5) / math.sqrt(7.5 - 0.5)) / math.sqrt(2))) and z


def test_rank_sum(spark):
    r = random.Random(2)
    groups = {f"{n}x{m}": ([r.random() for _ in range(n)], [r.random() + 0.3 for _ in range(m)]) for n, m in ((2, 2), (3, 5), (6, 4))}
    rows = [(g, k == 0, x) for g, ab in groups.items() for k in (0, 1) for x in ab[k]]
    rows += [("one", True, 1.0), ("one", False, 2.0), ("one", False, 3.0), ("side", True, 1.0), ("side", True, 2.0), ("equal", True, 1.0), ("equal", True, 1.0), ("equal", False, 1.0), ("equal", False, 1.0), ("lone", None, 1.0), ("lone", True, None)]
    big = [("big", i % 2 == 0, r.gauss(i % 2 * 0.3, 1)) for i in range(60)]
    df = spark.createDataFrame(rows + big, "g string, k boolean, x double")
    got = of(S.rank_sum(df, ["g"], "k", "x"), "n1", "n2", "p", "exact")
    for g, (a, b) in groups.items():
        assert got[g] == (len(a), len(b), pytest.approx(brute_sum(a, b)), True)
    assert got["one"][2] == got["side"][2] == got["equal"][2] == 1.0 and "lone" not in got
    a, b = [x for _, k, x in big if k], [x for _, k, x in big if not k]
    u = sum(x > y for x in a for y in b)
    assert got["big"][2] == pytest.approx(math.erfc((abs(u - 450) - 0.5) / math.sqrt(900 * 61 / 12) / math.sqrt(2))) and not got["big"][3]


def test_older_tests_survive_odd_groups(spark):
    rows = [("flat", i, True, 1.0, float(i)) for i in range(4)] + [("one", 9, True, 1.0, 2.0)] + [("side", i, True, float(i), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, k boolean, x double, y double")
    assert {r["g"]: r["tau"] for r in nulls.kendall(df, ["g"], "x", "y", "id").collect()} == {"flat": None, "side": None}
    assert {r["p"] for r in nulls.mann_whitney(df, ["g"], "k", "x").collect()} == {1.0}
    assert nulls.wilcoxon_signed(df, ["g"], "x").count() == 3


def brute_normality(x):
    x = sorted(x)
    n, nd = len(x), NormalDist()
    mean = sum(x) / n
    m = [nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    u, mm = 1 / math.sqrt(n), sum(v * v for v in m)
    poly = lambda c: sum(k * u**i for i, k in enumerate(c))
    a = [0.0] * n
    if n == 3:
        a = [-math.sqrt(0.5), 0, math.sqrt(0.5)]
    else:
        a[-1] = poly(S.ROYSTON_A1) + m[-1] / math.sqrt(mm)
        ends = 1
        if n > 5:
            a[-2], ends = poly(S.ROYSTON_A2) + m[-2] / math.sqrt(mm), 2
        phi = (mm - 2 * sum(v * v for v in m[-ends:])) / (1 - 2 * sum(v * v for v in a[-ends:]))
        for i in range(ends, n - ends):
            a[i] = m[i] / math.sqrt(phi)
        for i in range(ends):
            a[i] = -a[n - 1 - i]
    w = sum(p * q for p, q in zip(a, x, strict=True)) ** 2 / sum((v - mean) ** 2 for v in x)
    z = [(v - mean) / math.sqrt(sum((q - mean) ** 2 for q in x) / (n - 1)) for v in x]
    a2 = -n - sum((2 * i - 1) / n * (math.log(nd.cdf(z[i - 1])) + math.log(1 - nd.cdf(z[n - i]))) for i in range(1, n + 1))
    return w, a2


def test_normality(spark):
    r = random.Random(3)
    groups = {f"n{n}": [round(r.gauss(0, 1), 1 if n > 20 else 6) for _ in range(n)] for n in (3, 4, 5, 6, 11, 12, 40, 300)}
    groups["weights"] = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    groups["skewed"] = [r.expovariate(1) for _ in range(100)]
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("flat", 1.0)] * 9 + [("two", 1.0), ("two", 2.0), ("none", None), ("none", float("nan"))]
    got = of(S.normality(spark.createDataFrame(rows, "g string, x double"), ["g"], "x"), "n", "w", "p_w", "a2", "k2", "p_k2", "a2_critical")
    for g, xs in groups.items():
        w, a2 = brute_normality(xs)
        assert got[g][0] == len(xs) and got[g][1] == pytest.approx(w) and got[g][3] == pytest.approx(a2)
        assert (got[g][4] is None) == (len(xs) < 8)
    # published figures of this sample
    assert got["weights"][1] == pytest.approx(0.79, abs=0.005) and got["weights"][2] == pytest.approx(0.0067, abs=0.0005)
    assert got["skewed"][2] < 1e-4 and got["skewed"][5] < 1e-4 and got["skewed"][3] > got["skewed"][6]
    assert got["n300"][2] > 0.01 and got["n300"][3] < got["n300"][6]
    assert got["flat"][1] is got["flat"][3] is got["flat"][4] is None and got["two"][1] is None and "none" not in got


def test_exact_tails():
    for n in range(1, 9):
        sums = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert np.allclose(S.signed_rank_tail(n), [sum(s <= w for s in sums) / 2**n for w in range(n * (n + 1) // 2 + 1)])
    for n1, n2 in ((1, 4), (3, 3), (5, 2)):
        us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        assert np.allclose(S.rank_sum_tail(n1, n2), [sum(u <= k for u in us) / len(us) for k in range(n1 * n2 + 1)])


def test_ranks_over_ranges(spark):
    r = random.Random(4)
    rows = [("hot", float(r.randint(0, 400))) for _ in range(3000)] + [("hot", 7.0)] * 1500 + [(None, -0.0), (None, 0.0)]
    got = {(x["g"], x["x"]): (x["first"], x["last"]) for x in S.tied_ranks(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    xs = sorted(x for g, x in rows if g)
    assert all(got[("hot", v)] == (xs.index(v) + 1, len(xs) - xs[::-1].index(v)) for v in set(xs)) and got[(None, 0.0)] == (1, 2)
