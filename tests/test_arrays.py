import numpy as np
import pytest

from pointloom.functions import arrays


def test_draws_are_numpys_own():
    words = np.random.default_rng(0).integers(0, 2**32, (3, 200), dtype=np.uint32)
    words[:, 0] = 0
    draws = arrays.Draws(words)
    got = np.stack([draws.random() for _ in range(4)], 1)
    want = np.stack([np.random.default_rng([int(w) for w in c]).uniform(0, 1, 5) for c in words.T])
    assert np.array_equal(got, want[:, :4])
    draws.keep(np.arange(200) % 2 == 1)
    assert np.array_equal(draws.random(), want[1::2, 4])


@pytest.mark.parametrize("held", [50, 200_000])
@pytest.mark.parametrize("cells", [0, 4_000_000])
def test_nearest_as_brute_force(monkeypatch, held, cells):
    monkeypatch.setattr(arrays, "HELD", held)
    monkeypatch.setattr(arrays, "CELLS", cells)
    rng = np.random.default_rng(1)
    for n, digits in ((1, 6), (5, 6), (300, 6), (2000, 0)):  # whole numbers: copies and ties
        p, to = np.round(rng.normal(size=(n, 3)) * 8, digits), rng.normal(size=(300, 3)) * 12
        to[:50], to[60:70] = np.round(to[:50]), to[60:70] * 20
        d = np.zeros((300, n))
        for k in range(3):
            d += (p[:, k] - to[:, k, None]) ** 2
        for most in (np.inf, 4.0, 1.0):
            row, gap = arrays.Near(p)(to, most)
            hit = d.min(1) <= most * most
            assert np.array_equal(row, np.where(hit, d.argmin(1), -1)) and np.array_equal(gap[hit], d.min(1)[hit])
