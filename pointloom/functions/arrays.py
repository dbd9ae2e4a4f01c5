"""Draws of many seeded generators at once, and nearest points in arrays: numpy's own streams and distances."""

from __future__ import annotations

import numpy as np

#: Multipliers of numpy's SeedSequence (entropy, then state) and of PCG64, high and low.
_A, _B, _L, _R = (0x43B0D7E5, 0x931E8875), (0x8B51F9DD, 0x58F38DED), 0xCA01F9DD, 0x4973F715
_M = (0x2360ED051FC65DA4, 0x4385DF649FCCF645)
_LOW32 = np.uint64(0xFFFFFFFF)


class Draws:
    """np.random.default_rng of each column of words (uint32, at most four rows), all drawn together."""

    def __init__(self, words: np.ndarray):
        words = np.asarray(words, np.uint32)
        self.hash = _A
        pool = [self._hashed(words[i] if i < len(words) else np.zeros_like(words[0])) for i in range(4)]
        for i in range(4):
            for j in range(4):
                if i != j:
                    mixed = np.uint32(_L) * pool[j] - np.uint32(_R) * self._hashed(pool[i])
                    pool[j] = mixed ^ (mixed >> np.uint32(16))
        self.hash = _B
        state = [self._hashed(pool[i % 4]).astype(np.uint64) for i in range(8)]
        high, low, inc_high, inc_low = (state[i] | state[i + 1] << np.uint64(32) for i in range(0, 8, 2))
        one = np.uint64(1)
        self.inc = inc_high << one | inc_low >> np.uint64(63), inc_low << one | one
        self.state = self._sum(self.inc, (high, low))
        self._step()

    def _hashed(self, value: np.ndarray) -> np.ndarray:
        at, times = self.hash
        self.hash = (at * times & 0xFFFFFFFF, times)
        value = (value ^ np.uint32(at)) * np.uint32(self.hash[0])
        return value ^ (value >> np.uint32(16))

    @staticmethod
    def _sum(a: tuple, b: tuple) -> tuple:
        low = a[1] + b[1]
        return a[0] + b[0] + (low < a[1]), low

    def _step(self) -> None:
        """state * multiplier + increment, in 128 bits."""
        high, low = self.state
        a0, a1 = low & _LOW32, low >> np.uint64(32)
        b0, b1 = np.uint64(_M[1] & 0xFFFFFFFF), np.uint64(_M[1] >> 32)
        mid = a0 * b1 + (a0 * b0 >> np.uint64(32))
        other = a1 * b0 + (mid & _LOW32)
        top = a1 * b1 + (mid >> np.uint64(32)) + (other >> np.uint64(32))
        self.state = self._sum((top + low * np.uint64(_M[0]) + high * np.uint64(_M[1]), low * np.uint64(_M[1])), self.inc)

    def random(self) -> np.ndarray:
        """The next double of each generator, from 0 to below 1."""
        self._step()
        high, low = self.state
        turn, x = high >> np.uint64(58), high ^ low
        x = x >> turn | x << (np.uint64(64) - turn & np.uint64(63))
        return (x >> np.uint64(11)) * (1.0 / (1 << 53))

    def keep(self, rows: np.ndarray) -> None:
        """Go on with some of the generators."""
        self.state, self.inc = (tuple(w[rows] for w in words) for words in (self.state, self.inc))


#: Candidates that a search looks at together.
HELD = 200_000

#: Cells that have a table.
CELLS = 4_000_000


class Near:
    """Nearest of the points (n x 3, finite), ties to the first, by cells that double until nothing nearer can lie outside."""

    def __init__(self, points: np.ndarray):
        self.points = np.ascontiguousarray(points, float)
        self.low, high = self.points.min(0), self.points.max(0)
        self.span = float((high - self.low).max())
        spread = np.maximum(self.points.std(0), self.span / 1000)
        # about a point a cell where a cloud is dense
        self.side = max(float(np.cbrt(15.7 * spread.prod() / len(points))), self.span / 2000, 1e-9)
        self.tables: dict[int, tuple] = {}

    def _table(self, level: int) -> tuple:
        """Side, cells along each axis with a rim of one, sorted cells of the rows, rows by cells, and the first of each cell."""
        if level not in self.tables:
            side = self.side * 2.0**level
            cells = np.floor((self.points - self.low) / side).astype(np.int64) + 1
            shape = cells.max(0) + 2
            at = (cells[:, 0] * shape[1] + cells[:, 1]) * shape[2] + cells[:, 2]
            order = np.argsort(at, kind="stable")
            size = int(shape.prod())
            # few cells have a table of their first rows, many are searched for
            first = np.append(0, np.cumsum(np.bincount(at, minlength=size), dtype=np.int32)).astype(np.int32) if size <= CELLS else None
            self.tables[level] = side, shape, at[order], order, first
        return self.tables[level]

    def __call__(self, to: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest point and squared distance of each place (n x 3); -1 where none is within `most`."""
        row, gap = np.full(len(to), -1, np.int64), np.full(len(to), np.inf)
        left, level = np.arange(len(to)), 0
        if most < np.inf:  # first leave out what has nothing around it
            left = left[self._runs(to, left, max(0, int(np.ceil(np.log2(max(most / self.side, 1e-9) * 1.000001)))))[1].any(1)]
        while len(left):
            side = self._table(level)[0]
            self._search(to, left, level, row, gap)
            # the cells around a place reach `side` beyond it
            left = left[~(gap[left] < side * side * (1 - 1e-9))]
            if side > most or side > self.span + np.abs(to[left] - self.low).max(initial=0.0):
                break
            level += 1
        row[~(gap <= most * most)] = -1
        return row, gap

    def _runs(self, to: np.ndarray, left: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and number of the sorted rows in each of nine lines of cells around a place."""
        side, shape, at, _, first = self._table(level)
        cell = np.floor((to[left] - self.low) / side).astype(np.int64) + 1
        starts, counts = [], []
        low, high = np.clip(cell[:, 2] - 1, 0, shape[2]), np.clip(cell[:, 2] + 2, 0, shape[2])
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                x, y = cell[:, 0] + i, cell[:, 1] + j
                line = np.where((x >= 0) & (x < shape[0]) & (y >= 0) & (y < shape[1]), (x * shape[1] + y) * shape[2], 0)
                ends = line + low, line + high
                lo, hi = (np.searchsorted(at, e) if first is None else first[e] for e in ends)
                starts.append(lo)
                counts.append(np.where(line > 0, hi - lo, 0))  # the first line is rim
        return np.stack(starts, 1).astype(np.int64), np.stack(counts, 1).astype(np.int64)

    def _search(self, to: np.ndarray, left: np.ndarray, level: int, row: np.ndarray, gap: np.ndarray) -> None:
        order = self._table(level)[3]
        starts, counts = self._runs(to, left, level)
        if not len(left) or not counts.any():
            return
        total = np.cumsum(counts.sum(1))
        cuts = [0, *np.searchsorted(total, np.arange(HELD, total[-1], HELD)).tolist(), len(left)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            n = counts[first:last].ravel()
            ends = np.cumsum(n)
            if first == last or not ends[-1]:
                continue
            of = np.repeat(starts[first:last].ravel() - (ends - n), n) + np.arange(ends[-1])
            found = order[of]
            per = counts[first:last].sum(1)
            has = np.flatnonzero(per)
            edge = (np.cumsum(per) - per)[has]
            places = to[left[first:last]]
            d = np.zeros(len(found))
            for k in range(3):
                step = self.points[found, k] - np.repeat(places[:, k], per)
                d += step * step
            least = np.minimum.reduceat(d, edge)
            tied = np.where(d == np.repeat(least, per[has]), found, len(self.points))
            which = left[first:last][has]
            gap[which], row[which] = least, np.minimum.reduceat(tied, edge)
