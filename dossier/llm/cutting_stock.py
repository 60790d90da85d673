"""Patterns of lengths that fill sequences, by column generation.

The linear program covers a histogram of lengths by patterns, multisets of lengths that fit in a sequence, and by a line
on which documents lie end to end and are cut where sequences end. A pattern costs its sequence, and what lies on the
line costs its length and a premium, so a length is cut only where patterns would pad more. Columns are priced at the
duals of the lengths by a knapsack program.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: What a place on the line costs; patterns may pad up to the premium.
LINE_COST = 1.01
#: Rows of the program at most: beyond, lengths are counted in larger units.
MOST_ROWS = 512
#: Share by which the program may cost more than the best one.
TOLERANCE = 0.001
#: Rounds of pricing at most; the levels are feasible after each.
MOST_ROUNDS = 400
#: Patterns taken from one knapsack table at most.
_TAKEN = 32
_SMALL = 1e-7

Pattern = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Plan:
    """Sequences of `size` units of `unit` tokens. patterns: how many of which lengths, and in how many sequences; line:
    how many of each length are left over. A length of n units is of documents of n * unit tokens or a little less."""

    unit: int
    size: int
    patterns: list[tuple[dict[int, int], int]]
    line: dict[int, int]


def _knapsack(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value of lengths that fit in each size, and the length put last, 0 for an empty place.

    values[l - 1] is that of length l. Of equal values the longest length is taken."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    backward = values[::-1].copy()
    for total in range(1, size + 1):
        n = min(total, len(values))
        with_last = best[total - n : total] + backward[len(values) - n :]  # of length n first
        k = int(with_last.argmax())
        if with_last[k] > best[total - 1]:
            best[total], last[total] = with_last[k], n - k
        else:
            best[total] = best[total - 1]
    return best, last


def _first_columns(lengths: list[int], supply: list[int], size: int) -> list[Pattern | None]:
    """A column for each row, each of which uses up a length: of the longest length that is left, with the longest
    that fit beside it, or the line (None) where such a pattern would pad too much."""
    left = [float(n) for n in supply]
    columns: list[Pattern | None] = [None] * len(lengths)
    alive = list(range(len(lengths)))
    while alive:
        room, counts = size, {}
        for k in reversed(alive):
            a = min(room // lengths[k], max(1, int(left[k])))
            if a:
                counts[k] = a
                room -= a * lengths[k]
            if not room:
                break
        longest = alive[-1]
        if room > (LINE_COST - 1) * size:
            used, columns[longest] = longest, None
        else:
            used = min(counts, key=lambda k: (left[k] / counts[k], k))
            times = left[used] / counts[used]
            for k, a in counts.items():
                left[k] = max(0.0, left[k] - times * a)
            columns[used] = tuple(sorted(counts.items()))
        alive.remove(used)
    return columns


class _Basis:
    """The basis of the program: minimise the cost, such that patterns and line have all of each length."""

    def __init__(self, lengths: list[int], supply: list[int], size: int):
        m = len(lengths)
        self.columns = _first_columns(lengths, supply, size)
        matrix, cost = np.zeros((m, m)), np.full(m, float(size))
        for k, column in enumerate(self.columns):
            if column is None:
                self.columns[k], cost[k] = ((k, 0),), LINE_COST * lengths[k]
                matrix[k, k] = 1
            else:
                for row, a in column:
                    matrix[row, k] = a
        self.inverse = np.linalg.inv(matrix)
        self.level = np.maximum(self.inverse @ np.array(supply, float), 0)
        self.duals = cost @ self.inverse

    def enter(self, column: Pattern, cost: float) -> bool:
        """Brings in a column of (row, number) pairs if it lowers the cost; ((row, 0),) is the line's of that row."""
        rows = [k for k, _ in column]
        counts = np.array([a or 1 for _, a in column], float)
        gain = float(self.duals[rows] @ counts) - cost
        if gain <= _SMALL * cost:
            return False
        change = self.inverse[:, rows] @ counts
        down = np.flatnonzero(change > _SMALL)
        if not len(down):
            return False
        ratios = self.level[down] / change[down]
        tied = down[ratios <= ratios.min() + 1e-12]
        out = int(tied[change[tied].argmax()])
        pivot_row = self.inverse[out] / change[out]
        step = self.level[out] / change[out]
        self.duals -= gain * pivot_row
        self.inverse -= np.outer(change, pivot_row)
        self.inverse[out] = pivot_row
        self.level = np.maximum(self.level - change * step, 0)
        self.level[out] = step
        self.columns[out] = column
        return True


def generate_patterns(lengths: list[int], supply: list[int], size: int, tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and in how many sequences each is, fractions included.

    Stops once the cost is proven to be within the tolerance: if the best pattern is worth v, the duals divided by
    v / size are a bound from below.
    """
    if not lengths:
        return []
    lens, have = np.array(lengths, np.int64), np.array(supply, float)
    row = {n: k for k, n in enumerate(lengths)}
    basis = _Basis(lengths, supply, size)
    for _ in range(rounds):
        entered = 0
        for k in np.flatnonzero(basis.duals > LINE_COST * lens + _SMALL).tolist():  # lengths better left on the line
            entered += basis.enter(((k, 0),), LINE_COST * lengths[k])
        values = np.full(int(lens[-1]), -np.inf)
        values[lens - 1] = basis.duals
        best, last = _knapsack(values, size)
        if best[size] <= (1 + tolerance) * size and (basis.duals <= (1 + tolerance) * LINE_COST * lens).all():
            break
        through = basis.duals + best[size - lens]  # of the best pattern that has a length
        taken: set[Pattern] = set()
        for k in np.argsort(-through, kind="stable").tolist():
            if through[k] <= size or len(taken) >= _TAKEN:
                break
            counts, rest = {k: 1}, size - lengths[k]
            while rest:
                at = int(last[rest])
                rest -= at or 1
                if at:
                    counts[row[at]] = counts.get(row[at], 0) + 1
            pattern = tuple(sorted(counts.items()))
            if pattern not in taken:
                taken.add(pattern)
                entered += basis.enter(pattern, float(size))
        if not entered:
            break
    found = sorted((c, level) for c, level in zip(basis.columns, basis.level.tolist(), strict=True) if c[0][1] and level > _SMALL)
    return [({lengths[k]: a for k, a in pattern}, level) for pattern, level in found]


def plan_packing(histogram: dict[int, int], size: int, most_rows: int = MOST_ROWS) -> Plan:
    """Whole numbers of the patterns for a histogram of lengths in tokens, all below size, and what is left for the line.

    The unit is the least power of two with which there are at most most_rows different lengths. Levels are rounded
    down; then the patterns that lost most are taken once more, or as often as what is left allows.
    """
    unit = 1
    while len({-(-n // unit) for n in histogram}) > most_rows:
        unit *= 2
    left: dict[int, int] = {}
    for n, count in sorted(histogram.items()):
        if count:
            left[-(-n // unit)] = left.get(-(-n // unit), 0) + count
    found = generate_patterns(list(left), list(left.values()), size // unit)
    times = []
    for pattern, level in found:
        times.append(min([int(level + 1e-6), *(left[n] // a for n, a in pattern.items())]))
        for n, a in pattern.items():
            left[n] -= a * times[-1]
    for k in sorted(range(len(found)), key=lambda k: (times[k] - found[k][1], k)):
        more = min(left[n] // a for n, a in found[k][0].items())
        times[k] += more
        for n, a in found[k][0].items():
            left[n] -= a * more
    return Plan(unit, size // unit, [(pattern, count) for (pattern, _), count in zip(found, times, strict=True) if count], {n: count for n, count in left.items() if count})
