"""Suffix order and common prefixes of a collection of strings, built column by column.

The strings' last symbols are inserted first; each round inserts, for every string that still has one, the symbol
before its last inserted suffix. Its place follows from its symbol and from the rank of the suffix that it extends, as
in the Burrows-Wheeler transform of the collection (Bauer, Cox and Rosone, 2013). Suffixes that are in the order stay in
it, and with them the common prefixes of neighbours; only the round's new suffixes have new ones: one symbol more than
the least between the two suffixes that they and their neighbours extend. A symbol is WIDTH bytes, so
that a string of n bytes takes n / WIDTH rounds; each string enters once for each of its first WIDTH starts, which puts
every byte's suffix in the order.
"""

from __future__ import annotations

import numpy as np

WIDTH = 4
#: Symbols in common that are told apart.
MOST_COMMON = 250


def _grams(data: np.ndarray) -> np.ndarray:
    """WIDTH bytes from each place as one number, in byte order."""
    padded = np.append(data, np.zeros(WIDTH, np.uint8)).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(WIDTH):
        out = (out << np.uint32(8)) | padded[k : k + len(data)]
    return out


def _least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of values[after + 1 : to + 1], for each pair after < to: of two runs of a power of two that cover it."""
    power = np.frexp((to - after).astype(np.float64))[1] - 1
    out = np.empty(len(to), values.dtype)
    least, width = values, 1
    for k in range(int(power.max(initial=-1)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(least[after[own] + 1], least[to[own] - width + 1])
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in data (strings laid end to end) in the order of the suffixes of whole symbols that start there.

    Also returns the symbols that each has in common with the one before it, up to MOST_COMMON. Places fewer than WIDTH
    bytes before the end of their string are not in the order.
    """
    # Strings are laid apart, so that what stands before one, or behind it, is no place of another.
    shift = np.repeat((np.arange(len(starts)) + 1) * WIDTH, lengths)
    apart = np.zeros(len(data) + (len(starts) + 1) * WIDTH, np.uint8)
    apart[np.arange(len(data)) + shift] = data
    grams = _grams(apart)
    _, codes = np.unique(grams, return_inverse=True)
    codes = codes.astype(np.int64) << 32
    first = (starts[:, None] + (np.arange(len(starts))[:, None] + 1) * WIDTH + np.arange(WIDTH)).ravel()
    whole = np.maximum((lengths[:, None] - np.arange(WIDTH)) // WIDTH, 0).ravel()
    first, whole = first[whole > 0], whole[whole > 0]
    ends = first + whole * WIDTH
    order, common, symbols = np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    # Of each place, the rank of the suffix behind its symbol; strings' ends are empty suffixes, before all others.
    rank_behind = np.zeros(len(apart), np.int64)
    rank_behind[ends - WIDTH] = np.arange(len(ends)) - len(ends)
    for length in range(1, int(whole.max(initial=0)) + 1):
        rank_behind[order - WIDTH] = np.arange(len(order))
        inserted = ends[whole >= length] - length * WIDTH
        keys = codes[inserted] + rank_behind[inserted]
        by_key = np.argsort(keys)
        inserted = inserted[by_key]
        at = np.searchsorted(symbols + rank_behind[order], keys[by_key])
        order, symbols = np.insert(order, at, inserted), np.insert(symbols, at, codes[inserted])
        extended, common = common, np.insert(common, at, 0)
        at = at + np.arange(len(at))
        at = np.concatenate([at, at + 1])  # new suffixes, and those behind them
        at = at[at < len(order)]
        common[at] = 0
        at = at[at > 0]
        at = at[symbols[at - 1] == symbols[at]]
        before, own = rank_behind[order[at - 1]], rank_behind[order[at]]
        found = np.ones(len(at), np.uint8)
        inner = np.flatnonzero(before >= 0)
        found[inner] = np.minimum(_least_between(extended, before[inner], own[inner]), MOST_COMMON - 1) + 1
        common[at] = found
    back = np.zeros(len(apart), np.int64)
    back[np.arange(len(data)) + shift] = np.arange(len(data))
    return back[order], common


def repeated_windows(strings: list[bytes], weights: list[int], windows: list[int], size: int) -> list[np.ndarray]:
    """For each string, which of its first `windows` windows of `size` bytes are found twice or more in the collection.

    A string of weight w counts w times. size is a multiple of WIDTH, and MOST_COMMON symbols at most.
    """
    lengths = np.array([len(s) for s in strings])
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(strings), np.uint8)
    n = np.array(windows)
    order, common = suffix_order(data, starts, lengths)
    owner = np.repeat(np.arange(len(strings)), lengths)
    kept = np.flatnonzero(order - starts[owner[order]] < n[owner[order]])
    order = order[kept]
    opens = np.ones(len(order), bool)
    if len(kept) > 1:
        opens[1:] = np.minimum.reduceat(common[: kept[-1] + 1], kept[:-1] + 1) < size // WIDTH
    group = np.cumsum(opens) - 1
    total = np.bincount(group, np.array(weights)[owner[order]], minlength=1)
    found = np.zeros(len(data) + 1, bool)
    found[order] = total[group] >= 2 if len(order) else False
    return [found[a : a + w] for a, w in zip(starts.tolist(), n.tolist(), strict=True)]
