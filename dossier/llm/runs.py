"""Periodic runs of words, found on a grammar of each text's word ids.

Re-Pair makes the grammar: the pair of symbols that occurs most often becomes a nonterminal until no pair occurs twice.
Every run crosses the boundary between the two halves of just one lowest node of the derivation, so runs are computed
once at the boundary of each nonterminal, over its own words, and translated to all places where the nonterminal is
derived. What one place cuts off another has whole, so the maximal intervals of a period are the runs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import WORD, spread
from dossier.llm.word_tokens import by_bytes

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Bytes of texts that are taken at once; a longer text is alone.
PART_BYTES = 4 << 20
#: Rounds in which stretches are parted at words that are too rare for a run.
_PARTINGS = 12

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Re-Pair over word ids: rules in the order they were made, and the symbols that are left.

    Of rule k: first[k] is a place where it is derived, middle[k] and length[k] the words of its left half and in all;
    its halves are left[k] and right[k], -1 standing for a word. residual: (rule or -1, place) of what is left.
    Of equally frequent pairs the one that was met first is replaced first, which keeps derivations shallow.
    """

    def __init__(self, words: list[int]):
        self.first: list[int] = []
        self.middle: list[int] = []
        self.length: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        n, base = len(words), max(words, default=0) + 1
        symbols = [*words, -1]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        places: dict[tuple[int, int], list[int]] = {}
        for at, pair in enumerate(zip(words, words[1:])):
            places.setdefault(pair, []).append(at)
        count = {pair: len(own) for pair, own in places.items()}
        born = {pair: k for k, pair in enumerate(places)}
        heap = [(-n_own, born[pair], pair) for pair, n_own in count.items() if n_own > 1]
        heapq.heapify(heap)
        size = [1] * n
        while heap:
            said, age, pair = heapq.heappop(heap)
            now = count.get(pair, 0)
            if now < 2:
                continue
            if now != -said:
                heapq.heappush(heap, (-now, age, pair))
                continue
            a, b = pair
            rule = base + len(self.first)
            made = set()
            for at in sorted(set(places.pop(pair))):
                follows = after[at]
                if symbols[at] != a or follows >= n or symbols[follows] != b:
                    continue
                if not made:
                    self.first.append(at)
                    self.middle.append(size[at])
                    self.length.append(size[at] + size[follows])
                    self.left.append(a - base if a >= base else -1)
                    self.right.append(b - base if b >= base else -1)
                prior, beyond = before[at], after[follows]
                if prior >= 0:
                    count[symbols[prior], a] -= 1
                    new = (symbols[prior], rule)
                    places.setdefault(new, []).append(prior)
                    count[new] = count.get(new, 0) + 1
                    made.add(new)
                if beyond < n:
                    count[b, symbols[beyond]] -= 1
                    new = (rule, symbols[beyond])
                    places.setdefault(new, []).append(at)
                    count[new] = count.get(new, 0) + 1
                    made.add(new)
                    before[beyond] = at
                symbols[at], symbols[follows], after[at] = rule, -1, beyond
                size[at] += size[follows]
                made.add(pair)
            count[pair] = 0
            made.discard(pair)
            for new in sorted(made, key=lambda x: places[x][0]):
                born.setdefault(new, len(born))
                if count[new] > 1:
                    heapq.heappush(heap, (-count[new], born[new], new))
        self.residual: list[tuple[int, int]] = []
        at = 0
        while at < n:
            self.residual.append((symbols[at] - base if symbols[at] >= base else -1, at))
            at = after[at]


def _common(ids: np.ndarray, a: int, b: int, end: int) -> int:
    """Words in common from a on and from b on, a < b, before end."""
    found, step = 0, 16
    while b + found < end:
        k = min(step, end - b - found)
        same = ids[a + found : a + found + k] == ids[b + found : b + found + k]
        if not same.all():
            return found + int(same.argmin())
        found, step = found + k, step * 4
    return found


class Crossings:
    """Runs that cross a boundary, within a part of a text."""

    def __init__(self, words: list[int]):
        self.words, self.ids = words, np.array(words, np.int64)
        self.back = self.ids[::-1].copy()

    def _before(self, a: int, b: int, low: int) -> int:
        """Words in common that end before a and before b, a < b, from low on."""
        n = len(self.ids)
        return _common(self.back, n - b, n - a, n - low)

    def __call__(self, low: int, at: int, high: int) -> list[tuple[int, int, int]]:
        """(start, end, period) of the runs of words low to high that have the words before and behind `at`.

        Half of a run's periods, two at least, are on one side of `at`. There the run's period is the distance to an
        earlier (or later) place of the two words around `at`. A period up to half of what an accepted smaller one
        covers on that side is a multiple of it and is passed over, so few are accepted.
        """
        if high - low < LEAST_WORDS:
            return []
        y, z = self.words[at - 1], self.words[at]
        if high - low <= 256:
            own = self.words[low:high]
            if own.count(y) < LEAST_PERIODS or own.count(z) < LEAST_PERIODS:
                return []
        own = self.ids[low:high]
        pairs = np.flatnonzero((own[:-1] == y) & (own[1:] == z)) + low
        found, ids = [], self.ids
        covered = 0
        for j in pairs[(pairs < at - 1) & (pairs >= at - 1 - (at - low) // 2)][::-1].tolist():
            q = at - 1 - j
            if 2 * q <= covered:
                continue
            more = self._before(at - q, at, low)
            if more >= q:
                covered = q + more
                end = at + _common(ids, at - q, at, high)
                found.append((at - covered, end, q))
        covered = 0
        for j in pairs[(pairs >= at) & (pairs <= at - 1 + (high - at) // 2)].tolist():
            q = j - at + 1
            if 2 * q <= covered:
                continue
            more = _common(ids, at, at + q, high)
            if more >= q:
                covered = q + more
                found.append((at - self._before(at, at + q, low), at + covered, q))
        return [x for x in found if x[1] - x[0] >= max(LEAST_WORDS, LEAST_PERIODS * x[2])]


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs of a list of word ids, by start and period."""
    grammar, crossing = Grammar(words), Crossings(words)
    own = [[(s - first, e - first, q) for s, e, q in crossing(first, first + middle, first + length)] for first, middle, length in zip(grammar.first, grammar.middle, grammar.length, strict=True)]
    holds = [bool(x) for x in own]
    for k, (a, b) in enumerate(zip(grammar.left, grammar.right, strict=True)):
        holds[k] |= (a >= 0 and holds[a]) or (b >= 0 and holds[b])
    found: list[tuple[int, int, int]] = []
    # What is left is derived from a balanced tree of its own.
    starts = [*(at for _, at in grammar.residual), len(words)]
    nodes = [(0, len(starts) - 1)]
    while nodes:
        a, b = nodes.pop()
        if b - a > 1:
            middle = (a + b) // 2
            found.extend(crossing(starts[a], starts[middle], starts[b]))
            nodes += [(a, middle), (middle, b)]
    derived: list[list[int]] = [[] for _ in own]
    for rule, at in grammar.residual:
        if rule >= 0 and holds[rule]:
            derived[rule].append(at)
    for k in range(len(own) - 1, -1, -1):  # a rule is used by later ones only
        if derived[k]:
            found.extend((at + s, at + e, q) for at in derived[k] for s, e, q in own[k])
            a, b, middle = grammar.left[k], grammar.right[k], grammar.middle[k]
            if a >= 0 and holds[a]:
                derived[a].extend(derived[k])
            if b >= 0 and holds[b]:
                derived[b].extend(at + middle for at in derived[k])
            derived[k] = []
    return maximal(found)


def maximal(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Intervals of a period that no other of the same period holds, by start and period."""
    out, last, reach = [], None, 0
    for q, start, end in sorted(((q, s, -e) for s, e, q in found)):
        if q != last:
            last, reach = q, 0
        if -end > reach:
            reach = -end
            out.append((start, -end, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def stretches(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of ids that may hold runs. ids: word ids of texts end to end, no id in two texts; ends: of the texts.

    Each word of a run is in it LEAST_PERIODS times, so a rarer one parts what is before it from what is behind it, and
    then the parts each in turn.
    """
    if not len(ids):
        return []
    at, part = np.arange(len(ids)), np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    counts = np.bincount(ids)[ids]
    for _ in range(_PARTINGS):
        kept = counts >= LEAST_PERIODS
        if kept.all():
            break
        at, part = at[kept], part[kept]
        opens = np.append(True, (np.diff(at) != 1) | (np.diff(part) != 0))[: len(at)]
        part = np.cumsum(opens) - 1
        kept = np.bincount(part, minlength=1)[part] >= LEAST_WORDS if len(part) else np.zeros(0, bool)
        at, part = at[kept], part[kept]
        if not len(at):
            return []
        _, own, n = np.unique(part * (len(ids) + 1) + ids[at], return_inverse=True, return_counts=True)
        counts = n[own]
    firsts = np.flatnonzero(np.append(True, np.diff(part) != 0))
    lasts = np.append(firsts[1:], len(at)) - 1
    return [(a, b + 1) for a, b in zip(at[firsts].tolist(), at[lasts].tolist(), strict=True) if b + 1 - a >= LEAST_WORDS]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of every text of docs (doc_id, text): doc_id, n_words, runs by start and period, and the collapsed text.

    A run is a stretch of consecutive words with smallest period q and of max(6, 4 q) words at least that no neighbour
    extends. collapsed keeps a run's first period, and what no run holds, joined by one space. Words are split at ASCII
    white space; a null or empty text has none. A text may be of any length: grammar and runs of one are in one task's
    memory, in proportion to its words. Repeated rows, and rows without a doc_id, are texts of their own; other columns
    are ignored. No documents: no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1, PART_BYTES):
                texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                ids, offset = [], 0
                for words in texts:
                    number = {w: k for k, w in enumerate(dict.fromkeys(words), offset)}
                    offset += len(number)
                    ids.append(list(map(number.__getitem__, words)))
                sizes = [len(w) for w in texts]
                ends = np.cumsum(sizes)
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(ends[-1]))
                runs: list[list[dict[str, int]]] = [[] for _ in texts]
                for a, b in stretches(flat, ends):
                    owner = int(np.searchsorted(ends, a, side="right"))
                    begin = a - int(ends[owner]) + sizes[owner]
                    number = {w: k for k, w in enumerate(dict.fromkeys(flat[a:b].tolist()))}
                    runs[owner].extend({"start": s + begin, "length": e - s, "period": q} for s, e, q in runs_of([number[w] for w in flat[a:b].tolist()]))
                collapsed = []
                for words, own in zip(texts, runs, strict=True):
                    if own:
                        kept = np.ones(len(words), bool)
                        for r in own:
                            kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
                        words = [words[k] for k in np.flatnonzero(kept).tolist()]
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, _FOUND)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, whose words are made periodic from a place on in every tenth document, as drawn from its doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    # The words are bound to a variable, so that they are split once.
    bound = F.transform(F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"))), planted)
    return docs.select("doc_id", F.when(h % 10 == 0, bound[0]).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document: their number, the one with most periods, and digests of all runs and of the rest."""
    found = periodic_runs(with_planted_periods(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    least = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length"), F.lit(1).cast("long").alias("period"))
    best = F.aggregate("runs", least, lambda x, r: F.when(r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    line = lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    named = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
