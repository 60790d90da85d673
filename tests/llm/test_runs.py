"""Periodic runs against a brute-force search."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import runs as r
from dossier.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Each stretch of equal words q apart, as long as it goes, unless a smaller period has all of it."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        start = 0
        for end in range(q, n + 1):
            if end == n or words[end] != words[end - q]:
                if end - start >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q)):
                    out.append((start, end, q))
                start = end - q + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 5)), max_size=6))
def test_runs_equal_brute_force(parts):
    words = [w for unit, times, off in parts for w in (unit * times)[: max(1, len(unit) * times - off)]]
    assert r.runs_of(words) == brute(words)
    found = [(a + s, a + e, q) for a, b in r.stretches(np.array(words, np.int64), np.array([len(words)])) for s, e, q in r.runs_of(words[a:b])]
    assert sorted(found, key=lambda x: (x[0], x[2])) == brute(words)


def test_long_and_flat_texts():
    assert r.runs_of([7] * 50_000) == [(0, 50_000, 1)]
    assert r.runs_of(list(range(900)) * 5) == [(0, 4500, 900)]
    rng = random.Random(1)
    assert r.runs_of([rng.randrange(40) for _ in range(20_000)]) == []


def test_grammar_gives_the_words_back():
    rng = random.Random(2)
    words = [rng.randrange(5) for _ in range(400)]
    g = r.Grammar(words)

    def derive(rule, at, length):
        if rule < 0:
            return [words[at]]
        left = derive(g.left[rule], g.first[rule], g.middle[rule])
        return left + derive(g.right[rule], g.first[rule] + g.middle[rule], g.length[rule] - g.middle[rule])

    assert [w for rule, at in g.residual for w in derive(rule, at, 1)] == words
    left = [rule if rule >= 0 else ("word", words[at]) for rule, at in g.residual]
    apart = {}
    for k, pair in enumerate(zip(left, left[1:])):
        assert k - apart.setdefault(pair, k) < 2  # no pair twice, but where it overlaps itself


def test_query_equals_brute_force(spark, sf_dir):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_periodic_runs"](spark, sf_dir).collect()
    assert sorted(x.doc_id for x in got) == sorted(texts)
    planted = 0
    for x in got:
        words = WORD.findall(texts[x.doc_id])
        n, h = len(words), zlib.crc32(str(x.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = brute([number[w] for w in words]) if n < 1500 else r.runs_of([number[w] for w in words])
        planted += bool(found)
        assert x.n_runs == len(found)
        best = max(found, key=lambda y: ((y[1] - y[0]) / y[2], -y[0], -y[2])) if found else None
        wanted = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        assert (x.start, x.length, x.period, x.exponent_milli) == wanted
        gone = {k for s, e, q in found for k in range(s + q, e)}
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
    assert planted > 5


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a a a a a a a", "x"), (2, " \n\t ", "y"), (2, "b c\u00a0d " * 9, "y"), (2, "b c\u00a0d " * 9, "y"), (3, "w " * 100_000, "z"), (4, "a a a a a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((str(x.doc_id), x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in r.periodic_runs(docs).collect())
    twice = ("2", 18, [(0, 18, 2)], "b c\u00a0d")
    assert got == sorted(
        [("1", 0, [], ""), ("1", 0, [], ""), ("None", 7, [(0, 7, 1)], "a"), ("2", 0, [], ""), twice, twice, ("3", 100_000, [(0, 100_000, 1)], "w"), ("4", 5, [], "a a a a a")]
    )
    assert r.periodic_runs(docs.limit(0)).count() == 0
