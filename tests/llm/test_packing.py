"""Packing: pieces against the tokenizers library, whole and gapless sequences, and how little is padded."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dossier.llm import cutting_stock as c
from dossier.llm import packing as p
from dossier.llm.byte_tokens import PieceEncoder
from dossier.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def padding(totals, size):
    return sum(0 if n & (n - 1) == 0 else size - n for n in totals)


def check_sequences(rows, size, documents):
    """rows: pieces with offset. documents: a list of ids for each (doc_id, doc_tokens)."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for (doc_id, n), own in by_doc.items():
        copies = len(documents[doc_id, n])
        at = [0] * copies
        for start, length in sorted(own):
            at[at.index(start)] += length
        assert at == [n] * copies
    assert set(by_doc) == set(documents)
    return [sum(n for _, n in own) for own in by_sequence.values()]


def test_query(spark, sf_dir, tokenizer):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    ids = {k: [*e.ids, 1] for k, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    rows = QUERIES["op13_packed_sequences"](spark, sf_dir).collect()
    totals = check_sequences(rows, 2048, {(k, len(v)): [v] for k, v in ids.items()})
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert padding(totals, 2048) < 0.005 * sum(totals)
    assert sum(len(v) // 2048 + 1 for v in ids.values()) + 60 > len(rows)  # few documents are cut where they needn't be


@pytest.mark.parametrize("most_rows", [4096, 40])
def test_odd_rows_and_larger_units(spark, most_rows):
    rng = random.Random(5)
    rows = [(k, " ".join("word" for _ in range(rng.choice([1, 2, 40, 120, 127, 128, 129, 300]) + k % 7)), "x") for k in range(300)]
    rows += [(1, None, "x"), (1, "", "y"), (None, "no id", "y"), (None, "no id", "y"), (7, "w " * 5000, "z"), (8, "<|endoftext|> in  a\n\n\n text ", "z")] + [(9, "word " * 90, "hot")] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    pieces = p.pack_documents(docs, size=128, most_rows=most_rows).cache()
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    documents = defaultdict(list)
    for (doc_id, _, _), ids in zip(rows, encoder.encode(pa.array([r[1] for r in rows])), strict=True):
        documents[doc_id, len(ids) + 1].append([*ids.tolist(), 1])
    totals = check_sequences(p.with_offsets(pieces).collect(), 128, documents)
    assert padding(totals, 128) <= (0 if most_rows > 128 else 0.06 * sum(totals))
    made = p.packed_sequences(pieces, 128, pad_id=0).collect()
    assert sorted(r.n_tokens for r in made) == sorted(totals)
    assert all(len(r.ids) == 4 * r.n_places and r.n_places in (128, r.n_tokens) for r in made)
    kept = sorted(t for r in made for t in np.frombuffer(r.ids, "<u4")[: r.n_tokens].tolist())
    assert kept == sorted(t for own in documents.values() for ids in own for t in ids)
    assert p.pack_documents(docs.limit(0)).count() == 0


def test_patterns_use_what_there_is():
    rng = random.Random(3)
    for size, n in ((64, 20), (100, 60), (256, 200)):
        histogram = {k: rng.choice([1, 2, 50, 400]) for k in rng.sample(range(1, size), min(n, size - 1))}
        plan = c.plan_packing(histogram, size)
        got = dict(plan.line)
        for pattern, times in plan.patterns:
            assert sum(k * a for k, a in pattern.items()) <= size and times > 0
            for k, a in pattern.items():
                got[k] = got.get(k, 0) + a * times
        assert got == histogram


def test_the_program_reaches_the_best_cost():
    """Lengths that fit in pairs and triples only: all are in patterns without padding."""
    found = c.generate_patterns([20, 30, 50, 70], [30, 40, 60, 40], 100, tolerance=1e-9)
    assert all(sum(n * a for n, a in pattern.items()) == 100 for pattern, _ in found)
    used = defaultdict(float)
    for pattern, level in found:
        for n, a in pattern.items():
            used[n] += a * level
    assert used[70] == pytest.approx(40) and used[50] == pytest.approx(60) and used[30] == pytest.approx(40)
    for value in ([3.0, 5.0, 9.0], [1.0, 4.0, 4.5]):
        best, _ = c._knapsack(np.array([-np.inf, *value]), 9)  # lengths 2, 3 and 4
        for room in range(10):
            assert best[room] == max(a * value[0] + b * value[1] + d * value[2] for a in range(5) for b in range(4) for d in range(3) if 2 * a + 3 * b + 4 * d <= room)


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(0)
    parts = [" ", "  ", "\n", "\t", "\u00a0", "\u3000", "a", "Word", "don't", "b.", "x!!", "é,", "×", "12", "<|endoftext|>", "\x00", "y" * 60]
    texts = ["", None, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(4000))]
    encoder = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), remember=50)
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        wanted = tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)
        assert [x.tolist() for x in encoder.encode(pa.array(some, pa.string()))] == [e.ids for e in wanted]
