"""Texts are read once for all questions, and only documents with best chunks are cut again."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.functions.search import gram_codes, number_scores, question_lines, text_scores
from dossier.operators import bundles, grams, retrieval
from dossier.sources import tables
from dossier.sources.documents import chunk_documents, ingest_documents


def test_scores_of_many_questions_are_those_of_each(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcé 1-") for _ in range(rng.randint(1, 9)))
    rows = [(" ".join(word() for _ in range(rng.choice([0, 1, 60]))), [" ".join(word() for _ in range(rng.choice([0, 3, 40]))) for _ in range(rng.randint(0, 4))]) for _ in range(200)]
    rows += [(None, ["abc", None]), ("abcé" * 9, ["abc abc", None, "", "abca cab bc"])]
    df = spark.createDataFrame(rows, "t string, q array<string>").withColumn("k", F.transform("q", lambda q: text.tokenize(q)))
    want = F.transform("k", lambda tokens: F.when(F.col("t").isNull(), 0).otherwise(text.keyword_score(tokens, F.col("t"))))
    got = text_scores(F.transform("k", lambda tokens: question_lines(tokens, text.token_weight)), F.col("t"))
    found = [(r.want, r.got) for r in df.repartition(3).select(want.alias("want"), got.alias("got")).collect()]
    assert all(a == b for a, b in found) and sum(map(sum, (b for _, b in found))) > 0


def test_scores_by_numbers(spark):
    df = spark.createDataFrame([(["3 7\n2 9", "2 9\n2 11", None], [9, 400, 7]), (["3 7"], []), ([], [7])], "q array<string>, n array<int>")
    assert [r.s for r in df.select(number_scores(F.col("q"), F.col("n")).alias("s")).collect()] == [[5, 2, 0], [0], []]


def test_a_chunk_is_searched_once_for_all_its_requests(spark, sf_dir, monkeypatch):
    chunks, asked = tables.chunks(spark, sf_dir), retrieval._asked(tables.requests(spark, sf_dir), ())
    named = tables.request_documents(spark, sf_dir)
    assert retrieval._scoped(named, chunks, asked).count() == chunks.count()
    columns = ("request_id", "chunk_id", "doc_ordinal", "score")
    want = sorted(retrieval.score_chunks(tables.requests(spark, sf_dir), named, chunks).select(*columns).collect())
    assert len(want) > chunks.count()
    monkeypatch.setattr(retrieval, "LISTED", 7)
    assert retrieval._scoped(named, chunks, asked).count() > chunks.count()
    assert sorted(retrieval.score_chunks(tables.requests(spark, sf_dir), named, chunks).select(*columns).collect()) == want


def test_requests_that_are_unknown_and_documents_named_twice(spark):
    raw = spark.createDataFrame([("x", "n", 1, 1, "a rash"), ("y", "n", 1, 1, "calm")], "doc_id string, name string, size_bytes long, page_count int, text string")
    requests = spark.createDataFrame([("r", "rash"), ("s", None)], "request_id string, question string")
    named = spark.createDataFrame([("r", 1, "x"), ("r", 2, "x"), ("s", 1, "y"), ("none such", 1, "x"), ("s", 2, "no such")], "request_id string, doc_ordinal int, doc_id string")
    scored = retrieval.score_chunks(requests, named, chunk_documents(ingest_documents(raw)))
    assert sorted((r.request_id, r.doc_ordinal, r.doc_id, r.score) for r in scored.collect()) == [("r", 1, "x", 2), ("r", 2, "x", 2), ("s", 1, "y", 0)]


def test_only_documents_with_best_chunks_are_cut_again(spark, sf_dir):
    scored = retrieval.score_chunks(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), tables.chunks(spark, sf_dir))
    made = []

    def of(named):
        made.append(sorted(r.doc_id for r in named.collect()))
        return tables.chunks_of(spark, sf_dir)(named)

    ranked = retrieval.top_chunks(scored, k=1, chunks=of)
    plain = retrieval.top_chunks(scored, k=1, chunks=tables.chunks(spark, sf_dir))
    assert sorted(ranked.collect()) == sorted(plain.select(*ranked.columns).collect())
    assert made == [sorted({r.doc_id for r in plain.collect()})] and len(made[0]) < tables.documents(spark, sf_dir).count()


def test_white_space_beyond_latin(spark):
    rows = ["a b\tc  d", "  é ü ", "a 　 b﻿", "日本   語", " \n"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select(text.sanitize(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["a b c d", "é ü", "a b", "日本 語", ""]


def test_candidates_are_cut_from_their_documents_alone(spark, sf_dir):
    from dossier.sources.documents import block_documents

    blocks = block_documents(tables.documents(spark, sf_dir))
    asked, named = tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir)
    made = []

    def of(wanted):
        made.append(wanted.count())
        return tables.chunks_of(spark, sf_dir)(wanted)

    some = retrieval.score_candidates(asked, named, of, blocks, k=1)
    columns = ("request_id", "chunk_id", "score")
    assert sorted(some.select(*columns).collect()) == sorted(retrieval.score_candidates(asked, named, tables.chunks(spark, sf_dir), blocks, k=1).select(*columns).collect())
    assert len(made) == 2 and made[0] < blocks.select("doc_id").distinct().count()


def test_words_are_looked_up_once_a_bundle(spark, sf_dir, monkeypatch):
    written = {}

    def noted(df, name, own=retrieval.cut):
        written[name] = own(df, name)
        return written[name]

    monkeypatch.setattr(retrieval, "cut", noted)
    chunks, asked, named = tables.chunks(spark, sf_dir), tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir)
    columns = ("request_id", "chunk_id", "doc_ordinal", "page", "score")
    want = sorted(retrieval.score_chunks(asked, named, chunks).select(*columns).collect())
    own = F.size(F.array_distinct(F.regexp_extract_all("lower_text", F.lit("[a-z0-9]+"), F.lit(0))))
    pairs = chunks.agg(F.sum(own)).first()[0]
    looked_up = []
    for size in (bundles.BUNDLE, 3):
        monkeypatch.setattr(bundles, "BUNDLE", size)
        assert sorted(retrieval.score_by_postings(asked, named, chunks).select(*columns).collect()) == want
        looked_up.append(bundles.bundle_words(written["place-words"]).count())
    assert looked_up[0] < 0.6 * pairs and looked_up[0] < looked_up[1] < pairs


def test_numbers_of_texts_by_bundles(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "ab", "ba", "7", "x" * 9, "none"]
    of = {"a": [1], "ab": [1, 2, 40], "ba": [2, 1], "7": [7], "x" * 9: [5000]}
    texts = [rng.choice(["", "é", "-"]).join(f"{rng.choice(words)} " for _ in range(rng.choice([0, 1, 9]))) for _ in range(50)] + [None, "", "é日 -", "none", "a\u00a0b\x00ab"]
    monkeypatch.setattr(bundles, "BUNDLE", 4)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rows = retrieval.cut(bundles.bundled(df, "t"), "bundles")
    numbers = spark.createDataFrame(list(of.items()), "w string, numbers array<int>")
    found = bundles.with_found(rows, bundles.bundle_words(rows).join(numbers, F.col("word") == F.col("w")))
    assert found.columns == ["k", "_found"] and rows.filter("_words is not null").count() == rows.select("_bundle").distinct().count() >= 14
    runs = {k: re.findall("[a-z0-9]+", t or "") for k, t in enumerate(texts)}
    assert {r.k: r["_found"] for r in found.collect()} == {k: sorted({n for w in own for n in of.get(w, [])}) for k, own in runs.items()}
    # The same in pieces of a bundle.
    one = bundles._taken(pa.array(texts))
    listed = pa.table({"_id": pa.array([0, 2], pa.int32()), "numbers": pa.array([[3, 1], [2]], pa.list_(pa.int32()))})
    whole = bundles._numbers_of(one[0], listed)
    monkeypatch.setattr(bundles, "_CELLS", 1)
    assert bundles._numbers_of(one[0], listed) == whole and set(whole.flatten().to_pylist()) == {1, 2, 3}
    assert bundles._numbers_of(one[0], listed.slice(2)).to_pylist() == [[]] * len(texts)


def test_words_are_filed_under_chosen_grams_alone(spark):
    code = lambda gram: int(gram_codes(gram.encode())[len(gram) - 1][0])
    words = spark.createDataFrame([("abcab",), ("b",), ("zz9",), ("cabca",)], "word string")
    found = grams.filed(words.coalesce(1), {code("a"): 5, code("ca"): 6, code("zz"): 7}, [code("abc"), code("bz")])
    assert {r.word: (sorted(r.own), r.grams) for r in found.collect()} == {"abcab": ([5, 6], [code("abc")]), "b": ([], []), "zz9": ([7], []), "cabca": ([5, 6], [code("abc")])}
    n = {r["_gram"]: r.n for r in grams.gram_counts(words).collect()}
    assert [n.get(code(g), 0) for g in ("a", "b", "ab", "abc", "bz", "9c")] == [4, 4, 3, 2, 0, 0]
    asked = spark.createDataFrame([("b", 1), ("abab", 2)], "token string, number int")
    assert sorted(map(tuple, grams.token_grams(asked).collect())) == sorted([("b", 1, code("b")), ("abab", 2, code("aba")), ("abab", 2, code("bab"))])
