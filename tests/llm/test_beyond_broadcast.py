"""Results are the same where a side is too long to broadcast."""

import pytest

from dossier.llm import contamination, mixing, quality, repeats, warc
from dossier.llm.queries import QUERIES

CASES = {
    "op1_source_mix": mixing,
    "op4_repeated_bytes": repeats,
    "op7_warc_round_trip": warc,
    "op8_quality_rules": quality,
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_joins_give_the_same_rows(spark, sf_dir, monkeypatch, name):
    want = QUERIES[name](spark, sf_dir).collect()
    monkeypatch.setattr(CASES[name], "bounded_broadcast", lambda *_: None)
    assert sorted(map(str, QUERIES[name](spark, sf_dir).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("least, most", [(1 << 23, 1 << 28), (1 << 15, 1 << 17), (1 << 15, 1 << 15)])
def test_items_are_found_by_joins_too(spark, sf_dir, monkeypatch, least, most):
    """With a map of bits of its usual size, with one that grows with the entries, and with one that is all but full."""
    monkeypatch.setattr(contamination, "SIEVE_BITS", least)
    monkeypatch.setattr(contamination, "MOST_SIEVE_BITS", most)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(contamination.contained_items(docs, items).collect())
    assert want and sorted(contamination.contained_items(docs, items, index_bytes=0).collect()) == want
    kept = {r.doc_id for r in contamination.drop_contaminated(docs, items, index_bytes=0).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r.doc_id for r in want}


def test_rows_without_an_id_are_dealt_by_their_texts(spark, monkeypatch):
    """Beyond the bound they are spread over tasks, and count as untrusted even where a hash equals a trusted id."""
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    clash = docs.filter("doc_id is null").limit(1).select(F.xxhash64("text").alias("doc_id"))
    trusted = docs.filter("doc_id < 900").select("doc_id").unionByName(clash)
    want = quality.log_ratios(docs, trusted, buckets=64).first()
    monkeypatch.setattr(quality, "bounded_broadcast", lambda *_: None)
    assert quality.log_ratios(docs, trusted, buckets=64).first() == want
