"""The chunk store: what a refresh makes, and joins without an exchange of chunks."""

from pyspark.sql import functions as F

from dossier.operators import broadcasts, retrieval
from dossier.sources import chunk_store, tables
from dossier.sources.documents import chunk_documents, ingest_documents


def docs_of(spark, texts):
    raw = spark.createDataFrame([(k, f"{k}.txt", 1, None, t) for k, t in texts.items()], "doc_id string, name string, size_bytes long, page_count int, text string")
    return ingest_documents(raw)


def test_only_new_and_changed_texts_are_made(spark, tmp_path):
    first = {"a": "x" * 4000, "b": "short", "c": None, "d": "gone soon"}
    store = chunk_store.save_chunks(docs_of(spark, first), f"{tmp_path}", buckets=4)
    assert store.made == 4
    then = {"a": "x" * 4000, "b": "longer", "c": None, "e": "new"}
    again = chunk_store.refresh(docs_of(spark, then), store)
    wanted = lambda texts: sorted(chunk_documents(docs_of(spark, texts)).collect())
    have = lambda s: sorted(chunk_store.stored_chunks(spark, s).collect())
    assert have(again) == wanted(then) and have(store) == wanted(first)
    assert again.made == 3  # b and e, and c, which has no chunks to be known by
    back = chunk_store.refresh(docs_of(spark, first), again)
    assert back.made == 1 and have(back) == wanted(first)
    none = chunk_store.refresh(docs_of(spark, first).limit(0), back)
    assert none.made == 0 and have(none) == []


def test_chunks_are_joined_in_their_buckets(spark, sf_dir, tmp_path, monkeypatch):
    """Beyond every broadcast bound, lists of documents are exchanged and chunks are not."""
    docs = tables.documents(spark, sf_dir)
    store = chunk_store.save_chunks(docs, f"{tmp_path}", buckets=4)
    monkeypatch.setattr(broadcasts, "BROADCAST_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = chunk_store.stored_chunks(spark, store)
        named = tables.request_documents(spark, sf_dir).withColumnRenamed("doc_id", "_doc")
        met = chunks.join(named, F.col("doc_id") == F.col("_doc"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2, plan
        exchanged = [line.strip() for line in plan.splitlines() if "Exchange hashpartitioning(doc_id" in line]
        assert not exchanged and "Exchange hashpartitioning(_doc" in plan, plan
        scored = retrieval.score_chunks(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), chunks)
        plain = retrieval.score_chunks(tables.requests(spark, sf_dir), tables.request_documents(spark, sf_dir), chunk_documents(docs))
        columns = ("request_id", "chunk_id", "score")
        assert sorted(scored.select(*columns).collect()) == sorted(plain.select(*columns).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
