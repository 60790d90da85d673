"""Chunks stored once, in buckets of doc_id, so that joins by doc_id need no exchange of them.

Chunks are filed under their document and the hash of its text. What is current is a table of its own, of doc_id and
hash, in the same buckets: a refresh makes chunks of texts that are not filed yet and leaves the others as they are.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.values import CHUNK_CHARS
from dossier.operators.broadcasts import few_or_all
from dossier.sources.documents import chunk_documents
from dossier.sources.shared import cut

BUCKETS = 64


@dataclass(frozen=True)
class ChunkStore:
    """folder: where the tables are; chunks and current: their names in the session's catalog; made: documents whose
    chunks the last save or refresh has made."""

    folder: str
    chunks: str
    current: str
    buckets: int
    chunk_chars: int
    made: int


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("text_hash", F.sha2(F.coalesce(F.concat_ws("\0", "name", "text"), F.lit("")).cast("binary"), 256))


def _write(rows: DataFrame, table: str, folder: str, buckets: int, mode: str, *order: str) -> None:
    # One task a bucket, so that a bucket is one file and stays sorted.
    dealt = rows.repartition(buckets, "doc_id").sortWithinPartitions(*order)
    dealt.write.mode(mode).format("parquet").option("path", f"{folder}/{table}").bucketBy(buckets, "doc_id").sortBy(*order).saveAsTable(table)


def save_chunks(documents: DataFrame, folder: str, buckets: int = BUCKETS, chunk_chars: int = CHUNK_CHARS) -> ChunkStore:
    """Chunks of all documents (ingested, one row a doc_id) in new tables under folder, a shared one on a cluster."""
    name = f"chunks_{uuid.uuid4().hex}"
    empty = ChunkStore(folder, name, "", buckets, chunk_chars, 0)
    return _refreshed(documents, empty, None)


def refresh(documents: DataFrame, store: ChunkStore) -> ChunkStore:
    """The store with these documents as the current ones: chunks are made of new and changed texts alone.

    Documents that are not given any more are current no longer; their chunks stay filed, as do those of old texts, and
    count again without being made if such a text comes back.
    """
    return _refreshed(documents, store, documents.sparkSession.table(store.chunks).select("doc_id", "text_hash"))


def _refreshed(documents: DataFrame, store: ChunkStore, filed: DataFrame | None) -> ChunkStore:
    hashed = _hashed(documents)
    current = f"current_{uuid.uuid4().hex}"
    _write(hashed.select("doc_id", "text_hash"), current, store.folder, store.buckets, "errorifexists", "doc_id")
    spark = documents.sparkSession
    stale = spark.table(current) if filed is None else spark.table(current).join(filed.distinct(), ["doc_id", "text_hash"], "left_anti")
    stale = cut(stale, "stale-documents")
    made = stale.count()
    wanted = few_or_all(stale.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")))
    some = hashed.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).drop("_doc", "_hash")
    if filed is None or made:
        chunked = chunk_documents(some, store.chunk_chars, "text_hash")
        _write(chunked, store.chunks, store.folder, store.buckets, "append", "doc_id", "char_offset")
    return ChunkStore(store.folder, store.chunks, current, store.buckets, store.chunk_chars, made)


def stored_chunks(spark: SparkSession, store: ChunkStore) -> DataFrame:
    """The chunks of the current documents, as chunk_documents() makes them; both tables are read in their buckets."""
    current = spark.table(store.current).select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).hint("merge")
    rows = spark.table(store.chunks)
    # Hashes are of one length, so this is equality, but no key of the join: keys beyond doc_id would need an exchange.
    same = F.startswith("text_hash", "_hash")
    return rows.join(current, (F.col("doc_id") == F.col("_doc")) & same).drop("_doc", "_hash", "text_hash")
