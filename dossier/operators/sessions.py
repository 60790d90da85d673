"""Saved sessions: assembly, upsert, lists and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.values import KEPT_SESSIONS, RECENT_SESSIONS
from dossier.sources.schemas import DOCUMENT_RECORD

#: Documents of a session in one part.
PART_DOCUMENTS = 1_000


def read_sessions(rows: DataFrame) -> DataFrame:
    """Stored rows as typed sessions: null agent and document lists are empty."""
    empty = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    return rows.withColumn("selected_agents", empty("selected_agents")).withColumn("documents", empty("documents"))


def _last(saves: DataFrame, columns: list[str], *order: str | Column) -> DataFrame:
    """Per id the row that is greatest in `order`; of equal ones that with the greatest hash of its columns."""
    row = F.struct(*columns)
    return saves.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, F.struct(*order, F.xxhash64(*columns))).alias("_row")).select("_row.*")


def upsert_sessions(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """One row per id: the last saved, whole, created_at included. On equal times the new batch wins; within a batch the
    row with the greatest hash, so that the result is the same on every run.

    An aggregate, so each task sums up its rows before the shuffle. Write the result to a new place, never over the
    one that is read.
    """
    both = stored.withColumn("_batch", F.lit(0)).unionByName(saved.withColumn("_batch", F.lit(1)))
    return _last(both, stored.columns, "updated_at", "_batch")


def recent_sessions(sessions: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    """The n sessions created last; on equal times by id."""
    return sessions.orderBy(F.desc("created_at"), "id").limit(n)


def most_recent(saves: DataFrame, n: int = KEPT_SESSIONS) -> DataFrame:
    """The n ids saved last, each with its last save: saves (id, saved_at, ...). Equal times are told apart by hash."""
    return _last(saves, saves.columns, "saved_at").orderBy(F.desc("saved_at"), "id").limit(n)


def lookup_sessions(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """Sessions with an id in ids (id), with results_available. Unknown ids give no row."""
    found = sessions.join(ids.select("id").distinct(), "id", "left_semi")
    return found.withColumn("results_available", F.col("results").isNotNull())


def session_cards(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "id", "mode", "status", "question", F.size("documents").cast("long").alias("n_documents"), F.size("selected_agents").cast("long").alias("n_agents"), "updated_at"
    )


def dashboard_stats(sessions: DataFrame) -> DataFrame:
    """Number of sessions and of their documents."""
    return sessions.agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum(F.size("documents")), F.lit(0)).cast("long").alias("n_documents"))


def document_records(documents: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id and record, the document as sessions keep it. The text, which the documents' table has, is left out unless
    asked for."""
    kept = documents.withColumn("_text", F.col("text") if texts else F.lit(None).cast("string"))
    record = F.struct(F.col("doc_id").alias("id"), "name", F.col("size_bytes").alias("size"), "page_count", "uploaded_at", "preview", F.col("_text").alias("text"))
    return kept.select("doc_id", record.cast(DOCUMENT_RECORD).alias("record"))


def document_parts(request_documents: DataFrame, documents: DataFrame | None = None, part: int = PART_DOCUMENTS) -> DataFrame:
    """The document lists of sessions in parts of bounded length: id, part (from 0) and documents, in the requests' order.

    Part k has the records of ordinals k * part + 1 to (k + 1) * part, so no list of a request is in one row, however
    many documents it names. documents: as for assemble_sessions().
    """
    named = _recorded(request_documents, documents).withColumn("part", F.floor((F.col("doc_ordinal") - 1) / part).cast("long"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_ordinal", "doc_id", "record"))), lambda x: x["record"])
    return named.groupBy(F.col("request_id").alias("id"), "part").agg(listed.alias("documents"))


def counted_parts(sessions: DataFrame, parts: DataFrame) -> DataFrame:
    """Sessions without their documents' array, with n_documents and n_parts from the parts; a session may have none."""
    counts = parts.groupBy(F.col("id").alias("_id")).agg(F.sum(F.size("documents")).alias("n_documents"), F.count("*").alias("n_parts"))
    both = sessions.drop("documents").join(counts, F.col("id") == F.col("_id"), "left").drop("_id")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_documents", "n_parts")})


def _recorded(request_documents: DataFrame, documents: DataFrame | None) -> DataFrame:
    """request_documents with the record of each document, of its id alone where that is all there is."""
    only_id = F.from_json(F.to_json(F.struct(F.col("doc_id").alias("id"))), DOCUMENT_RECORD)
    named = request_documents.select("request_id", "doc_ordinal", "doc_id")
    if documents is None:
        return named.withColumn("record", only_id)
    return named.join(documents.select("doc_id", F.col("record").alias("_record")), "doc_id", "left").withColumn("record", F.coalesce("_record", only_id)).drop("_record")


def assemble_sessions(requests: DataFrame, request_documents: DataFrame, results: DataFrame, mode: str = "demo", documents: DataFrame | None = None) -> DataFrame:
    """Completed sessions of requests (request_id, question, selected_agents, requested_at) and their results.

    Document lists are in the requests' order; documents: doc_id and record, as document_records() makes them, else
    records have ids alone. A document that is named but unknown has just its id. Both times are the request's. The list
    is one array, as in the data model; document_parts() has that of a request which names very many.
    """
    listed = _recorded(request_documents, documents).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_ordinal", "doc_id", "record"))), lambda x: x["record"]).alias("d"))
    joined = requests.join(listed, "request_id", "left").join(results, "request_id", "left")
    return joined.select(
        F.col("request_id").alias("id"),
        "question",
        F.lit("completed").alias("status"),
        F.lit(mode).alias("mode"),
        "selected_agents",
        F.coalesce("d", F.array().cast(f"array<{DOCUMENT_RECORD}>")).alias("documents"),
        "results",
        F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"),
    )
