"""The engine's tables over the given Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.values import ADVERSE, AGENTS, CONSENSUS, INTERACTION, LITERATURE, TRIAL
from dossier.operators.broadcasts import few_or_all
from dossier.operators.numbering import numbered
from dossier.sources.documents import chunk_documents, ingest_documents
from dossier.sources.schemas import BUNDLE, DOCUMENT_RECORD
from dossier.sources.shared import spread

#: When documents count as uploaded and requests as made, as the given tables have no such times.
UPLOADED = "2024-01-01 00:00:00"
#: Sources of documents; a request names all documents of one.
SOURCES = 20


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str, named: DataFrame | None = None) -> DataFrame:
    """named: the documents that are read (doc_id, distinct), where not all are."""
    docs = _read(spark, sf_dir, "documents")
    if named is None:
        docs = spread(docs)
    else:
        docs = docs.join(few_or_all(named.select(F.col("doc_id").cast("long").alias("doc_id"))), "doc_id", "left_semi")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("n_chars").cast("long").alias("size_bytes"),
        F.lit(None).cast("int").alias("page_count"),
        F.lit(UPLOADED).cast("timestamp").alias("uploaded_at"),
        "text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_documents(raw_documents(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents(spark, sf_dir))


def chunks_of(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Makes the chunks of some documents (doc_id, distinct): others are neither cleaned nor cut."""
    return lambda named: chunk_documents(ingest_documents(raw_documents(spark, sf_dir, named)))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per benchmark item; bit i of its id leaves out analysis i."""
    chosen = F.filter(F.array(*(F.when(F.col("item_id").bitwiseAND(1 << i) == 0, agent) for i, agent in enumerate(AGENTS))), lambda a: a.isNotNull())
    return _read(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("request_id"), F.col("text").alias("question"), chosen.alias("selected_agents"), F.lit(UPLOADED).cast("timestamp").alias("requested_at")
    )


def request_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request names the documents of one source, in order of their numbers.

    Documents are numbered once a source, in blocks of their numbers, so that no source is in one task.
    """
    docs = numbered(_read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    docs = docs.select("source", F.col("number").cast("int").alias("doc_ordinal"), F.col("doc_id").cast("string").alias("doc_id"))
    wanted = _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), F.concat(F.lit("src"), F.col("item_id") % SOURCES).alias("source"))
    return wanted.join(docs, "source").select("request_id", "doc_ordinal", "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of a model to some analyses of each request, in JSON: whole, in parts, corrupt, empty, and several at a time."""
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.col("item_id").cast("string").alias("request_id"))
    at = lambda day: F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp")
    text = lambda before: F.concat(F.lit(before), "request_id")
    summary = lambda before: F.to_json(F.struct(text(before).alias("summary"), F.lit("high").alias("confidence")))
    finding = F.array(F.struct(F.lit("Named by a model").alias("possibleInteraction"), F.lit("moderate").alias("severityEstimate")))
    excerpt = F.array(F.struct(text("Quoted for ").alias("excerpt"), F.lit("report.pdf").alias("documentName"), F.lit(7).alias("page")))
    cases = [
        (F.col("i") % 4 == 0, LITERATURE, at(2), summary("Model's passages for ")),
        (F.col("i") % 4 == 0, LITERATURE, at(3), F.lit('{"summary": "cut off')),
        (F.col("i") % 4 == 1, LITERATURE, at(2), F.lit("{}")),
        (F.col("i") % 4 == 1, LITERATURE, at(3), F.to_json(F.struct(text("Newer passages for ").alias("summary"), F.lit("medium").alias("confidence"), excerpt.alias("topRelevantExcerpts")))),
        (F.col("i") % 3 == 0, ADVERSE, at(2), summary("Model's safety notes for ")),
        (F.col("i") % 3 == 1, INTERACTION, at(2), F.to_json(F.struct(text("Model's interactions for ").alias("summary"), finding.alias("findings")))),
        (F.col("i") % 3 == 2, TRIAL, at(2), F.lit("")),
        (F.col("i") % 6 == 5, CONSENSUS, at(2), F.to_json(F.struct(text("Model's conclusion for ").alias("finalConsensus"), F.array(F.lit("first gap"), F.lit("second gap")).alias("missingEvidence")))),
    ]
    each = F.array(*(F.when(when, F.struct(F.lit(agent).alias("agent_id"), content.alias("content"), received.alias("received_at"))) for when, agent, received, content in cases))
    return items.select("request_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select("request_id", "r.*")


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as JSON bodies, as a client sends them."""
    listed = request_documents(spark, sf_dir).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("doc_ordinal", "doc_id"))).alias("d"))
    joined = requests(spark, sf_dir).join(listed, "request_id", "left")
    body = F.struct("question", F.transform("d", lambda x: x["doc_id"]).alias("documents"), F.col("selected_agents").alias("selectedAgents"))
    return joined.select("request_id", F.to_json(body).alias("body"))


#: Documents that come with one body, and items whose texts are their questions.
UPLOAD, UPLOAD_ITEMS = 8, 40


def upload_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies that carry their documents whole: each eight in a row, every fifth by its id alone; every tenth body is cut off."""
    docs = spread(_read(spark, sf_dir, "documents")).withColumn("g", F.floor(F.col("doc_id") / UPLOAD))
    number = F.col("doc_id").cast("string")
    whole = F.struct(number.alias("id"), F.concat(F.col("source"), F.lit("-"), number, F.lit(".txt")).alias("name"), F.col("n_chars").alias("size"), F.lit("2024-01-01T00:00:00Z").alias("uploadedAt"), "text")
    sent = F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(F.to_json(whole))
    lists = docs.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", sent.alias("sent")))), lambda x: x["sent"]), ",").alias("sent"))  # eight
    items = _read(spark, sf_dir, "benchmark").filter(F.col("item_id") < UPLOAD_ITEMS).select("item_id", "text")
    head = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.lit(LITERATURE)).alias("selectedAgents")))
    body = F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"documents":['), "sent", F.lit("]}"))
    asked = lists.join(F.broadcast(items), F.col("g") % UPLOAD_ITEMS == F.col("item_id"))
    return asked.select(F.concat(F.lit("u"), F.col("g").cast("string")).alias("request_id"), F.when(F.col("g") % 10 == 9, F.substring(body, 1, F.length(body) - 1)).otherwise(body).alias("body"))


def raw_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_documents() with faults: some rows without a doc_id, some a second time with another text, some twice alike."""
    raw, n = raw_documents(spark, sf_dir), F.col("doc_id").cast("long")
    with_null = raw.withColumn("doc_id", F.when(n % 19 != 7, F.col("doc_id")))
    again = raw.filter((n % 23 == 3) | (n % 29 == 5)).withColumn("text", F.when(n % 23 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return with_null.unionByName(again)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations as questions."""
    turns = _read(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("text").alias("question"))


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A save of a session per event, with event_id; every third user has no list of agents, every fourth no documents."""
    events = _read(spark, sf_dir, "events")
    first = events.groupBy(F.col("user_id").alias("u")).agg(F.min("ts").alias("created_at"))
    user = F.col("user_id")
    agents = F.slice(F.array(*map(F.lit, AGENTS)), F.lit(1), (user % 6 + 1).cast("int"))
    listed = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 5 + 1).cast("int")), lambda k: F.struct(F.concat(F.lit("doc"), k.cast("string")).alias("id"), (k * 100).cast("long").alias("size")))
    docs = F.from_json(F.to_json(listed), f"array<{DOCUMENT_RECORD}>")
    # The number k stands as the conclusion of the results.
    results = F.from_json(F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").alias("final_consensus")).alias("debate_consensus"))), BUNDLE)
    return events.join(first, user == F.col("u")).select(
        "event_id",
        user.cast("string").alias("id"),
        F.concat(F.lit("Events of user "), user.cast("string")).alias("question"),
        F.col("event_type").alias("status"),
        F.when(user % 2 == 0, "authenticated").otherwise("demo").alias("mode"),
        F.when(user % 3 != 0, agents).alias("selected_agents"),
        F.when(user % 4 != 0, docs).alias("documents"),
        F.when(F.col("event_id") % 10 != 0, results).alias("results"),
        F.col("created_at").cast("timestamp").alias("created_at"),
        F.col("ts").cast("timestamp").alias("updated_at"),
    )


def saved_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first half of the saves, of which the last per session is stored, and the rest as a new batch."""
    half = _read(spark, sf_dir, "events").count() / 2
    all_saves = saves(spark, sf_dir)
    return all_saves.filter(F.col("event_id") < half).drop("event_id"), all_saves.filter(F.col("event_id") >= half).drop("event_id")
