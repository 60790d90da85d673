"""Intake, validation and editing of analysis requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.messages import MESSAGES
from dossier.functions.text import strip
from dossier.operators.numbering import numbered
from dossier.sources.documents import one_per_text


def _field(value: str, name: str, kind: str) -> Column:
    return F.try_variant_get(F.col(value), f"$.{name}", kind)


def _listed(bodies: DataFrame) -> DataFrame:
    """request_id, pos and document, a variant: whole, as an object, or its id alone."""
    parsed = bodies.select("request_id", F.try_parse_json("body").alias("b"))
    return parsed.select("request_id", F.posexplode(_field("b", "documents", "array<variant>")).alias("pos", "document"))


def _is_object(value: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def request_intake(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bodies (request_id, body as JSON) -> requests (request_id, question, selected_agents, body_error) and
    request_documents (request_id, doc_ordinal, doc_id).

    A document in a body is an id, or an object with an id and the text itself; uploaded_documents() has the texts of
    those. A body that is no JSON object, or has more than a variant holds (128 MB), is a request without a question and
    with a body_error, and names no documents; a field of another type than its own counts as absent. An object without
    an id keeps its place in the list, and its doc_id is null.
    """
    parsed = bodies.select("request_id", F.try_parse_json("body").alias("b"))
    error = F.when(~_is_object("b"), MESSAGES["request.error.body"])
    requests = parsed.select("request_id", _field("b", "question", "string").alias("question"), _field("b", "selectedAgents", "array<string>").alias("selected_agents"), error.alias("body_error"))
    doc_id = F.when(_is_object("document"), _field("document", "id", "string")).otherwise(F.try_variant_get(F.col("document"), "$", "string"))
    return requests, _listed(bodies).select("request_id", (F.col("pos") + 1).alias("doc_ordinal"), doc_id.alias("doc_id"))


def uploaded_documents(bodies: DataFrame) -> DataFrame:
    """The documents that bodies carry whole, a row for each id and text, with error: see one_per_text()."""
    whole = _listed(bodies).filter(_is_object("document"))
    fields = {"doc_id": ("id", "string"), "name": ("name", "string"), "size_bytes": ("size", "long"), "page_count": ("pageCount", "int"), "uploaded_at": ("uploadedAt", "timestamp"), "text": ("text", "string")}
    return one_per_text(whole.select(*(_field("document", f, kind).alias(c) for c, (f, kind) in fields.items())))


def validate_requests(requests: DataFrame, request_documents: DataFrame, min_question_chars: int = 1, messages: dict[str, str] = MESSAGES) -> DataFrame:
    """requests with n_documents, valid and error; rejected rows stay.

    A question needs min_question_chars after white space is stripped, a request a document and a list of analyses. A
    body_error that the intake found stands before the others.
    """
    counts = request_documents.groupBy(F.col("request_id").alias("_request")).agg(F.count("*").alias("_n"))
    counted = requests.join(counts, F.col("request_id") == F.col("_request"), "left").withColumn("n_documents", F.coalesce("_n", F.lit(0))).drop("_request", "_n")
    bad = (F.char_length(strip(F.col("question"))) < min_question_chars) | (F.col("n_documents") == 0)
    unread = F.col("body_error") if "body_error" in requests.columns else F.lit(None).cast("string")
    error = F.when(unread.isNotNull(), unread).when(bad, messages["request.error"]).when(F.col("selected_agents").isNull(), messages["request.error.agents"])
    return counted.withColumn("error", error).withColumn("valid", F.col("error").isNull())


def remove_documents(request_documents: DataFrame, removed: DataFrame) -> DataFrame:
    """Without the (request_id, doc_id) of removed; the order of the others stays."""
    return request_documents.join(removed.select("request_id", "doc_id").distinct(), ["request_id", "doc_id"], "left_anti")


def append_documents(request_documents: DataFrame, added: DataFrame) -> DataFrame:
    """added (request_id, doc_ordinal, doc_id) behind the documents that a request has; repeats stay."""
    last = request_documents.groupBy(F.col("request_id").alias("_request")).agg(F.max("doc_ordinal").alias("_last"))
    turns = numbered(added.select("request_id", "doc_ordinal", "doc_id"), "request_id", "doc_ordinal", "doc_id")
    behind = turns.join(last, F.col("request_id") == F.col("_request"), "left").select("request_id", (F.col("number") + F.coalesce("_last", F.lit(0))).cast("int").alias("doc_ordinal"), "doc_id")
    return request_documents.select("request_id", "doc_ordinal", "doc_id").unionByName(behind)
