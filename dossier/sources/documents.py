"""Ingest of extracted documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.messages import MESSAGES
from dossier.functions.text import excerpt, pages_of, sanitize
from dossier.functions.values import CHUNK_CHARS
from dossier.operators.broadcasts import few_or_all

PREVIEW_CHARS = 280
#: Characters of consecutive chunks whose scores are bounded together.
BLOCK_CHARS = 3000


def ingest_documents(raw: DataFrame) -> DataFrame:
    """raw (doc_id, name, size_bytes, page_count, uploaded_at, text) with clean text, preview and page count.

    A missing or zero page count is estimated from the clean text. Narrow: nothing is shuffled.
    """
    clean = raw.withColumn("text", sanitize(F.col("text")))
    return clean.withColumn("preview", excerpt(F.col("text"), PREVIEW_CHARS)).withColumn(
        "page_count", F.coalesce(F.nullif("page_count", F.lit(0)), pages_of(F.char_length("text"))).cast("int")
    )


def checked_documents(raw: DataFrame) -> DataFrame:
    """raw with error: why a row can't be ingested, null if it can.

    A row needs a doc_id, and no other row may have another text under it: which one is meant is unknown, so all rows of
    such an id are kept back. Rows without an error and with one equal the input; repeated rows stay. Only ids and
    hashes are shuffled; ids with several texts are few and broadcast up to a bound.
    """
    texts = raw.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.min(_text_hash()).alias("_low"), F.max(_text_hash()).alias("_high"))
    several = few_or_all(texts.filter("_low != _high").select("_doc"))
    joined = raw.join(several, F.col("doc_id") == F.col("_doc"), "left")
    error = F.when(F.col("doc_id").isNull(), MESSAGES["document.error.id"]).when(F.col("_doc").isNotNull(), MESSAGES["document.error.texts"])
    return joined.withColumn("error", error).drop("_doc")


def _text_hash():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def one_per_text(raw: DataFrame) -> DataFrame:
    """checked_documents() with one row for each doc_id and text: that with the least name, size and time."""
    fields = [c for c in raw.columns if c not in ("doc_id", "text")]
    one = raw.groupBy("doc_id", _text_hash().alias("_hash")).agg(F.min(F.struct(*fields, "text")).alias("_row"))
    return checked_documents(one.select("doc_id", *(F.col(f"_row.{c}").alias(c) for c in raw.columns if c != "doc_id")))


def block_documents(documents: DataFrame, chunk_chars: int = CHUNK_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, first_offset, n_chunks and lower_text of each block of consecutive chunks.

    block_chars is a multiple of chunk_chars.
    A run that chunks cut in two is whole here, so a block's words hold all that its chunks' words do, and may hold more.
    Narrow: nothing is shuffled.
    """
    n = F.char_length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(block_chars)))
    cut = documents.select("doc_id", "text", F.explode_outer(starts).alias("first_offset")).filter("first_offset is not null")
    lower = F.lower(F.substr("text", F.col("first_offset") + 1, F.lit(block_chars)))
    chunks = F.ceil((F.least(n, F.col("first_offset") + block_chars) - F.col("first_offset")) / chunk_chars)
    return cut.select("doc_id", "first_offset", chunks.cast("int").alias("n_chunks"), lower.alias("lower_text"))


def chunk_documents(documents: DataFrame, chunk_chars: int = CHUNK_CHARS, *more: str) -> DataFrame:
    """Consecutive slices of each text: chunk_id, doc_id, doc_name, char_offset, page, text, lower_text.

    An empty or null text has none, and the last slice may be short. The page is estimated from where the slice begins.
    more: columns of documents that each chunk has too.
    """
    n = F.char_length("text")
    # An inner explode, or a filter of empty texts, would have Spark make the text twice: to test it, and to cut it.
    offsets = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk_chars)))
    cut = documents.select("doc_id", F.col("name").alias("doc_name"), "text", *more, F.explode_outer(offsets).alias("char_offset")).filter("char_offset is not null")
    chunk = F.substr("text", F.col("char_offset") + 1, F.lit(chunk_chars))
    return cut.select(
        F.concat_ws("-", "doc_id", "char_offset").alias("chunk_id"), "doc_id", "doc_name", "char_offset", pages_of(F.col("char_offset")).alias("page"), chunk.alias("text"), F.lower(chunk).alias("lower_text"), *more
    )
