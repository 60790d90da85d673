"""Readers and writers of stored tables. Schemas are stated, and nothing that is read is written over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.sessions import read_sessions
from dossier.sources import schemas
from dossier.sources.documents import checked_documents, ingest_documents
from dossier.sources.requests import request_intake, uploaded_documents
from dossier.sources.shared import spread


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents from Parquet, ingested."""
    return ingest_documents(spread(spark.read.schema(schemas.DOCUMENT).parquet(path)))


def load_checked_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Extracted documents from Parquet: those ingested, and the raw rows that can't be, with an error."""
    checked = checked_documents(spread(spark.read.schema(schemas.DOCUMENT).parquet(path)))
    return ingest_documents(checked.filter("error is null").drop("error")), checked.filter("error is not null")


def _bodies(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema("request_id string, body string").json(path)  # a body stays the text that it is
    return lines.filter("request_id is not null")


def load_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests and their documents from lines of JSON: {"request_id": ..., "body": {...}}."""
    return request_intake(_bodies(spark, path))


def load_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents that such lines carry whole: those ingested, and the raw rows that can't be, with an error."""
    sent = uploaded_documents(_bodies(spark, path))
    return ingest_documents(sent.filter("error is null").drop("error")), sent.filter("error is not null")


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSE).json(path)


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    return read_sessions(spark.read.schema(schemas.SESSION).parquet(path))


def save_sessions(sessions: DataFrame, path: str) -> None:
    """A new snapshot; fails if the path exists."""
    sessions.write.mode("errorifexists").parquet(path)


def save_reports(analysed: DataFrame, path: str) -> None:
    """Reports as a table."""
    analysed.select("request_id", "report.*").write.mode("errorifexists").parquet(path)


def save_markdown(analysed: DataFrame, path: str) -> None:
    """A folder of markdown text per request."""
    analysed.select("request_id", F.col("report.markdown_report").alias("value")).write.mode("errorifexists").partitionBy("request_id").text(path)
