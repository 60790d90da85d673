"""Session saves as a stream, upserted into a store of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dossier.sources import session_store


def read_snapshot(spark: SparkSession, store: str, batch: int, schema) -> DataFrame:
    """Sessions as they were after a batch; none before the first."""
    return session_store.read_store(spark, store, batch, schema)


def upsert_stream(saves: DataFrame, store: str, checkpoint: str, trigger: dict | None = None, keep: int = 3) -> StreamingQuery:
    """Keeps the last save of each id. Batch n makes version n of the store and rewrites the buckets that it touches.

    A batch that is run again after a failure finds its version there, or makes it anew from the version before. The
    last `keep` versions stay, two at least.
    """

    def save(batch: DataFrame, number: int) -> None:
        session_store.save(batch.sparkSession, store, batch, number)
        session_store.vacuum(batch.sparkSession, store, max(2, keep))

    return saves.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
