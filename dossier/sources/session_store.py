"""Sessions in hash buckets under a manifest, so that a save rewrites the buckets it touches and no others.

A version of the store is one manifest, a line of JSON per bucket: where the bucket's files are, and what is kept about
it (times in microseconds). Files are written first, under names that no manifest has yet; then the manifest is renamed to its version's name,
which commits. What a failed save leaves behind is in no manifest. Nothing that a manifest names is written over.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.values import KEPT_SESSIONS, RECENT_SESSIONS
from dossier.operators.sessions import lookup_sessions, upsert_sessions
from dossier.sources.schemas import SESSION
from dossier.sources.shared import cut, remove

#: Buckets of a new store. Choose so many that a bucket is some hundred MB.
BUCKETS = 64
#: Bytes of a row group, the least that a lookup reads of a file.
ROW_GROUP = 16 << 20
#: Ids that a lookup hands to the scan as a filter, at most; more are joined.
FILTER_IDS = 1_000

_MANIFEST = "bucket int, path string, n_sessions long, n_documents long, max_created_at long, max_updated_at long, buckets int"


@dataclass(frozen=True)
class Version:
    """A version's number, -1 before the first, and its buckets as the manifest has them."""

    number: int
    buckets: int
    rows: list[dict]

    @property
    def n_sessions(self) -> int:
        return sum(r["n_sessions"] for r in self.rows)

    @property
    def n_documents(self) -> int:
        return sum(r["n_documents"] for r in self.rows)


def _fs(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _manifest(store: str, number: int) -> str:
    return f"{store}/manifest-{number:012d}.json"


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the versions that are there, in order."""
    fs, folder = _fs(spark, store)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n[9:21]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def read_version(spark: SparkSession, store: str, number: int | None = None, buckets: int = BUCKETS) -> Version:
    """A version's manifest, the last one's unless a number is given; before the first, no buckets have rows."""
    known = versions(spark, store)
    if number is None:
        number = known[-1] if known else -1
    if number < 0:
        return Version(-1, buckets, [])
    rows = [r.asDict() for r in spark.read.schema(_MANIFEST).json(_manifest(store, number)).collect()]  # a row per bucket
    return Version(number, rows[0]["buckets"], [r for r in rows if r["path"]])


def _commit(spark: SparkSession, store: str, version: Version) -> None:
    """Writes a manifest under a new name and renames it; the first of two savers of one version wins, the other fails."""
    rows = version.rows or [dict.fromkeys(("bucket", "path", "n_sessions", "n_documents", "max_created_at", "max_updated_at"))]
    lines = [json.dumps({**r, "buckets": version.buckets}) for r in rows]
    fs, path = _fs(spark, f"{store}/.{uuid.uuid4().hex}")
    out = fs.create(path)
    out.write(bytearray("\n".join(lines).encode()))
    out.close()
    _, final = _fs(spark, _manifest(store, version.number))
    if fs.exists(final) or not fs.rename(path, final):
        fs.delete(path, False)
        raise FileExistsError(f"version {version.number} of {store} is there already")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, rows: list[dict], schema) -> DataFrame:
    paths = [r["path"] for r in rows]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, store: str, number: int | None = None, schema=SESSION) -> DataFrame:
    """The sessions of a version, the last one unless a number is given."""
    return _files(spark, read_version(spark, store, number).rows, schema)


def save(spark: SparkSession, store: str, saved: DataFrame, number: int | None = None, buckets: int = BUCKETS, row_group: int = ROW_GROUP) -> Version:
    """Upserts saved (sessions) as the store's next version, or as version `number`, which is left as it is if it is
    there already: a save that is run again after a failure changes nothing.

    Only buckets that saved touches are read and written, whole; their counts and latest times take the old ones' place
    in the manifest, so that totals need no scan. Files are sorted by id, with a Bloom filter of the ids. buckets is
    fixed by the first version.
    """
    known = versions(spark, store)
    if number is not None and number in known:
        return read_version(spark, store, number)
    before = read_version(spark, store, known[-1] if known else -1, buckets)
    number = before.number + 1 if number is None else number
    if number <= before.number:
        raise ValueError(f"{store} is at version {before.number} already")
    saved = cut(saved.withColumn("_bucket", _bucket(before.buckets)), "saved-sessions")
    touched = {r["_bucket"] for r in saved.select("_bucket").distinct().collect()}  # as many as there are buckets
    if not touched:
        version = Version(number, before.buckets, before.rows)
        _commit(spark, store, version)
        return version
    plain = saved.drop("_bucket")
    merged = upsert_sessions(_files(spark, [r for r in before.rows if r["bucket"] in touched], plain.schema), plain)
    folder = f"{store}/data/{number:012d}-{uuid.uuid4().hex}"
    dealt = merged.withColumn("bucket", _bucket(before.buckets)).repartition(min(len(touched), 10_000), "bucket").sortWithinPartitions("bucket", "id")
    options = {"parquet.bloom.filter.enabled#id": "true", "parquet.block.size": str(row_group)}
    dealt.write.options(**options).partitionBy("bucket").parquet(folder)
    written = spark.read.schema(T.StructType([*plain.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
    documents = F.sum(F.coalesce(F.array_size("documents"), F.lit(0))).cast("long")
    latest = (F.unix_micros(F.max(c)).alias(f"max_{c}") for c in ("created_at", "updated_at"))
    counted = written.groupBy("bucket").agg(F.count("*").alias("n_sessions"), documents.alias("n_documents"), *latest)
    rows = [{**r.asDict(), "path": f"{folder}/bucket={r['bucket']}"} for r in counted.collect()]
    version = Version(number, before.buckets, sorted([r for r in before.rows if r["bucket"] not in touched] + rows, key=lambda r: r["bucket"]))
    _commit(spark, store, version)
    return version


def lookup(spark: SparkSession, store: str, ids: DataFrame, number: int | None = None, schema=SESSION) -> DataFrame:
    """Sessions with an id in ids (id), with results_available, from the buckets that can have them.

    Up to FILTER_IDS ids go to the scan as a filter, which passes over row groups by their sorted ids and Bloom filters.
    """
    version = read_version(spark, store, number)
    wanted = cut(ids.select("id").filter("id is not null").distinct().withColumn("_bucket", _bucket(version.buckets)), "looked-up")
    touched = {r["_bucket"] for r in wanted.select("_bucket").distinct().collect()}
    rows = _files(spark, [r for r in version.rows if r["bucket"] in touched], schema)
    few = [r.id for r in wanted.select("id").limit(FILTER_IDS + 1).collect()]
    if len(few) <= FILTER_IDS:
        return rows.filter(F.col("id").isin(few)).withColumn("results_available", F.col("results").isNotNull())
    return lookup_sessions(rows, wanted)


def _latest(spark: SparkSession, store: str, n: int, time: str, number: int | None, schema) -> tuple[DataFrame, list[dict]]:
    """The n sessions last by a time, and the buckets that are read.

    The n buckets with the latest maxima have n sessions as late as the least of these maxima, so a bucket whose own
    maximum is before it is not read: n are, and more on equal times only.
    """
    rows = read_version(spark, store, number).rows
    maxima = sorted((r[f"max_{time}"] for r in rows if r[f"max_{time}"] is not None), reverse=True)
    chosen = [r for r in rows if r[f"max_{time}"] is not None and r[f"max_{time}"] >= maxima[n - 1]] if len(maxima) >= n else rows
    return _files(spark, chosen, schema).orderBy(F.desc_nulls_last(time), "id").limit(n), chosen


def recent_sessions(spark: SparkSession, store: str, n: int = RECENT_SESSIONS, number: int | None = None, schema=SESSION) -> DataFrame:
    """The n sessions created last; on equal times by id."""
    return _latest(spark, store, n, "created_at", number, schema)[0]


def most_recent(spark: SparkSession, store: str, n: int = KEPT_SESSIONS, number: int | None = None, schema=SESSION) -> DataFrame:
    """The n sessions saved last; on equal times by id."""
    return _latest(spark, store, n, "updated_at", number, schema)[0]


def stats(spark: SparkSession, store: str, number: int | None = None) -> DataFrame:
    """Number of sessions and of their documents, from the manifest."""
    version = read_version(spark, store, number)
    return spark.createDataFrame([(version.n_sessions, version.n_documents)], "n_sessions long, n_documents long")


def vacuum(spark: SparkSession, store: str, keep: int = 3) -> None:
    """Removes versions but the last `keep`, and all data that none of those has. Not to be run while a save is."""
    known = versions(spark, store)
    for number in known[: -max(1, keep)]:
        remove(spark, _manifest(store, number))
    used = {r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1] for number in known[-max(1, keep) :] for r in read_version(spark, store, number).rows}
    fs, data = _fs(spark, f"{store}/data")
    if fs.exists(data):
        for folder in fs.listStatus(data):
            inside = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.isDirectory()]
            unused = [p for p in inside if f"{folder.getPath().getName()}/{p.getName()}" not in used]
            for p in [folder.getPath()] if len(unused) == len(inside) else unused:
                fs.delete(p, True)
