"""The bucketed store: what a save writes, replays, crashes, lookups, latest sessions and counts."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import sessions
from dossier.sources import session_store as store

KIND = "id string, status string, documents array<string>, results string, created_at timestamp, updated_at timestamp"
DAY = datetime.datetime(2024, 1, 1)


def rows(spark, *some):
    return spark.createDataFrame([(i, s, ["d"] * n, None if n == 1 else "r", DAY + datetime.timedelta(minutes=c), DAY + datetime.timedelta(minutes=u)) for i, s, n, c, u in some], KIND)


def drawn(spark, seed, n, ids):
    rng = random.Random(seed)
    return rows(spark, *((f"s{rng.randrange(ids)}", f"{seed}-{k}", rng.randrange(4), rng.randrange(10**5), rng.randrange(10**5)) for k in range(n)))


def files(path):
    return {f"{d}/{n}": os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(f"{path}/data") for n in names if n.endswith(".parquet")}


def test_versions_equal_upserts_of_everything(spark, tmp_path):
    """Random batches: rows, counts and latest lists equal those made from all saves, without a scan for the counts."""
    path, kept = f"{tmp_path}/store", rows(spark).limit(0)
    for k in range(3):
        batch = drawn(spark, k, 120, 150)
        store.save(spark, path, batch, buckets=8)
        kept = sessions.upsert_sessions(kept, batch)
        schema = kept.schema
        assert sorted(store.read_store(spark, path, schema=schema).collect()) == sorted(kept.collect())
        assert store.stats(spark, path).first() == sessions.dashboard_stats(kept).first()
    for n in (1, 20, 1000):
        assert store.recent_sessions(spark, path, n, schema=schema).collect() == sessions.recent_sessions(kept, n).collect()
        latest = kept.orderBy(F.desc("updated_at"), "id").limit(n)
        assert store.most_recent(spark, path, n, schema=schema).collect() == latest.collect()
    assert store.read_store(spark, path, 0, schema).count() == drawn(spark, 0, 120, 150).select("id").distinct().count()


def test_a_small_save_writes_few_buckets(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.save(spark, path, drawn(spark, 1, 3000, 2000), buckets=32)
    before = files(path)
    version = store.save(spark, path, rows(spark, ("s1", "new", 0, 1, 10**6), ("s1", "newest", 0, 1, 10**6 + 1)))
    new = {k: v for k, v in files(path).items() if k not in before}
    assert len(new) == 1 and sum(new.values()) < sum(before.values()) / 16
    assert len({r["path"] for r in version.rows if "000000000001-" in r["path"]}) == 1
    assert store.lookup(spark, path, spark.createDataFrame([("s1",)], "id string"), schema=rows(spark).schema).first().status == "newest"


def test_replays_and_crashes(spark, tmp_path, monkeypatch):
    path, batch = f"{tmp_path}/store", rows(spark, ("a", "x", 1, 1, 1), ("b", "y", 2, 2, 2))
    store.save(spark, path, batch, 0)
    written = files(path)
    assert store.save(spark, path, rows(spark, ("a", "other", 1, 1, 9)), 0).n_sessions == 2 and files(path) == written  # run again
    commit = store._commit

    def dies(*_):
        raise OSError("between files and manifest")

    monkeypatch.setattr(store, "_commit", dies)
    with pytest.raises(OSError, match="between"):
        store.save(spark, path, rows(spark, ("a", "z", 1, 1, 5)), 1)
    monkeypatch.setattr(store, "_commit", commit)
    schema = batch.schema
    assert {r.id: r.status for r in store.read_store(spark, path, schema=schema).collect()} == {"a": "x", "b": "y"}
    store.save(spark, path, rows(spark, ("a", "z", 1, 1, 5)), 1)
    assert {r.id: r.status for r in store.read_store(spark, path, schema=schema).collect()} == {"a": "z", "b": "y"}
    with pytest.raises(FileExistsError):
        commit(spark, path, store.read_version(spark, path, 1))
    with pytest.raises(ValueError, match="version"):
        store.save(spark, path, batch.limit(0), -5)
    assert store.save(spark, path, batch.limit(0)).number == 2
    store.vacuum(spark, path, keep=1)
    assert store.versions(spark, path) == [2] and len(files(path)) == 2
    assert {r.id: r.status for r in store.read_store(spark, path, schema=schema).collect()} == {"a": "z", "b": "y"}


def test_an_empty_store(spark, tmp_path):
    path, schema = f"{tmp_path}/none", rows(spark).schema
    assert store.read_store(spark, path, schema=schema).count() == 0 and store.stats(spark, path).first() == (0, 0)
    assert store.recent_sessions(spark, path, schema=schema).count() == 0
    assert store.lookup(spark, path, spark.createDataFrame([("a",), (None,)], "id string"), schema=schema).count() == 0
    assert store.save(spark, path, rows(spark).limit(0)).rows == [] and store.read_store(spark, path, schema=schema).count() == 0


def scanned(df):
    """Files and rows that the scans of a plan have read."""
    df.collect()
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            left.append(node.executedPlan())
            continue
        if "Scan parquet" in node.nodeName():
            metrics = node.metrics()
            found.append((metrics.get("numFiles").get().value(), metrics.get("numOutputRows").get().value()))
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return tuple(map(sum, zip(*found)))


def test_lookups_read_only_what_can_have_the_ids(spark, tmp_path):
    path = f"{tmp_path}/store"
    made = spark.range(40_000).selectExpr("concat('session-', id) AS id", "sha2(string(id), 512) AS status", "array('d') AS documents", "'r' AS results", "timestamp'2024-01-01' AS created_at", "timestamp'2024-01-01' AS updated_at")
    store.save(spark, path, made, buckets=16, row_group=1 << 16)
    ids = spark.createDataFrame([(f"session-{k * 997}",) for k in range(10)] + [("none such",)], "id string")
    found = store.lookup(spark, path, ids, schema=made.schema)
    n_files, n_rows = scanned(found)
    assert found.count() == 10 and n_files <= 11 and n_rows <= 40_000 / 4
    many = made.select("id").filter("hash(id) % 3 = 0")
    assert store.lookup(spark, path, many, schema=made.schema).count() == many.count()


def test_latest_sessions_leave_buckets_unread(spark, tmp_path):
    path = f"{tmp_path}/store"
    store.save(spark, path, rows(spark, *((f"s{k}", "x", 1, k, k) for k in range(2000))), buckets=64)
    found, read = store._latest(spark, path, 20, "created_at", None, rows(spark).schema)
    assert [r.id for r in found.collect()] == [f"s{k}" for k in range(1999, 1979, -1)]
    assert len(read) <= 20 < len(store.read_version(spark, path).rows)
