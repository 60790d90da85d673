from dossier.operators.sessions import upsert_sessions
from dossier.sources import tables
from dossier.streaming.saves import read_snapshot, upsert_stream


def test_stream_ends_as_the_batch_does(spark, sf_dir, tmp_path):
    saves = tables.saves(spark, sf_dir).drop("event_id")
    saves.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(saves.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = upsert_stream(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", keep=2)
    assert query.awaitTermination(120)
    found = read_snapshot(spark, f"{tmp_path}/store", 2, saves.schema)
    wanted = upsert_sessions(saves.limit(0), saves)
    columns = ("id", "status", "updated_at")
    assert sorted(found.select(*columns).collect()) == sorted(wanted.select(*columns).collect())
    assert found.count() == saves.select("id").distinct().count()
    assert sorted(p.name for p in (tmp_path / "store").glob("manifest*.json")) == ["manifest-000000000001.json", "manifest-000000000002.json"]
