import os

import pytest
from pyspark.sql import functions as F

from presage.session import new_path, shared_dir, staged
from presage.sources import profile, shards
from presage.sources.schemas import TABLES, table_schema
from presage.sources.tables import read_report, read_table, write_report, write_table

SENTINEL = "18446744073709551615"


@pytest.fixture()
def raw(tmp_path):
    events = tmp_path / "machine_events"
    events.mkdir()
    (events / "part-00000-of-00001.csv").write_text(
        f"0,5,0,abc,0.5,0.25\n{SENTINEL},6,1,,,\n10,{SENTINEL},2,,0.5,\n"
    )
    (events / "schema.csv").write_text("not,a,shard\n")
    usage = tmp_path / "task_usage"
    usage.mkdir()
    for index in (0, 25, 172, 173, 400):
        line = [str(index), "9", "1", "0", "", *[""] * 15]
        (usage / f"part-{index:05d}-of-00500.csv").write_text(",".join(line) + "\n")
    return str(tmp_path)


def test_typed_read_with_sentinel_and_empty(spark, raw):
    df = shards.read_shards(spark, f"{raw}/machine_events", "machine_events")
    assert df.schema == table_schema("machine_events")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [(0, 5, 0, "abc", 0.5, 0.25), (None, 6, 1, None, None, None), (10, None, 2, None, 0.5, None)], key=str
    )


def test_malformed_values_raise(spark, tmp_path):
    (tmp_path / "part-00000-of-00001.csv").write_text("x1,5,0,abc,0.5,0.25\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        shards.read_shards(spark, str(tmp_path), "machine_events").collect()


def test_unknown_table():
    assert set(TABLES) == {"task_events", "job_events", "machine_events", "machine_attributes", "task_usage"}
    with pytest.raises(ValueError, match="unknown table"):
        table_schema("nope")


def test_ingest_routes_usage_shards(spark, raw):
    out = new_path(spark, "ingest")
    paths = shards.ingest_table(spark, raw, out, "task_usage")
    near, far = (read_table(spark, paths[n]) for n in ("task_usage", "task_usage_snapshots"))
    assert sorted(r["start_time"] for r in near.collect()) == [0, 25, 172]
    assert sorted(r["start_time"] for r in far.collect()) == [173, 400]
    assert near.schema["cpi"].dataType.typeName() == "float"
    assert list(shards.ingest_table(spark, raw, out, "machine_events")) == ["machine_events"]


def test_shard_selection(spark, raw):
    df = shards.read_shards(spark, f"{raw}/task_usage", "task_usage", with_shard=True)
    assert sorted(r["shard"] for r in shards.shard_range(df, 25, 173).collect()) == [25, 172, 173]
    assert sorted(r["shard"] for r in shards.spaced_shards(df, 500, 20).collect()) == [0, 25, 400]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None), (4, "y")], "a int, b string")
    got = {r["column_name"]: (r["n_rows"], r["n_null"], r["null_pct"]) for r in profile.table_profile(df).collect()}
    assert got == {"a": (4, 1, 25.0), "b": (4, 2, 50.0)}
    assert {r["null_pct"] for r in profile.table_profile(df.where("a = 9")).collect()} == {0.0}


def test_file_profile(spark):
    path = new_path(spark, "files")
    spark.range(100).repartition(3).write.parquet(path)
    row = profile.file_profile(read_table(spark, path)).first()
    assert row["n_files"] == 3 and row["size_mb"] > 0


def test_upsert_replaces_keys(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, 2.0)], "k string, n int, x double")
    new = spark.createDataFrame([("b", None, 3.0), ("c", 4, 4.0)], "k string, n int, x double")
    got = sorted(map(tuple, profile.upsert(old, new, ["k"]).collect()))
    assert got == [("a", 1, None), ("b", None, 3.0), ("c", 4, 4.0)]


def test_sorted_write_keeps_rows_and_orders_files(spark):
    path = new_path(spark, "sorted")
    write_table(spark.range(1000).select((1000 - F.col("id")).alias("t")), path, sort_by="t")
    df = read_table(spark, path, "t")
    ranges = df.groupBy(F.input_file_name()).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("lo").collect()
    assert df.count() == 1000 and all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))


def test_reports(spark, tmp_path):
    path = new_path(spark, "report")
    df = spark.createDataFrame([("m", 0.123456)], "model string, f1 double")
    write_report(df, path, digits=4)
    assert read_report(spark, path, df.schema).first()["f1"] == 0.1235
    document = tmp_path / "one.json"
    document.write_text('{\n "threshold": 0.35,\n "bins": [1, 2]\n}')
    assert read_report(spark, str(document)).first()["threshold"] == 0.35


def test_staged_data_lives_in_the_configured_folder(spark):
    df = staged(spark.range(5), "mine")
    assert all(p.removeprefix("file://").startswith(shared_dir(spark)) for p in df.inputFiles())
    assert df.count() == 5


def test_staged_folders_are_released(spark, monkeypatch):
    from presage import session

    monkeypatch.setattr(session, "_OWN_PATHS", [])  # leave those of other tests
    kept = session.staged(spark.range(3))
    assert kept.count() == 3
    path = session._OWN_PATHS[0]
    assert session.release(spark) == 1 and session._OWN_PATHS == []
    assert not os.path.exists(path)
