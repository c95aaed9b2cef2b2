import os

import pytest

from presage.sources import ledger

def put(raw, shard, rows, name="task_usage"):
    from presage.sources.schemas import table_schema

    names = table_schema(name).names
    os.makedirs(f"{raw}/{name}", exist_ok=True)
    path = f"{raw}/{name}/part-{shard:05d}-of-00500.csv"
    with open(path, "w") as f:
        for r in rows:
            f.write(",".join("" if r.get(c) is None else str(r[c]) for c in names) + "\n")
    return path


def usage(job, t):
    return {"start_time": t, "end_time": t + 1, "job_id": job, "task_index": 0, "machine_id": 5, "cpu_rate": 0.5}


def jobs_of(spark, out, name, entries):
    rows = ledger.read_ingested(spark, out, name, entries)
    return None if rows is None else sorted((r["job_id"], r["shard"]) for r in rows.collect())


def test_only_new_and_changed_files_are_read(spark, tmp_path, monkeypatch):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    seen, real = [], ledger.read_shards
    monkeypatch.setattr(ledger, "read_shards", lambda spark, paths, *a, **k: (seen.append(sorted(p[-22:] for p in paths)), real(spark, paths, *a, **k))[1])
    put(raw, 3, [usage(1, 10), usage(2, 20)])
    put(raw, 200, [usage(3, 30)])

    def step(entries, run):
        found = ledger.ingest_increment(spark, raw, out, "task_usage", entries, run)
        return spark.createDataFrame(found.collect(), ledger.LEDGER)

    one = step(ledger.empty_ledger(spark), "a")
    assert jobs_of(spark, out, "task_usage", one) == [(1, 3), (2, 3)] and jobs_of(spark, out, "task_usage_snapshots", one) == [(3, 200)]
    assert len(seen) == 2
    two = step(one, "b")
    assert len(seen) == 2 and sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect()))
    put(raw, 4, [usage(4, 40)])
    path = put(raw, 3, [usage(9, 10)])
    os.utime(path, (2e9, 2e9))
    three = step(two, "c")
    assert seen[2:] == [["part-00003-of-00500.csv"[-22:], "part-00004-of-00500.csv"[-22:]]]
    assert jobs_of(spark, out, "task_usage", three) == [(4, 4), (9, 3)]
    assert jobs_of(spark, out, "task_usage", one) == [(1, 3), (2, 3)]  # an earlier ledger still reads what it named
    assert {r["file_name"]: (r["run"], r["n_rows"]) for r in three.collect()} == {
        "part-00003-of-00500.csv": ("c", 1), "part-00004-of-00500.csv": ("c", 1), "part-00200-of-00500.csv": ("a", 1)}
    os.remove(f"{raw}/task_usage/part-00004-of-00500.csv")
    put(raw, 200, [])
    four = step(three, "d")
    assert jobs_of(spark, out, "task_usage", four) == [(9, 3)] and jobs_of(spark, out, "task_usage_snapshots", four) is None


def test_names_route_shards(spark, tmp_path):
    raw = str(tmp_path)
    for shard in (0, 172, 173):
        put(raw, shard, [usage(1, 1)])
    with open(f"{raw}/task_usage/part-odd.csv", "w") as f:
        f.write("1\n")
    rows = {r["file_name"]: (r["table_name"], r["shard"]) for r in ledger.listed_files(spark, raw, "task_usage").collect()}
    assert rows == {
        "part-00000-of-00500.csv": ("task_usage", 0), "part-00172-of-00500.csv": ("task_usage", 172),
        "part-00173-of-00500.csv": ("task_usage_snapshots", 173), "part-odd.csv": ("task_usage", -1)}


def test_malformed_values_raise(spark, tmp_path):
    put(str(tmp_path / "raw"), 0, [{**usage(1, 1), "cpu_rate": "x"}])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        ledger.ingest_increment(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "task_usage", ledger.empty_ledger(spark), "a").collect()
