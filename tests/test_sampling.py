import hashlib

import pytest
from pyspark.sql import functions as F

from presage.operators.sampling import (
    hash_chunk, random_holdout, rank_by_hash, sample_exact, shuffled, stratified_folds, stratified_holdout,
)
from presage.operators.split import balanced_weights, fill_medians, fit_medians, undersample
from presage.operators.sequences import entity_subset, lookback


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select("id", (F.col("id") % 20 == 0).cast("int").alias("y")).cache()


@pytest.mark.parametrize("n", [0, 1, 999, 3000, 5000])
def test_sample_is_the_hash_prefix(rows, n):
    got = sorted(r["id"] for r in sample_exact(rows.repartition(5), n, ["id"], 42).collect())
    assert got == sorted(sorted(range(3000), key=lambda i: (md5(42, i), i))[:n])


def test_ranks_within_strata(rows):
    got = {r["id"]: (r["rank"], r["size"]) for r in rank_by_hash(rows, ["id"], 7, ["y"], size="size").collect()}
    for y, ids in ((1, range(0, 3000, 20)), (0, [i for i in range(3000) if i % 20])):
        order = sorted(ids, key=lambda i: md5(7, i))
        assert [got[i] for i in order] == [(k + 1, len(order)) for k in range(len(order))]


def test_null_is_a_stratum(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("y"))
    assert stratified_folds(df, "y", ["id"], 3, 1).groupBy("y", "fold").count().where("count <> IF(y IS NULL, 10, 5)").count() == 0
    assert stratified_holdout(df, "y", ["id"], 0.1, 1).where("is_validation").groupBy("y").count().where("y IS NULL").first()["count"] == 3


@pytest.mark.parametrize("size", [1, 8192])
def test_bucket_size_changes_nothing(rows, size, monkeypatch):
    from presage.operators import sampling

    monkeypatch.setattr(sampling, "BUCKET_ROWS", size)
    got = sorted(r["id"] for r in sample_exact(rows, 999, ["id"], 42).collect())
    assert got == sorted(sorted(range(3000), key=lambda i: (md5(42, i), i))[:999])


def test_folds_and_holdout_are_even(rows):
    folds = stratified_folds(rows, "y", ["id"], 3, 1).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {50} and {r["count"] for r in folds if r["y"] == 0} == {950}
    held = stratified_holdout(rows, "y", ["id"], 0.1, 1).where("is_validation").groupBy("y").count().collect()
    assert dict(map(tuple, held)) == {0: 285, 1: 15}
    assert 200 < random_holdout(rows, ["id"], 0.1, 1).where("is_validation").count() < 400


def test_shuffle_is_a_permutation(rows):
    got = [r["id"] for r in shuffled(rows, ["id"], 3).collect()]
    assert got != sorted(got) and sorted(got) == list(range(3000))


def test_chunks_cover_everything_once(rows):
    sizes = [r["count"] for r in rows.withColumn("chunk", hash_chunk(["id"], 4)).groupBy("chunk").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 3000 and min(sizes) > 500


def test_undersample(rows):
    kept = undersample(rows, "y", ["id"], 2.5, 42).groupBy("y").count().collect()
    assert dict(map(tuple, kept)) == {1: 150, 0: 375}
    everything = undersample(rows, "y", ["id"], 1000.0, 42)
    assert everything.count() == 3000


def test_weights_and_medians(spark, rows):
    got = dict(map(tuple, balanced_weights(rows, "y").groupBy("y").agg(F.max("weight")).collect()))
    assert got == pytest.approx({0: 3000 / (2 * 2850), 1: 3000 / (2 * 150)})
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    medians = fit_medians(df, ["a", "b"])
    assert medians == {"a": 2.0}
    assert sorted(r["a"] for r in fill_medians(df, medians, ["a", "b"]).collect()) == [1.0, 2.0, 3.0]


def test_lookback(spark):
    starts = {1: [0, 10, 20, 50], 2: [30]}
    df = spark.createDataFrame(
        [(j, 0, t, float(t + 1), None if t == 10 else 2.0) for j, ts in starts.items() for t in ts],
        "job_id long, task_index long, window_start long, a double, b double",
    )
    plain = {(r["job_id"], r["window_start"]): r for r in lookback(df, ["a", "b"], 3).collect()}
    assert plain[1, 50]["sequence"] == [[11.0, 0.0], [21.0, 2.0], [51.0, 2.0]] and plain[1, 50]["n_seen"] == 3
    assert plain[2, 30]["sequence"] == [[0.0, 0.0], [0.0, 0.0], [31.0, 2.0]] and plain[2, 30]["n_seen"] == 1
    gaps = {(r["job_id"], r["window_start"]): r for r in lookback(df, ["a", "b"], 3, gap_us=10).collect()}
    assert gaps[1, 50]["sequence"] == [[0.0, 0.0], [0.0, 0.0], [51.0, 2.0]] and gaps[1, 50]["n_seen"] == 1
    assert gaps[1, 20]["sequence"] == [[1.0, 2.0], [11.0, 0.0], [21.0, 2.0]]


@pytest.mark.parametrize("slice_us", [1, 7, 100, 10**9])
@pytest.mark.parametrize("gap", [None, 5])
def test_slices_change_no_sequence(spark, slice_us, gap):
    import random

    rng, rows = random.Random(slice_us), []
    for job in (1, 2, None):
        rows += [(job, 0, t, float(t)) for t in sorted(rng.sample(range(-100, 500, 5), 60))]
    df = spark.createDataFrame(rows, "job_id long, task_index long, window_start long, a double")
    got = {(r["job_id"], r["window_start"]): ([x[0] for x in r["sequence"]], r["n_seen"]) for r in lookback(df, ["a"], 4, gap_us=gap, slice_us=slice_us).collect()}
    for job in (1, 2, None):
        times = [t for j, _, t, _ in rows if j == job]
        for i, t in enumerate(times):
            if gap is None:
                seen = times[max(0, i - 3) : i + 1]
                want = [0.0] * (4 - len(seen)) + [float(x) for x in seen]
            else:
                seen = [x for x in range(t - 15, t + 1, 5) if x in times]
                want = [float(x) if x in times else 0.0 for x in range(t - 15, t + 1, 5)]
            assert got[job, t] == (want, len(seen))


def test_one_long_series_goes_to_many_tasks(spark):
    from presage.operators import sequences

    df = spark.range(1_000_000).select(F.lit(1).cast("long").alias("job_id"), F.lit(0).cast("long").alias("task_index"),
                                       (F.col("id") * 1_800_000_000).alias("window_start"), F.col("id").cast("double").alias("a"))
    out = lookback(df, ["a"], 6)
    assert out.agg(F.sum(F.get(F.get("sequence", 0), 0))).first()[0] == sum(range(999_995))
    plan = out._jdf.queryExecution().executedPlan().toString()
    over_rows = [line for line in plan.splitlines() if "Window [" in line and "__tail" not in line]
    assert over_rows and all("windowspecdefinition(__at" in line for line in over_rows)  # entity and slice
    assert df.select(F.floor(F.col("window_start") / sequences.SLICE_US)).distinct().count() > 600


def test_entity_subset(spark):
    df = spark.createDataFrame(
        [(j, 0, w, int(j < 3 and w == 0)) for j in range(50) for w in range(4)],
        "job_id long, task_index long, window_start long, label_fail_soon int",
    )
    kept = entity_subset(df, 4).groupBy("job_id").count().collect()
    assert len(kept) == 3 + 12 and {0, 1, 2} <= {r["job_id"] for r in kept} and {r["count"] for r in kept} == {4}
