import pytest
from pyspark.sql import functions as F

from presage.config import (
    FEATURE_GROUPS, TASK_FEATURES, TASK_LABEL, US_PER_HOUR, US_PER_MIN, WindowConfig, check_feature_groups,
)
from presage.functions import clip, code_name, floor_to, guarded_ratio
from presage.operators.labels import next_event_label
from presage.operators.split import fit_cutoff, split_at
from presage.operators.windows import first_attributes, machine_windows, task_windows, within_horizon

W = 30 * US_PER_MIN
USAGE = (
    "job_id long, task_index long, machine_id long, start_time long, cpu_rate double, canonical_memory_usage double, "
    "maximum_memory_usage double, disk_io_time double, assigned_memory_usage double"
)
EVENTS = (
    "time long, job_id long, task_index long, machine_id long, event_type int, cpu_request double, memory_request double, "
    "disk_space_request double, scheduling_class int, priority int"
)


def samples(job, n_windows=10, per_window=6, machine=1, task=0):
    return [
        (job, task, machine, w * W + s * (W // per_window), 0.10 + 0.01 * s, 0.20 + 0.01 * s, 0.25, 0.05, 0.22)
        for w in range(n_windows) for s in range(per_window)
    ]


def submit(job, cpu=0.5, mem=0.5, time=0, task=0):
    return (time, job, task, 1, 0, cpu, mem, 0.5, 1, 5)


def fail(job, time, task=0):
    return (time, job, task, 1, 3, None, None, None, None, None)


@pytest.fixture(scope="module")
def features(spark):
    usage = spark.createDataFrame(samples(1) + samples(2) + samples(3), USAGE)
    events = spark.createDataFrame(
        [submit(j) for j in (1, 2, 3)] + [fail(1, 10 * W + 15 * US_PER_MIN), fail(3, 10 * W + 5 * US_PER_HOUR)], EVENTS
    )
    return task_windows(usage, events).cache()


def test_columns(features):
    assert {*TASK_FEATURES, TASK_LABEL, "job_id", "task_index", "window_start", "window_end"} <= set(features.columns)


def test_no_nulls(features):
    cols = [*TASK_FEATURES, TASK_LABEL, "window_start", "window_end"]
    assert sum(features.agg(*[F.count_if(F.col(c).isNull()) for c in cols]).first()) == 0


def test_window_count_and_values(features):
    assert features.count() == 30
    row = features.where("job_id = 2 AND window_start = 0").first()
    assert row["n_samples"] == 6
    for name, want in {"cpu_mean": 0.125, "cpu_max": 0.15, "cpu_std": 0.0187083, "mem_mean": 0.225,
                       "mem_usage_ratio": 0.45, "cpu_usage_ratio": 0.25}.items():
        assert row[name] == pytest.approx(want, abs=1e-6)


def test_split_is_ordered(features):
    cutoff = fit_cutoff(features)
    train, test = split_at(features, cutoff)
    a, b = train.agg(F.max("window_end"), F.count("*")).first(), test.agg(F.min("window_end"), F.count("*")).first()
    assert a[1] and b[1] and a[0] <= cutoff < b[0]


def test_cutoff_ranks_counts_of_moments(spark, monkeypatch):
    from presage.operators import split

    monkeypatch.setattr(split, "column_quantiles", None)  # it sketches every row
    ends = [W, None, 3 * W, 3 * W, 2 * W, W, None, 5 * W, 4 * W, 2 * W]
    df = spark.createDataFrame([(e,) for e in ends], "window_end long")
    known = sorted(e for e in ends if e is not None)
    for frac in (0.0, 0.2, 0.5, 0.9, 1.0):
        assert fit_cutoff(df, frac) == known[int((len(known) - 1) * (1 - frac) + 0.5)]
    assert fit_cutoff(df.where("window_end IS NULL")) is None and fit_cutoff(df.limit(0)) is None


def test_only_the_last_window_of_the_failing_task_is_positive(features):
    rows = features.where(F.col(TASK_LABEL) == 1).collect()
    assert [(r["job_id"], r["window_start"]) for r in rows] == [(1, 9 * W)]


@pytest.mark.parametrize("offset,label", [(0, 0), (1, 1), (W, 1), (W + 1, 0)])
def test_label_edges(spark, offset, label):
    df = spark.createDataFrame([(10 * W + offset, 10 * W)], "t long, e long")
    assert df.select(within_horizon("t", "e", W)).first()[0] == label


def test_window_end_ignores_horizon(spark):
    usage = spark.createDataFrame(samples(1, 2), USAGE)
    events = spark.createDataFrame([submit(1), fail(1, 2 * W + 45 * US_PER_MIN)], EVENTS)
    built = task_windows(usage, events, WindowConfig(W, 2 * W, 2)).orderBy("window_start").collect()
    assert [r["window_end"] for r in built] == [W, 2 * W]
    assert [r[TASK_LABEL] for r in built] == [0, 1]


def test_single_samples(spark):
    usage = spark.createDataFrame(samples(1, 3, per_window=1), USAGE)
    events = spark.createDataFrame([submit(1)], EVENTS)
    assert task_windows(usage, events).count() == 0
    kept = task_windows(usage, events, WindowConfig(W, W, 1)).collect()
    assert len(kept) == 3 and all(r["cpu_std"] == 0.0 for r in kept)


def test_windows_without_submit_are_dropped_and_bad_requests_give_no_ratio(spark):
    usage = spark.createDataFrame(samples(1, 1) + samples(2, 1) + samples(9, 1), USAGE)
    events = spark.createDataFrame([submit(1, cpu=0.0), submit(2, mem=None)], EVENTS)
    nulls = {r["job_id"]: r for r in task_windows(usage, events).collect()}
    zeros = {r["job_id"]: r for r in task_windows(usage, events, null_ratio="zero").collect()}
    assert set(nulls) == {1, 2}
    assert nulls[1]["cpu_usage_ratio"] is None and nulls[2]["mem_usage_ratio"] is None and nulls[2]["memory_request"] is None
    assert zeros[1]["cpu_usage_ratio"] == 0.0 and zeros[2]["mem_usage_ratio"] == 0.0 and zeros[2]["memory_request"] == 0.0
    with pytest.raises(ValueError):
        task_windows(usage, events, null_ratio="maybe")


def test_first_row_with_unknown_time_and_ties(spark):
    rows = [(5, 1, 0.9), (3, 1, 0.7), (3, 1, 0.6), (None, 2, 0.4), (1, 2, 0.1)]
    df = spark.createDataFrame(rows, "time long, job_id long, a double")
    assert sorted(first_attributes(df, ["job_id"], ["a"]).collect()) == [(1, 0.6), (2, 0.4)]


def test_machine_windows(spark):
    usage = spark.createDataFrame(
        samples(1, 1) + [(None, None, 1, 5, 0.1, 0.2, 0.2, 0.1, 0.2), (1, None, 1, 6, 0.1, 0.2, 0.2, 0.1, 0.2)], USAGE
    )
    task_events = spark.createDataFrame(
        [(7, 1, 0, 1, 2, *[None] * 5), (8, 1, 0, 1, 6, *[None] * 5), (9, 1, 0, None, 3, *[None] * 5)], EVENTS
    )
    machine_events = spark.createDataFrame(
        [(0, 1, 0, 0.5, 0.0), (9, 1, 0, 9.0, 9.0), (W + 10, 1, 1, None, None), (3 * W, 1, 1, None, None)],
        "time long, machine_id long, event_type int, cpus double, memory double",
    )
    row = machine_windows(usage, task_events, machine_events).first()
    assert row["n_samples"] == 8 and row["n_tasks"] == 3 and row["churn_events"] == 1
    assert row["cpus"] == 0.5 and row["cpu_utilization"] == pytest.approx(row["cpu_sum"] / 0.5)
    assert row["mem_utilization"] == 0.0 and row["label_remove_soon"] == 1 and row["remove_time"] == W + 10


def test_next_label_sees_later_failures(spark):
    ends = [W, 2 * W, 3 * W, 6 * W]
    built = spark.createDataFrame([(1, e - W, e) for e in ends], "job_id long, window_start long, window_end long")
    times = [W, W + 1, 3 * W, 4 * W + 5, 8 * W]
    events = spark.createDataFrame([(1, t) for t in times], "job_id long, time long")
    for horizon in (W, 2 * W, W + 5, W // 2):
        got = {r["window_end"]: r["next_time"] for r in next_event_label(built, events, ["job_id"], W, horizon).collect()}
        assert got == {e: min((t for t in times if e < t <= e + horizon), default=None) for e in ends}


def test_scalars(spark):
    df = spark.createDataFrame([(-1, None, 3), (W, 9.0, 77)], "t long, x double, code int")
    rows = df.select(
        floor_to("t", W), clip("x", 0.0, 3.0), code_name("code", {3: "FAIL"}), guarded_ratio("x", "x")
    ).collect()
    assert [tuple(r) for r in rows] == [(-W, None, "FAIL", None), (W, 3.0, None, 1.0)]


def test_feature_groups_partition_the_features():
    check_feature_groups()
    with pytest.raises(ValueError):
        check_feature_groups({**FEATURE_GROUPS, "disk": ("disk_io_mean",)})
