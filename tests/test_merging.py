import numpy as np
import pytest
from pyspark.sql import functions as F

from presage.operators.merging import merged_states, state_features, window_states
from presage.operators.windows import task_aggregates, usage_windows

USAGE = (
    "job_id long, task_index long, start_time long, cpu_rate double, canonical_memory_usage double, "
    "maximum_memory_usage double, disk_io_time double, assigned_memory_usage double"
)
W = 1000


def table(df):
    floats = [c for c, t in df.dtypes if t == "double"]
    rows = df.select("job_id", "task_index", "window_start", "window_end", "n_samples", *floats).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_parts_add_up_to_the_whole(spark, parts):
    rng = np.random.default_rng(parts)
    rows = []
    for _ in range(1500):
        big = 1e6 + float(rng.normal())  # a deviation far below the mean
        rows.append((int(rng.integers(5)), 0, int(rng.integers(20_000)), big, None if rng.random() < 0.3 else float(rng.random()),
                     None if rng.random() < 0.9 else 1.0, float(rng.exponential()), None))
    usage = spark.createDataFrame(rows, USAGE)
    states = [window_states(usage.where(F.pmod(F.xxhash64("start_time", "cpu_rate"), F.lit(parts)) == k), W) for k in range(parts)]
    ours = table(state_features(merged_states(*states), W, 2))
    want = table(usage_windows(usage, ["job_id", "task_index"], W, task_aggregates(), 2))
    assert set(ours) == set(want)
    for key, values in want.items():
        for a, b in zip(ours[key], values):
            assert a == (b if b is None else pytest.approx(b, rel=1e-9, abs=1e-9))


def test_merging_twice_is_merging_once(spark):
    rows = [(1, 0, t, float(t % 7), float(t), 1.0, 2.0, 3.0) for t in range(0, 3000, 10)]
    usage = spark.createDataFrame(rows, USAGE)
    a, b, c = (window_states(usage.where(F.col("start_time") % 30 == r), W) for r in (0, 10, 20))
    once, twice = merged_states(a, b, c), merged_states(merged_states(a, b), c)
    assert table(state_features(once, W, 1)) == {k: pytest.approx(v) for k, v in table(state_features(twice, W, 1)).items()}


def test_no_samples(spark):
    none = spark.createDataFrame([], USAGE)
    assert merged_states(window_states(none, W), window_states(none, W)).count() == 0
