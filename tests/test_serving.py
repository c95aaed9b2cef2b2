import pytest

from presage.plans import eda, serving

SERIES = (
    "machine_id long, window_start long, window_end long, cpu_sum double, mem_sum double, n_tasks long, "
    "max_predicted_risk double, any_fail_soon int"
)
MARKERS = "machine_id long, job_id long, task_index long, time long, event string"


@pytest.fixture(scope="module")
def tables(spark):
    series = [(1, t, t + 10, float(t), 1.0, 1, t / 1000, 0) for t in (0, 10, 370, 1000)] + [(2, 50, 60, 1.0, 1.0, 1, 0.9, 0)]
    markers = [(1, 5, 0, 300, "task_fail"), (1, None, None, 995, "machine_remove"), (3, None, None, 5, "machine_remove")]
    return series, markers, spark.createDataFrame(series, SERIES), spark.createDataFrame(markers, MARKERS)


def test_replay_equals_state_at_every_position(tables):
    rows, marks, series, markers = tables
    got = {(r["machine_id"], r["position"]): r for r in serving.replay(series, markers, 0.3, steps=7).collect()}
    assert len(got) == 16
    for (machine, i), r in got.items():
        own = [s for s in rows if s[0] == machine]
        t0, t1 = min(s[1] for s in own), max(s[1] for s in own)
        now = t0 + (t1 - t0) * i // 7
        latest = max(s[1] for s in own if s[1] <= now)
        events = [m[3] for m in marks if m[0] == machine]
        assert (r["replay_time"], r["window_start"], r["n_events"]) == (now, latest, sum(t <= now for t in events))
        assert r["alert"] == (next(s[6] for s in own if s[1] == latest) >= 0.3)
        assert r["minutes_to_first_event"] == (pytest.approx((min(events) - now) / 6e7) if events else None)


def test_state_and_summary(tables):
    _, _, series, markers = tables
    state = {r["machine_id"]: r for r in serving.state_as_of(series, markers, 400, 0.3).collect()}
    assert state[1]["window_start"] == 370 and state[1]["alert"] and state[1]["n_events"] == 1
    assert state[2]["n_events"] == 0 and state[2]["minutes_to_first_event"] is None
    summary = {r["machine_id"]: tuple(r)[1:] for r in serving.machine_summary(series, markers).collect()}
    assert summary == {1: (4, 1.0, 1, "removed"), 2: (1, 0.9, 0, "healthy")}


def test_machine_sample(spark):
    events = spark.createDataFrame(
        [(m, 0) for m in range(40)] + [(m, 1) for m in range(0, 40, 4)], "machine_id long, event_type int"
    )
    chosen = {r["machine_id"] for r in serving.sample_machines(events, seeds=(0, 1)).collect()}
    assert {0, 1} <= chosen and 7 <= len(chosen) <= 8
    assert len([m for m in chosen if m % 4 == 0]) == 4


def test_exhaustion_pattern_on_a_ramp(spark):
    usage = spark.createDataFrame(
        [(j, 0, 1, t * 10, t * 10 + 5, 0.1 * t if j == 1 else 0.9) for j in (1, 2) for t in range(1, 11)]
        + [(1, 0, 2, 1, 2, 9.0)],
        "job_id long, task_index long, machine_id long, start_time long, end_time long, canonical_memory_usage double",
    )
    events = spark.createDataFrame(
        [(1, 0, 1, 200, 3, 1.0), (1, 0, 1, 60, 3, 1.0), (2, 0, 1, 200, 3, 1.0), (1, 0, None, 200, 3, 1.0), (1, 0, 1, 200, 3, 0.0)],
        "job_id long, task_index long, machine_id long, time long, event_type int, memory_request double",
    )
    got = eda.exhaustion_pattern(usage, events).collect()
    assert [(r["job_id"], r["fail_time"], r["n_samples"]) for r in got] == [(1, 200, 10)]
    assert got[0]["first_mem"] == pytest.approx(0.1) and got[0]["last_mem"] == pytest.approx(1.0)


def test_load_before_removal(spark):
    usage = spark.createDataFrame(
        [(1, t, 0.5) for t in range(100) for _ in range(2)] + [(2, 95, 0.5)], "machine_id long, start_time long, cpu_rate double"
    )
    events = spark.createDataFrame(
        [(1, 90, 1), (1, 5, 1), (2, 99, 1), (1, 99, 0)], "machine_id long, time long, event_type int"
    )
    got = eda.load_before_removal(usage, events, span_us=20, min_points=10).collect()
    assert sorted(r["start_time"] for r in got) == list(range(70, 91))
    assert {(r["machine_id"], r["remove_time"], r["cpu_rate_sum"], r["n_tasks"], r["n_points"]) for r in got} == {(1, 90, 1.0, 2, 21)}
