"""Windowed features of tasks and machines.

Windows are tumbling, left-closed, aligned to time 0, and empty ones are not
emitted. After aggregation an entity owns one row per window, so its row count
is bounded by the trace span over the window width, however many samples it
has; the joins below run on such rows. All aggregates combine map-side.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.config import (
    ADD, ENTITY, EVICT, FAIL, KILL, MACHINE_LABEL, REMOVE, SUBMIT, TASK_LABEL, WindowConfig,
)
from presage.functions import floor_to, guarded_ratio, or_zero

SUBMIT_ATTRS = ("cpu_request", "memory_request", "disk_space_request", "scheduling_class", "priority")
CAPACITY_ATTRS = ("cpus", "memory")


def within_horizon(event_time, end, horizon_us: int) -> Column:
    """1 if the event falls in (end, end + horizon], else 0 (also for no event)."""
    t, e = F.col(event_time), F.col(end)
    return F.coalesce(((t > e) & (t <= e + F.lit(horizon_us))).cast("int"), F.lit(0))


def first_attributes(events: DataFrame, keys: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    """Attributes of each key's first event. An unknown time comes first, and ties
    are broken by the attributes themselves, so the answer never depends on row order."""
    first = events.groupBy(*keys).agg(F.min(F.struct("time", *attrs)).alias("first"))
    return first.select(*keys, *[F.col(f"first.{a}").alias(a) for a in attrs])


def task_profiles(task_events: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Submitted attributes and first failure time of each submitted task: one scan,
    one aggregation, for what would be two tables and two joins."""
    kind = F.col("event_type")
    seen = (
        task_events.where(kind.isin(SUBMIT, FAIL))
        .groupBy(*keys)
        .agg(
            F.min(F.when(kind == SUBMIT, F.struct("time", *SUBMIT_ATTRS))).alias("submit"),
            F.min(F.when(kind == FAIL, F.col("time"))).alias("fail_time"),
        )
    )
    return seen.where(F.col("submit").isNotNull()).select(
        *keys, *[F.col(f"submit.{a}").alias(a) for a in SUBMIT_ATTRS], "fail_time"
    )


def usage_windows(usage: DataFrame, keys: Sequence[str], window_us: int, aggs: Sequence[Column],
                  min_samples: int) -> DataFrame:
    """Aggregate usage per (keys, window); windows with too few samples are dropped."""
    return (
        usage.groupBy(*keys, floor_to("start_time", window_us).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("n_samples"), *aggs)
        .where(F.col("n_samples") >= min_samples)
        .withColumn("window_end", F.col("window_start") + F.lit(window_us))
    )


def _stats(column: str, prefix: str) -> list[Column]:
    """Mean, sample deviation (0 for one sample) and maximum."""
    return [
        F.avg(column).alias(f"{prefix}_mean"),
        or_zero(F.stddev_samp(column)).alias(f"{prefix}_std"),
        F.max(column).alias(f"{prefix}_max"),
    ]


def task_aggregates() -> list[Column]:
    return [
        *_stats("cpu_rate", "cpu"),
        *_stats("canonical_memory_usage", "mem"),
        F.avg("maximum_memory_usage").alias("mem_peak_mean"),
        F.avg("disk_io_time").alias("disk_io_mean"),
        F.avg("assigned_memory_usage").alias("assigned_mem_mean"),
    ]


def task_windows(usage: DataFrame, task_events: DataFrame, config: WindowConfig = WindowConfig(),
                 null_ratio: str = "null", by_machine: bool = False) -> DataFrame:
    """Labelled feature windows of submitted tasks.

    ``null_ratio="zero"`` reports 0 for missing requests and for ratios without
    a positive request (the serving variant). ``by_machine`` keeps a task's
    windows apart per machine.
    """
    if null_ratio not in ("null", "zero"):
        raise ValueError(f"null_ratio must be 'null' or 'zero', not {null_ratio!r}")
    keys = [*ENTITY, "machine_id"] if by_machine else list(ENTITY)
    windows = usage_windows(usage, keys, config.window_us, task_aggregates(), config.min_samples)
    labelled = windows.join(task_profiles(task_events), list(ENTITY)).withColumn(
        TASK_LABEL, within_horizon("fail_time", "window_end", config.horizon_us)
    )
    missing = 0.0 if null_ratio == "zero" else None
    features = labelled.withColumns({
        "mem_usage_ratio": guarded_ratio("mem_mean", "memory_request", missing),
        "cpu_usage_ratio": guarded_ratio("cpu_mean", "cpu_request", missing),
    })
    if null_ratio == "zero":
        features = features.withColumns({
            c: or_zero(c) for c in ("cpu_request", "memory_request", "disk_space_request")
        })
    return features


def machine_churn(task_events: DataFrame, window_us: int) -> DataFrame:
    """Evictions, failures and kills per (machine, window). Rows without a machine
    are filtered before the shuffle: they would form one hot group."""
    return (
        task_events.where(F.col("machine_id").isNotNull() & F.col("event_type").isin(EVICT, FAIL, KILL))
        .groupBy("machine_id", floor_to("time", window_us).alias("window_start"))
        .agg(F.count(F.lit(1)).alias("churn_events"))
    )


def machine_profiles(machine_events: DataFrame) -> DataFrame:
    """Capacity at the first ADD and time of the first REMOVE, one row per machine."""
    kind = F.col("event_type")
    seen = (
        machine_events.where(kind.isin(ADD, REMOVE))
        .groupBy("machine_id")
        .agg(
            F.min(F.when(kind == ADD, F.struct("time", *CAPACITY_ATTRS))).alias("added"),
            F.min(F.when(kind == REMOVE, F.col("time"))).alias("remove_time"),
        )
    )
    return seen.select("machine_id", *[F.col(f"added.{a}").alias(a) for a in CAPACITY_ATTRS], "remove_time")


def machine_windows(usage: DataFrame, task_events: DataFrame, machine_events: DataFrame,
                    config: WindowConfig = WindowConfig()) -> DataFrame:
    """Load, utilisation, churn and removal label per (machine, window).

    Machines number few, but no side is forced to broadcast: the planner does it
    whenever the profile table measures small enough.
    """
    aggs = [
        F.count_distinct(F.struct(*ENTITY)).alias("n_tasks"),
        F.sum("cpu_rate").alias("cpu_sum"), *_stats("cpu_rate", "cpu"),
        F.sum("canonical_memory_usage").alias("mem_sum"), *_stats("canonical_memory_usage", "mem"),
        F.avg("disk_io_time").alias("disk_io_mean"),
    ]
    windows = usage_windows(usage, ["machine_id"], config.window_us, aggs, config.min_samples)
    return (
        windows.join(machine_profiles(machine_events), "machine_id", "left")
        .join(machine_churn(task_events, config.window_us), ["machine_id", "window_start"], "left")
        .withColumns({
            "churn_events": F.coalesce("churn_events", F.lit(0)),
            "cpu_utilization": guarded_ratio("cpu_sum", "cpus", 0.0),
            "mem_utilization": guarded_ratio("mem_sum", "memory", 0.0),
            MACHINE_LABEL: within_horizon("remove_time", "window_end", config.horizon_us),
        })
    )
