"""Exploratory reports over the trace."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.config import (
    ENTITY, EVICT, FAIL, LOST, REMOVE, SUBMIT, TASK_EVENT_NAMES, US_PER_DAY,
)
from presage.functions import clip, code_name, day_bucket, hour_bucket
from presage.operators.histogram import distinct_with_null, group_counts
from presage.operators.joins import lookback_join, prefix_at
from presage.operators.ordered import column_quantiles
from presage.operators.windows import first_attributes
from presage.session import staged


def trace_overview(task_events: DataFrame, machine_events: DataFrame) -> DataFrame:
    """Span in days and the number of machines, jobs and tasks, in one row.

    Rows are reduced to one per task first; jobs are then counted over tasks.
    """
    tasks = task_events.groupBy(*ENTITY).agg(F.min("time").alias("first"), F.max("time").alias("last"))
    counted = tasks.agg(
        ((F.max("last") - F.min("first")) / F.lit(float(US_PER_DAY))).alias("span_days"),
        distinct_with_null("job_id").alias("n_jobs"),
        F.count(F.lit(1)).alias("n_tasks"),
    )
    machines = machine_events.agg(distinct_with_null("machine_id").alias("n")).scalar()
    return counted.withColumn("n_machines", machines)


def event_type_distribution(events: DataFrame, names=TASK_EVENT_NAMES) -> DataFrame:
    return group_counts(events, ["event_type"]).withColumn("event_name", code_name("event_type", names))


def usage_by_hour(usage: DataFrame) -> DataFrame:
    return usage.groupBy(hour_bucket("start_time").alias("hour_bucket")).agg(
        F.sum("cpu_rate").alias("cpu_rate_sum"),
        F.sum("canonical_memory_usage").alias("mem_sum"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def failures_per_day(task_events: DataFrame) -> DataFrame:
    """Evictions, failures and losses per trace day."""
    return (
        task_events.where(F.col("event_type").isin(EVICT, FAIL, LOST))
        .groupBy(day_bucket("time").alias("day"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def failure_lines(task_events: DataFrame) -> DataFrame:
    """One row per day with a column per failure kind."""
    names = {EVICT: "evict", FAIL: "fail", LOST: "lost"}
    daily = failures_per_day(task_events).groupBy("day").pivot("event_type", list(names)).agg(F.sum("n"))
    return daily.select("day", *[F.coalesce(F.col(str(c)), F.lit(0)).alias(n) for c, n in names.items()])


def usage_quantiles(usage: DataFrame, columns=("cpu_rate", "canonical_memory_usage")) -> DataFrame:
    """p50, p90 and p99 of each column (value at the nearest rank), NULLs left out."""
    return column_quantiles(usage, columns, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, method="nearest")


def exhaustion_pattern(usage: DataFrame, task_events: DataFrame, min_samples: int = 8,
                       near_limit: float = 0.8, growth: float = 1.3) -> DataFrame:
    """Failures whose task ran up to its memory request on the machine it failed on.

    Looks at the samples that ended by the failure, on the same task and
    machine: enough of them, the last above ``near_limit`` of the request and
    above ``growth`` times the first. All matches are returned.
    """
    keys = [*ENTITY, "machine_id"]
    failed = task_events.where(
        (F.col("event_type") == FAIL) & F.col("machine_id").isNotNull() & (F.col("memory_request") > 0)
    ).select(*keys, "time", "memory_request")
    # Raw usage is only aggregated; what meets the failures is a row per task, machine and time.
    sample = F.struct("start_time", F.col("canonical_memory_usage").alias("mem"))
    samples = usage.groupBy(*keys, F.col("end_time").alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.min(sample).alias("first"), F.max(sample).alias("last"),
    ).join(failed.select(*keys).distinct(), keys, "left_semi")
    seen = prefix_at(samples, failed, keys, "time", {
        "n": ("sum", F.col("n")), "first": ("min", F.col("first")), "last": ("max", F.col("last")),
    })
    first, last = F.col("first_run.mem"), F.col("last_run.mem")
    share_first, share_last = first / F.col("memory_request"), last / F.col("memory_request")
    return seen.where(
        (F.col("n_run") >= min_samples) & (share_last > near_limit) & (share_last > share_first * growth)
    ).select(
        *keys, F.col("time").alias("fail_time"), "memory_request",
        F.col("n_run").alias("n_samples"), first.alias("first_mem"), last.alias("last_mem"),
    )


def load_before_removal(usage: DataFrame, machine_events: DataFrame, span_us: int = 3 * US_PER_DAY,
                        min_points: int = 30) -> DataFrame:
    """Summed CPU and sample count per time point in the days before each removal.

    Removals with too few points are dropped by two running counts before any
    series is joined to them.
    """
    removed = machine_events.where(
        (F.col("event_type") == REMOVE) & F.col("machine_id").isNotNull()
    ).select("machine_id", F.col("time").alias("remove_time")).distinct()
    points = staged(usage.groupBy("machine_id", "start_time").agg(
        F.sum("cpu_rate").alias("cpu_rate_sum"), F.count(F.lit(1)).alias("n_tasks")
    ).join(removed.select("machine_id").distinct(), "machine_id", "left_semi"), "points")
    edges = removed.select(
        "machine_id", "remove_time",
        F.inline(F.array(
            F.struct(F.col("remove_time").alias("time"), F.lit(1).alias("sign")),
            F.struct((F.col("remove_time") - F.lit(span_us + 1)).alias("time"), F.lit(-1).alias("sign")),
        )),
    )
    counted = prefix_at(
        points.select("machine_id", F.col("start_time").alias("time")), edges, ["machine_id"], "time",
        {"n": ("sum", F.lit(1))},
    )
    enough = (
        counted.groupBy("machine_id", "remove_time").agg(F.sum(F.col("sign") * F.col("n_run")).alias("n_points"))
        .where(F.col("n_points") >= min_points)
    )
    return lookback_join(enough, points, "machine_id", "remove_time", "start_time", span_us).select(
        "machine_id", "remove_time", "start_time", "cpu_rate_sum", "n_tasks", "n_points"
    )


def request_vs_peak(usage: DataFrame, task_events: DataFrame) -> DataFrame:
    """Peak memory over the (first positive) request per task, clipped to [0, 3]."""
    requested = first_attributes(
        task_events.where((F.col("event_type") == SUBMIT) & (F.col("memory_request") > 0)),
        list(ENTITY), ["memory_request", "cpu_request"],
    )
    peaks = usage.groupBy(*ENTITY).agg(
        F.max("canonical_memory_usage").alias("peak_mem_used"), F.max("cpu_rate").alias("peak_cpu_used")
    )
    return requested.join(peaks, list(ENTITY)).withColumn(
        "mem_ratio", clip(F.col("peak_mem_used") / F.col("memory_request"), 0.0, 3.0)
    )
