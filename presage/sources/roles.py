"""The driver's ``events`` table read as a cluster trace.

Users act as tasks (ten tasks per job) on twenty machines. Plain actions are
usage samples, sign-ups are submissions (and machine additions), errors are
failures, evictions, kills or losses depending on their size, and the largest
errors remove a machine.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.config import US_PER_MIN
from presage.functions import wall_micros


@dataclass(frozen=True)
class Trace:
    usage: DataFrame
    task_events: DataFrame
    machine_events: DataFrame


def _keyed(events: DataFrame) -> DataFrame:
    return events.select(
        (F.floor(F.col("user_id") / F.lit(10))).cast("long").alias("job_id"),
        (F.col("user_id") % 10).alias("task_index"),
        (F.col("user_id") % 20).alias("machine_id"),
        wall_micros("ts").alias("time"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_usage(events: DataFrame) -> DataFrame:
    return _keyed(events.where(F.col("event_type").isin("click", "view", "purchase"))).select(
        "job_id", "task_index", "machine_id",
        F.col("time").alias("start_time"),
        (F.col("time") + F.lit(5 * US_PER_MIN)).alias("end_time"),
        F.col("value").alias("cpu_rate"),
        F.col("k").alias("canonical_memory_usage"),
        (F.col("k") * 1.25).alias("maximum_memory_usage"),
        (F.col("value") * 0.1).alias("disk_io_time"),
        (F.col("k") * 1.1).alias("assigned_memory_usage"),
    )


def as_task_events(events: DataFrame) -> DataFrame:
    kind = F.col("k").cast("int") % 3
    keyed = _keyed(events.where(F.col("event_type").isin("signup", "error")))
    return keyed.select(
        "job_id", "task_index", "machine_id", "time",
        F.when(F.col("event_type") == "signup", 0)
        .when(F.col("value") >= 100, 3)
        .when(kind == 0, 2)
        .when(kind == 1, 5)
        .otherwise(6).alias("event_type"),
        F.col("value").alias("cpu_request"),
        F.col("k").alias("memory_request"),
        (F.col("value") * 0.01).alias("disk_space_request"),
        (F.col("k").cast("int") % 4).alias("scheduling_class"),
        (F.col("k").cast("int") % 12).alias("priority"),
    )


def as_machine_events(events: DataFrame) -> DataFrame:
    wanted = (F.col("event_type") == "signup") | ((F.col("event_type") == "error") & (F.col("value") >= 200))
    return _keyed(events.where(wanted)).select(
        "machine_id", "time",
        F.when(F.col("event_type") == "signup", 0)
        .when(F.col("value") >= 250, 1)
        .otherwise(2).alias("event_type"),
        F.col("value").alias("cpus"),
        F.col("k").alias("memory"),
    )


def load_trace(spark: SparkSession, sf_dir: str) -> Trace:
    events = load_events(spark, sf_dir)
    return Trace(as_usage(events), as_task_events(events), as_machine_events(events))
