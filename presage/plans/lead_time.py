"""How long before a failure the first alert fires."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.config import ENTITY, TASK_LABEL
from presage.functions import minutes_between
from presage.operators.ordered import column_quantiles


def first_alerts(scored: DataFrame, threshold: Column | float, score: str = "score",
                 label: str = TASK_LABEL, keys: Sequence[str] = ENTITY) -> DataFrame:
    """One row per entity with an observed positive window: its first alert strictly
    before the failure (NULL if none) and the minutes between.

    The universe, the alert and the failure time come from one aggregation
    instead of a distinct, a semi-join and a second grouping.
    """
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    rows = scored.withColumn("__threshold", threshold)
    alert = (F.col(score) >= F.col("__threshold")) & (F.col("window_end") < F.col("fail_time"))
    return (
        rows.groupBy(*keys)
        .agg(
            F.max(label).alias("__any"),
            F.min(F.when(alert, F.col("window_end"))).alias("first_alert_time"),
            F.min("fail_time").alias("fail_time"),
        )
        .where(F.col("__any") == 1)
        .drop("__any")
        .withColumn("lead_time_min", minutes_between("fail_time", "first_alert_time"))
    )


def lead_time_summary(alerts: DataFrame) -> DataFrame:
    """Detection rate and the distribution of lead times, in one row."""
    value = "lead_time_min"
    counts = alerts.agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.count(value).alias("n_detected"),
        F.avg(value).alias("mean_min"),
        F.min(value).alias("min_min"),
        F.max(value).alias("max_min"),
    ).withColumn(
        "detection_rate",
        F.when(F.col("n_failures") > 0, F.col("n_detected") / F.col("n_failures")).otherwise(0.0),
    )
    quantiles = column_quantiles(alerts, [value], {"p25_min": 0.25, "median_min": 0.5, "p75_min": 0.75})
    packed = quantiles.select(F.struct("p25_min", "median_min", "p75_min").alias("q")).scalar()
    return counts.withColumn("__q", packed).select(
        *counts.columns, *[F.col(f"__q.{c}").alias(c) for c in ("p25_min", "median_min", "p75_min")]
    )
