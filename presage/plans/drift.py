"""Does a fixed operating point hold over the test period?"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.config import TASK_LABEL
from presage.functions import days
from presage.operators.metrics import evaluate

# The words of the verdict and the change below which it holds.
HOLDS, DEGRADES, IMPROVES = "holds up over time", "degrades over time", "improves over time"
TOLERANCE = 0.02


def with_time_bin(df: DataFrame, n_bins: int = 3, time: str = "window_end") -> DataFrame:
    """Add ``bin`` (1..n): equal-width, half-open pieces of the time span, the last closed.
    A row without time has no bin."""
    span = df.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi"))).scalar()
    width = (F.col("__span.hi") - F.col("__span.lo")) / F.lit(float(n_bins))
    place = F.when(width > 0, F.floor((F.col(time) - F.col("__span.lo")) / width)).otherwise(0)
    return df.withColumn("__span", span).withColumn(
        "bin", F.when(F.col(time).isNotNull(), F.least(place, F.lit(n_bins - 1)) + 1).cast("int")
    ).drop("__span")


def drift_by_bin(scored: DataFrame, threshold: Column | float, n_bins: int = 3, score: str = "score",
                 label: str = TASK_LABEL, strict: bool = False) -> DataFrame:
    """All metrics per time bin at a threshold that is not re-tuned. Rows without time are a group of their own,
    whose bin is NULL."""
    binned = with_time_bin(scored, n_bins)
    spans = binned.groupBy("bin").agg(
        days(F.min("window_end")).alias("first_day"), days(F.max("window_end")).alias("last_day")
    ).withColumnRenamed("bin", "__bin")
    rows = evaluate(binned, label, score, threshold, by=["bin"], strict=strict)
    return rows.join(spans, F.col("bin").eqNullSafe(F.col("__bin"))).drop("__bin")


def drift_verdict(bins: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Last bin minus first bin, and what that says (NULL if either lacks a class)."""
    moved = bins.agg(
        (F.max_by("roc_auc", "bin") - F.min_by("roc_auc", "bin")).alias("roc_auc_drift"),
        (F.max_by("pr_auc", "bin") - F.min_by("pr_auc", "bin")).alias("pr_auc_drift"),
    )
    d = F.col("roc_auc_drift")
    return moved.withColumn(
        "verdict",
        F.when(d.isNull(), F.lit(None))
        .when(F.abs(d) < tolerance, HOLDS)
        .when(d < 0, DEGRADES)
        .otherwise(IMPROVES),
    )
