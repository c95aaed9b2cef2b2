"""Fixed-width histograms."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bins`` equal bins between min and max, the last one closed; empty bins are kept.

    A constant column spans [v - 0.5, v + 0.5]. NULLs are left out.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("__v"))
    lo, hi = F.min("__v"), F.max("__v")
    flat = lo == hi
    span = values.agg(F.struct(
        F.when(flat, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(flat, hi + 0.5).otherwise(hi).alias("hi"),
    )).scalar()
    width = (F.col("__span.hi") - F.col("__span.lo")) / F.lit(float(bins))
    binned = (
        values.withColumn("__span", span)
        .select(F.least(
            F.floor((F.col("__v") - F.col("__span.lo")) / width).cast("int"), F.lit(bins - 1)
        ).alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    )
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("__span", span)
    return axis.join(binned, "bin", "left").select(
        "bin",
        (F.col("__span.lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("__span.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def share_over(df: DataFrame, value: str, limit: float) -> DataFrame:
    """(pct_over): percent of all rows, NULLs included, whose value exceeds ``limit``."""
    over = F.count_if(F.col(value) > limit)
    return df.agg(F.when(F.count(F.lit(1)) > 0, 100.0 * over / F.count(F.lit(1))).alias("pct_over"))


def distinct_with_null(column: str):
    """Distinct count in which NULL counts as one value."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def group_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
