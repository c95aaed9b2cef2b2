"""Table profiles, feature manifests and the keyed upsert of result registries."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null, null_pct) from a single aggregate over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(df.columns)],
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"null_{i}").alias("n_null"))
        for i, c in enumerate(df.columns)
    ])
    return counts.select("n_rows", F.inline(cells)).select(
        "column_name", "n_rows", "n_null",
        F.when(F.col("n_rows") > 0, 100.0 * F.col("n_null") / F.col("n_rows")).otherwise(0.0).alias("null_pct"),
    )


def file_profile(df: DataFrame) -> DataFrame:
    """(n_files, size_mb) of the files behind a scan. Distinct by path before summing."""
    files = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    ).distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"), (F.sum("size") / 1e6).alias("size_mb"))


def feature_manifest(df: DataFrame, entity: Sequence[str], label: str) -> DataFrame:
    """Rows, entities, positives, positive rate and time range of a feature table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.struct(*entity)).alias("n_entities"),
        F.sum(F.col(label).cast("long")).alias("n_positive"),
        F.min("window_end").alias("window_end_min"),
        F.max("window_end").alias("window_end_max"),
    ).withColumn(
        "positive_rate",
        F.when(F.col("n_rows") > 0, F.col("n_positive") / F.col("n_rows")).otherwise(0.0),
    )


def upsert(current: DataFrame, incoming: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Rows of both, a key in ``incoming`` replacing the same key in ``current``.

    One aggregation with map-side combine. Within one side the greatest row wins,
    so repeated keys still give one fixed answer.
    """
    keys = list(keys)
    columns = current.columns
    values = [c for c in columns if c not in keys]
    both = current.select("*", F.lit(0).alias("__gen")).unionByName(
        incoming.select(*columns, F.lit(1).alias("__gen"))
    )
    last = both.groupBy(*keys).agg(F.max(F.struct("__gen", *values)).alias("__row"))
    return last.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values]).select(*columns)
