"""Parquet and JSON ends of a job."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, sort_by: str | None = None, compression: str = "zstd") -> None:
    """Write Parquet. With ``sort_by`` rows are range-partitioned and sorted inside each
    file, so row-group bounds prune a later filter on that column."""
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def read_report(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON results: one object per line, or one pretty-printed document with no schema."""
    if schema is None:
        return spark.read.option("multiLine", True).json(path)
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str, digits: int | None = None) -> None:
    """JSON results. Rounding belongs here, not in the operators."""
    if digits is not None:
        doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
        df = df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])
    df.write.mode("overwrite").json(path)
