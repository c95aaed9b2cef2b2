"""Headerless CSV shards in, typed Parquet out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from presage.sources.schemas import table_schema

# The trace's marker for an unknown time (2^64 - 1), its file name pattern and the last shard of
# its continuous part.
UNKNOWN_TIME = "18446744073709551615"
SHARD_GLOB = "part-*.csv"
SHARD_PATTERN = r"part-(\d+)-of-\d+\.csv$"
LAST_CONTINUOUS_SHARD = 172


def read_shards(spark: SparkSession, path: str | list[str], table: str, with_shard: bool = False,
                with_file: bool = False) -> DataFrame:
    """Read one table's shards, a folder or some files of it, with its fixed names and types.

    Every field is read as text first: ``""`` is NULL already, the unknown-time
    marker is nulled in any column, and the cast of what remains raises under
    ANSI instead of losing a malformed value.
    """
    schema = table_schema(table)
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    raw = spark.read.schema(text).option("pathGlobFilter", SHARD_GLOB).csv(path, header=False)
    typed = [
        F.nullif(F.col(f.name), F.lit(UNKNOWN_TIME)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    if with_shard:
        typed.append(shard_index().alias("shard"))
    if with_file:
        typed.append(F.col("_metadata.file_name").alias("file_name"))
    return raw.select(*typed)


def shard_index():
    """Shard number taken from the name of the file a row came from."""
    return F.nullif(F.regexp_extract(F.col("_metadata.file_name"), SHARD_PATTERN, 1), F.lit("")).cast("int")


def is_continuous(last_continuous: int = LAST_CONTINUOUS_SHARD):
    """Rows of a file without a shard number count as continuous."""
    return F.coalesce(F.col("shard") <= last_continuous, F.lit(True))


def in_shard_range(first: int, last: int):
    return F.col("shard").between(first, last)


def is_spaced(total: int, n: int):
    """``n`` evenly spaced shards out of ``total``, counted from shard 0."""
    step = max(1, total // n)
    return (F.col("shard") % step == 0) & (F.floor(F.col("shard") / F.lit(step)) < n)


def route_shards(df: DataFrame, last_continuous: int = LAST_CONTINUOUS_SHARD):
    """(continuous, snapshots): the two kinds of usage shards must not be mixed."""
    near = is_continuous(last_continuous)
    return df.where(near).drop("shard"), df.where(~near).drop("shard")


def shard_range(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.where(in_shard_range(first, last))


def spaced_shards(df: DataFrame, total: int, n: int) -> DataFrame:
    return df.where(is_spaced(total, n))


def ingest_table(spark: SparkSession, raw_dir: str, out_dir: str, table: str,
                 last_continuous: int = LAST_CONTINUOUS_SHARD, compression: str = "zstd") -> dict[str, str]:
    """Write one table as Parquet; usage is routed to two outputs. Returns name -> path."""
    source = f"{raw_dir}/{table}"
    if table != "task_usage":
        outputs = {table: read_shards(spark, source, table)}
    else:
        rows = read_shards(spark, source, table, with_shard=True)
        near, far = route_shards(rows, last_continuous)
        outputs = {"task_usage": near}
        if not rows.where(~is_continuous(last_continuous)).isEmpty():
            outputs["task_usage_snapshots"] = far
    for name, df in outputs.items():
        df.write.mode("overwrite").option("compression", compression).parquet(f"{out_dir}/{name}")
    return {name: f"{out_dir}/{name}" for name in outputs}
