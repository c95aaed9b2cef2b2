"""Ingest that reads what is new: a ledger of files says what has been read and where it lies.

An entry holds a file's table, name, shard number, size, modification time, rows and the run
that read it. A run reads files that the ledger does not have or that have changed, writes them
under its own name, one folder for each shard, and returns the next ledger. What it replaces is
left where it lies and simply no longer named, so readers of the last ledger are not disturbed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.sources.profile import upsert
from presage.sources.shards import LAST_CONTINUOUS_SHARD, SHARD_GLOB, SHARD_PATTERN, read_shards

LEDGER = "table_name string, file_name string, shard int, size long, modified timestamp, n_rows long, run string"
KEYS = ("table_name", "file_name")


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def listed_files(spark: SparkSession, raw_dir: str, table: str, last_continuous: int = LAST_CONTINUOUS_SHARD) -> DataFrame:
    """A row for each shard of a raw table; contents are not read. Usage past the continuous shards is a table of its
    own; a file without a shard number counts as continuous and has shard -1."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", SHARD_GLOB).load(f"{raw_dir}/{table}")
    name = F.element_at(F.split("path", "/"), -1)
    shard = F.coalesce(F.nullif(F.regexp_extract(name, SHARD_PATTERN, 1), F.lit("")).cast("int"), F.lit(-1))
    goes_to = F.when((F.lit(table) == "task_usage") & (shard > last_continuous), f"{table}_snapshots").otherwise(table)
    return found.select(goes_to.alias("table_name"), name.alias("file_name"), shard.alias("shard"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"), "path")


def unread(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that the ledger does not have as they are now."""
    return listed.join(ledger.select(*KEYS, "size", "modified"), [*KEYS, "size", "modified"], "left_anti")


def ingest_increment(spark: SparkSession, raw_dir: str, out_dir: str, table: str, ledger: DataFrame, run: str,
                     last_continuous: int = LAST_CONTINUOUS_SHARD) -> DataFrame:
    """Read a raw table's new and changed files and return the next ledger of all tables. Files that are gone leave it.

    ``run`` must be new. Paths of the files to read pass the driver, as those of any scan do."""
    listed = listed_files(spark, raw_dir, table, last_continuous)
    todo = unread(listed, ledger).collect()
    entries = ledger.where(~F.col("table_name").isin(table, f"{table}_snapshots")).unionByName(
        ledger.join(listed.select(*KEYS), list(KEYS), "left_semi").where(F.col("table_name").isin(table, f"{table}_snapshots")))
    for name in sorted({r["table_name"] for r in todo}):
        of = [r for r in todo if r["table_name"] == name]
        rows = read_shards(spark, [r["path"] for r in of], table, with_shard=True, with_file=True)
        path = f"{out_dir}/{name}/run={run}"
        rows.withColumn("shard", F.coalesce("shard", F.lit(-1))).write.partitionBy("shard").option("compression", "zstd").parquet(path)
        counted = read_run(spark, path).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))
        said = spark.createDataFrame([(r["table_name"], r["file_name"], r["shard"], r["size"], r["modified"]) for r in of],
                                     "table_name string, file_name string, shard int, size long, modified timestamp")
        entries = upsert(entries, said.join(counted, "file_name", "left").select(
            "table_name", "file_name", "shard", "size", "modified", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(run).alias("run")), KEYS)
    return entries


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of one run; none if all its files were empty."""
    return spark.read.schema("file_name string, shard int").parquet(path)


def read_ingested(spark: SparkSession, out_dir: str, name: str, ledger: DataFrame) -> DataFrame | None:
    """Rows of a typed table as the ledger has it, None if it names no rows. Runs and shards are folders, so those
    that the ledger does not name are not read."""
    named = ledger.where((F.col("table_name") == name) & (F.col("n_rows") > 0)).select("run", "shard", "file_name")
    if named.isEmpty():
        return None
    rows = spark.read.parquet(f"{out_dir}/{name}").withColumn("run", F.col("run").cast("string"))
    return rows.join(named, ["run", "shard", "file_name"], "left_semi").drop("run", "file_name")
