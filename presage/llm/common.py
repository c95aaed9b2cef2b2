"""What the operators of this subpackage share.

Words are maximal runs of characters outside space and U+0009..U+000D; ``bytes.split()``
cuts UTF-8 text at exactly those, ``WORD`` is the same for Spark's regular expressions.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b" \t\n\x0b\x0c\r"

#: Rows handed to Python at once: with documents of some 100 kB a batch stays within tens of MB.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of texts, since Spark bounds their rows and not their bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def hash128(*cols) -> Column:
    """Two 64-bit hashes of the columns with different seeds: a key that doesn't collide at 10^15 rows."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(0x5EED), *cols).alias("b"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ceil_div(rows: int, size: int) -> int:
    return max(1, -(-rows // size))
