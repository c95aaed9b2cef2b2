"""Exact, reproducible sampling and ranking by a hash of the row keys.

``rand(seed)`` depends on partitioning; a hash of the keys does not. The first hex
digits of the hash cut rows into even buckets, so exact ranks need bucket counts
plus a sort inside each bucket, never a global sort. As many digits are taken as
buckets of about BUCKET_ROWS rows need. Rows are hashed once and stored with their
hash; bucket totals are added up in a tree. ``keys`` must identify a row. NULL is a
stratum like any other.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presage.functions import hash_order
from presage.operators.ordered import before_each
from presage.session import staged

BUCKET_ROWS = 8192


def _hashed(df: DataFrame, keys: Sequence[str], seed: int, strata: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Stored rows with ``__h`` and ``__at``, strata and bucket in one struct in which NULLs are equal; and where each
    bucket starts: (__start, __before_n, n_total)."""
    hashed = staged(df.withColumn("__h", hash_order(keys, seed)), "hashed")
    digits = min(7, max(1, math.ceil(math.log(max(hashed.count() / BUCKET_ROWS, 1), 16))))
    bucket = F.conv(F.substring("__h", 1, digits), 16, 10).cast("long")
    placed = hashed.withColumn("__at", F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(strata)], bucket.alias("b")))
    counts = placed.groupBy("__at").agg(F.count(F.lit(1)).alias("n"))
    return placed, before_each(counts, len(strata), 16**digits, {"n": "sum"}).withColumn("__before_n", F.coalesce("__before_n", F.lit(0)))


def rank_by_hash(df: DataFrame, keys: Sequence[str], seed: int, strata: Sequence[str] = (),
                 rank: str = "rank", size: str | None = None) -> DataFrame:
    """Add the 1-based position of each row in hash order, within its stratum if given.

    A stratum may hold nearly all rows: ranks are taken inside (stratum, bucket).
    """
    hashed, starts = _hashed(df, keys, seed, strata)
    inside = Window.partitionBy("__at").orderBy("__h", *keys)
    ranked = hashed.join(starts, F.col("__at") == F.col("__start")).withColumn(
        rank, F.row_number().over(inside) + F.col("__before_n")
    )
    extra = [F.col("n_total").alias(size)] if size else []
    return ranked.select(*df.columns, rank, *extra)


def sample_exact(df: DataFrame, n: int | Column, keys: Sequence[str], seed: int) -> DataFrame:
    """The first ``n`` rows in hash order; all rows when there are fewer.

    Whole buckets before the cut are kept as they lie; only the bucket that holds
    the cut is shuffled and ranked.
    """
    n = F.lit(n) if isinstance(n, int) else n
    hashed, starts = _hashed(df, keys, seed)
    cut = (
        starts.withColumn("__n", n)
        .where((F.col("__before_n") < F.col("__n")))
        .agg(F.max(F.struct("__start.b", (F.col("__n") - F.col("__before_n")).alias("need"))).alias("cut"))
        .scalar()
    )
    marked = hashed.withColumn("__cut", cut)
    inside = Window.partitionBy("__at").orderBy("__h", *keys)
    last = marked.where(F.col("__at.b") == F.col("__cut.b")).withColumn("__rn", F.row_number().over(inside))
    return marked.where(F.col("__at.b") < F.col("__cut.b")).select(*df.columns).unionByName(
        last.where(F.col("__rn") <= F.col("__cut.need")).select(*df.columns))


def shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Rows in hash order, range-partitioned."""
    return df.orderBy(hash_order(keys, seed), *keys)


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], k: int, seed: int,
                     fold: str = "fold") -> DataFrame:
    """Assign each row one of ``k`` folds, spreading every label evenly."""
    ranked = rank_by_hash(df, keys, seed, [label], rank="__rank")
    return ranked.withColumn(fold, (F.col("__rank") % k).cast("int")).drop("__rank")


def stratified_holdout(df: DataFrame, label: str, keys: Sequence[str], share: float, seed: int,
                       flag: str = "is_validation") -> DataFrame:
    """Flag ``ceil(share * n)`` rows of every label for validation."""
    ranked = rank_by_hash(df, keys, seed, [label], rank="__rank", size="__size_all")
    held = F.col("__rank") <= F.ceil(F.col("__size_all") * F.lit(share))
    return ranked.withColumn(flag, held).drop("__rank", "__size_all")


def random_holdout(df: DataFrame, keys: Sequence[str], share: float, seed: int,
                   flag: str = "is_validation") -> DataFrame:
    """Flag about ``share`` of all rows by a hash threshold; no shuffle."""
    place = F.conv(F.substring(hash_order(keys, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    return df.withColumn(flag, place < F.lit(share))


def hash_chunk(keys: Sequence[str], n: int) -> Column:
    """Stable chunk number of an entity, for work that really must go in pieces."""
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
