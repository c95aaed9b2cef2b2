"""Lookback sequences over an entity's windows."""

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presage.config import ENTITY, TASK_FEATURES, TASK_LABEL, US_PER_DAY
from presage.operators.sampling import sample_exact

SEQUENCE_LENGTH = 6
#: Time that a slice of a series covers.
SLICE_US = 30 * US_PER_DAY


def lookback(windows: DataFrame, features: Sequence[str] = TASK_FEATURES, length: int = SEQUENCE_LENGTH,
             keys: Sequence[str] = ENTITY, gap_us: int | None = None, slice_us: int = SLICE_US) -> DataFrame:
    """Add ``sequence``: the last ``length`` windows (oldest first) as rows of features.

    Lags count rows, as windows without samples do not exist; missing history
    is a row of zeros, and a NULL feature is 0. With ``gap_us`` (the window
    width) a slot is filled only by the window exactly that many widths back.
    ``n_seen`` says how many slots hold real windows.

    An entity's series is cut into slices of time, which are ordered in tasks of
    their own. What a slice needs of earlier ones are their last ``length - 1``
    windows: each slice hands its own on, and the last ``length - 1`` slices
    before one, every one with a window at least, hold them all.
    """
    keys = list(keys)
    back = length - 1
    zeros = F.array(*[F.lit(0.0) for _ in features])
    cell = F.struct(F.col("window_start").alias("at"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    # keys and slice are one struct, in which NULLs are equal: windows and join use one exchange of the rows
    at = F.struct(*keys, F.floor(F.col("window_start") / F.lit(slice_us)).cast("long").alias("__slice"))
    sliced = windows.withColumn("__at", at)
    in_slice = Window.partitionBy("__at")
    last = sliced.select("__at", cell.alias("__cell"), F.row_number().over(in_slice.orderBy(F.desc("window_start"))).alias("__rn"))
    tails = last.where(F.col("__rn") <= back).groupBy("__at").agg(F.array_sort(F.collect_list("__cell")).alias("__tail"))
    before = Window.partitionBy(*[f"__at.{k}" for k in keys]).orderBy("__at.__slice").rowsBetween(-max(back, 1), -1)
    halos = tails.select(F.col("__at").alias("__of"), F.flatten(F.collect_list("__tail").over(before)).alias("__all")).select(
        "__of", F.when(F.size("__all") > back, F.slice("__all", F.size("__all") - back + 1, max(back, 1))).otherwise(F.col("__all")).alias("__halo"))
    own = sliced.withColumn("__own", F.collect_list(cell).over(in_slice.orderBy("window_start").rowsBetween(-back, 0)))
    met = own.join(halos, F.col("__at") == F.col("__of"), "left") if back else own.withColumn("__halo", F.lit(None))
    joined = F.concat(F.coalesce("__halo", F.array().cast("array<struct<at:bigint,x:array<double>>>")), F.col("__own"))
    recent = met.withColumn("__seen", joined).withColumn(
        "__seen", F.when(F.size("__seen") > length, F.slice("__seen", F.size("__seen") - length + 1, length)).otherwise(F.col("__seen")))
    if gap_us is None:
        padded = F.concat(F.array_repeat(zeros, F.lit(length) - F.size("__seen")), F.transform("__seen", lambda c: c["x"]))
    else:
        recent = recent.withColumn("__seen", F.map_from_entries(F.filter("__seen", lambda c: c["at"] >= F.col("window_start") - F.lit(back * gap_us))))
        padded = F.array(*[
            F.coalesce(F.try_element_at("__seen", F.col("window_start") - F.lit(step * gap_us)), zeros)
            for step in reversed(range(length))
        ])
    return recent.withColumn("sequence", padded).withColumn("n_seen", F.size("__seen")).select(*windows.columns, "sequence", "n_seen")


def flat_vector(df: DataFrame, column: str = "sequence", output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.flatten(column)))


def entity_subset(windows: DataFrame, negatives_per_positive: int = 10, seed: int = 42,
                  keys: Sequence[str] = ENTITY, label: str = TASK_LABEL) -> DataFrame:
    """Windows of every entity with a positive one, and of ``k`` times as many others.

    Both entity sets come from one aggregate (any positive window per entity).
    """
    keys = list(keys)
    entities = windows.groupBy(*keys).agg(F.max(label).alias("__any"))
    keep = entities.agg((F.count_if(F.col("__any") == 1) * negatives_per_positive).cast("long")).scalar()
    others = sample_exact(entities.where(F.col("__any") == 0), keep, keys, seed)
    chosen = entities.where(F.col("__any") == 1).unionByName(others).select(*keys)
    return windows.join(chosen, keys, "left_semi")
