"""Window statistics that can be added to later.

A window is stored as how many samples it has and, for each measure, their count, mean, sum
of squared deviations and maximum. Two such rows add up to that of both, so a late sample or
a new shard updates a closed window, its deviation too, without reading any earlier sample.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.config import ENTITY
from presage.functions import floor_to, or_zero

# Measure: its column in the usage table, and which features it gives.
MEASURES = {
    "cpu": ("cpu_rate", ("mean", "std", "max")),
    "mem": ("canonical_memory_usage", ("mean", "std", "max")),
    "mem_peak": ("maximum_memory_usage", ("mean",)),
    "disk_io": ("disk_io_time", ("mean",)),
    "assigned_mem": ("assigned_memory_usage", ("mean",)),
}


def window_states(usage: DataFrame, window_us: int, keys: Sequence[str] = ENTITY) -> DataFrame:
    """(keys, window_start, n_samples, a struct for each measure) of some of the samples."""
    return usage.groupBy(*keys, floor_to("start_time", window_us).alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.struct(
            F.count(c).alias("n"), F.avg(c).cast("double").alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"), F.max(c).cast("double").alias("top"),
        ).alias(m) for m, (c, _) in MEASURES.items()],
    )


def _add(parts: str) -> Column:
    """One struct for several. Means are taken from the first one's, so that little is lost when they are close."""
    some = F.filter(parts, lambda p: p["n"] > 0)
    from_first = F.transform(some, lambda p: F.struct(p["n"].alias("n"), (p["mean"] - F.get(parts, 0)["mean"]).alias("d"), p["m2"].alias("m2")))
    sums = F.aggregate(
        from_first, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"), F.lit(0.0).alias("m2")),
        lambda a, p: F.struct((a["n"] + p["n"]).alias("n"), (a["d"] + p["n"] * p["d"]).alias("d"), (a["m2"] + p["m2"] + p["n"] * p["d"] * p["d"]).alias("m2")),
        lambda a: F.struct(a["n"].alias("n"), F.try_divide(a["d"], a["n"]).alias("d"), F.greatest(a["m2"] - F.try_divide(a["d"] * a["d"], a["n"]), F.lit(0.0)).alias("m2")))
    tops = F.array_max(F.transform(some, lambda p: p["top"]))
    return F.transform(F.array(sums), lambda s: F.struct(
        s["n"].alias("n"), (F.get(parts, 0)["mean"] + s["d"]).alias("mean"), F.when(s["n"] > 0, s["m2"]).alias("m2"), tops.alias("top")))[0]


def merged_states(*states: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """One row for each (keys, window_start) of all ``states``. A window has as many rows as parts that met it."""
    everything = reduce(DataFrame.unionByName, states)
    parts = everything.groupBy(*keys, "window_start").agg(
        F.sum("n_samples").alias("n_samples"),
        # those with values first, as deviations are taken from the first
        *[F.array_sort(F.collect_list(m), lambda a, b: F.when((a["n"] > 0) & (b["n"] == 0), -1).when((a["n"] == 0) & (b["n"] > 0), 1).otherwise(0)).alias(m)
          for m in MEASURES])
    return parts.select(*keys, "window_start", "n_samples", *[_add(m).alias(m) for m in MEASURES])


def state_features(states: DataFrame, window_us: int, min_samples: int) -> DataFrame:
    """The features that ``usage_windows`` with ``task_aggregates`` gives for all samples at once."""
    def feature(m: str, kind: str) -> Column:
        if kind == "std":
            return or_zero(F.when(F.col(f"{m}.n") > 1, F.sqrt(F.col(f"{m}.m2") / (F.col(f"{m}.n") - 1))))
        return F.col(f"{m}.{'top' if kind == 'max' else 'mean'}")

    keys = [c for c in states.columns if c not in (*MEASURES, "n_samples")]
    return states.where(F.col("n_samples") >= min_samples).select(
        *keys, "n_samples", *[feature(m, kind).alias(f"{m}_{kind}") for m, (_, kinds) in MEASURES.items() for kind in kinds],
        (F.col("window_start") + F.lit(window_us)).alias("window_end"))
