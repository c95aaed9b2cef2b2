"""Joins on a time range, written as equi-joins and running aggregates."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.operators.ordered import running


def prefix_at(points: DataFrame, probes: DataFrame, keys: Sequence[str], time: str,
              aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """For each probe: aggregates over the points of its key at or before its time.

    Replaces a range join that would pair every probe with its whole past.
    Probes only mark times on the running axis; adds ``<name>_run`` columns,
    NULL (or 0 for a sum) when nothing precedes.
    """
    keys = list(keys)
    point, blank = F.col("__point"), F.lit(None)
    marked = points.withColumn("__point", F.lit(True)).unionByName(
        probes.select(*keys, time).withColumn("__point", F.lit(False)), allowMissingColumns=True
    )
    guarded = {
        name: (kind, F.when(point, col).otherwise(F.lit(0) if kind == "sum" else blank))
        for name, (kind, col) in aggs.items()
    }
    found = running(marked, time, guarded, keys).select(*keys, time, *[f"{name}_run" for name in aggs])
    return probes.join(found, [*keys, time], "left")


def lookback_join(anchors: DataFrame, series: DataFrame, key: str, anchor_time: str, series_time: str,
                  span_us: int, slices: int = 12) -> DataFrame:
    """Pairs with ``series_time`` in ``[anchor_time - span, anchor_time]`` on the same key.

    The key is joined together with a slice of time, so one busy key spreads
    over many tasks; each anchor asks for the few slices its span touches.
    """
    width = max(span_us // slices, 1)

    def slice_of(t: Column) -> Column:
        return F.floor(t / F.lit(float(width))).cast("long")

    end = F.col(anchor_time)
    asked = anchors.withColumn(
        "__slice", F.explode(F.sequence(slice_of(end - F.lit(span_us)), slice_of(end)))
    )
    sliced = series.withColumn("__slice", slice_of(F.col(series_time)))
    return asked.join(sliced, [key, "__slice"]).where(
        F.col(series_time).between(end - F.lit(span_us), end)
    ).drop("__slice")


def latest_as_of(series: DataFrame, keys: Sequence[str], time: str, as_of: Column | int) -> DataFrame:
    """Each key's last row at or before ``as_of``, by one combining aggregation."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    values = [c for c in series.columns if c not in (*keys, time)]
    last = series.where(F.col(time) <= as_of).groupBy(*keys).agg(
        F.max(F.struct(time, *values)).alias("__last")
    )
    return last.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in (time, *values)])
