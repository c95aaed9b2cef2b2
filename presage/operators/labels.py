"""Labels from the next event rather than the first one."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presage.config import FAIL
from presage.functions import floor_to


def next_event_label(windows: DataFrame, events: DataFrame, keys: Sequence[str], window_us: int,
                     horizon_us: int, label: str = "label_next", next_time: str = "next_time") -> DataFrame:
    """Add the first event time after each window's end, within the horizon, and its 0/1 flag.

    Window ends lie on the window grid, so events are first reduced to their
    earliest time per grid cell (s, s + width]; what follows joins windows and
    cells, at most one of each per entity and grid step, and pairs no raw rows.
    """
    keys = list(keys)
    cells = (
        events.groupBy(*keys, floor_to(F.col("time") - 1, window_us).alias("__cell"))
        .agg(F.min("time").alias("__event"))
    )
    timeline = windows.withColumn("__cell", F.col("window_end")).withColumn(
        "__event", F.lit(None).cast("long")
    ).withColumn("__is_window", F.lit(True)).unionByName(
        cells.withColumn("__is_window", F.lit(False)), allowMissingColumns=True
    )
    # A cell starting at or after the horizon's end holds no event inside it.
    ahead = Window.partitionBy(*keys).orderBy("__cell").rangeBetween(0, max(horizon_us - 1, 0))
    found = timeline.withColumn("__next", F.min("__event").over(ahead)).where("__is_window")
    hit = F.col("__next") <= F.col("window_end") + F.lit(horizon_us)
    return found.select(
        *windows.columns,
        F.when(hit, F.col("__next")).alias(next_time),
        F.coalesce(hit.cast("int"), F.lit(0)).alias(label),
    )


def failures(task_events: DataFrame) -> DataFrame:
    return task_events.where(F.col("event_type") == FAIL)
