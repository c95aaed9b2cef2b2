"""The window, alert and label jobs as Structured Streaming queries.

Every job takes a streaming frame and returns one, or starts a query with an
idempotent sink. State is keyed by entity and window and leaves with the
watermark or by a timer; aggregation combines map-side inside each micro-batch,
so a busy entity does not concentrate.
"""

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from presage.config import ENTITY
from presage.operators.merging import merged_states, window_states
from presage.operators.windows import task_aggregates
from presage.session import state_on_disk


def event_time(df: DataFrame, micros: str, output: str = "ts") -> DataFrame:
    return df.withColumn(output, F.timestamp_micros(micros))


def stream_windows(usage: DataFrame, window_us: int, min_samples: int, delay: str,
                   keys: Sequence[str] = ENTITY) -> DataFrame:
    """Usage features per (entity, window), emitted once the watermark passes the window.

    Late rows past the watermark are dropped.
    """
    width = f"{window_us} microseconds"
    windows = (
        event_time(usage, "start_time").withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", width))
        .agg(F.count(F.lit(1)).alias("n_samples"), *task_aggregates())
        .where(F.col("n_samples") >= min_samples)
    )
    values = [c for c in windows.columns if c not in (*keys, "window")]
    return windows.select(
        *keys,
        F.unix_micros("window.start").alias("window_start"),
        F.unix_micros("window.end").alias("window_end"),
        *values,
        F.window_time("window").alias("closed_at"),
    )


def run_to_table(stream: DataFrame, table_path: str, state_path: str) -> StreamingQuery:
    """Append everything available to a Parquet table. The caller waits on the query."""
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", table_path).option("checkpointLocation", state_path)
        .trigger(availableNow=True).start()
    )


def run_alerts(windows: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float,
               table_path: str, state_path: str, score: str = "score") -> StreamingQuery:
    """Score each batch of closed windows and store those at or over the threshold.

    A batch overwrites its own folder, so a replayed batch changes nothing.
    """
    def emit(batch: DataFrame, batch_id: int) -> None:
        scorer(batch).where(F.col(score) >= threshold).write.mode("overwrite").parquet(
            f"{table_path}/batch={batch_id}"
        )

    return (
        windows.writeStream.foreachBatch(emit).outputMode("append")
        .option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )


class FirstAlert(StatefulProcessor):
    """An entity's first alert, told once.

    The earliest alert so far is held until the watermark has passed it: an earlier row that comes
    late takes its place, and after that none can come any more. Then it is told, and the entity is
    remembered until it has had no alert for ``keep_ms`` (for ever without it).
    """

    def __init__(self, names: Sequence[str], keep_ms: int | None):
        self.names, self.keep_ms = list(names), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long, told boolean")

    def _wake(self, at: int, before: int | None) -> None:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = [(int(r["time"].min()), int(r["time"].max())) for r in rows]
        low, high = min(a for a, _ in spans), max(b for _, b in spans)
        first, last, told = self.seen.get() if self.seen.exists() else (None, None, False)
        if told and self.keep_ms is not None and low // 1000 > last // 1000 + self.keep_ms:  # before its timer came up
            self.handle.deleteTimer(last // 1000 + self.keep_ms)
            first, last, told = None, None, False
        if told:
            if self.keep_ms is not None and high > last:
                self._wake(high // 1000 + self.keep_ms, last // 1000 + self.keep_ms)
            self.seen.update((first, max(last, high), True))
        else:
            if first is None or low < first:
                self._wake(low // 1000 + 1, None if first is None else first // 1000 + 1)
            self.seen.update((low if first is None else min(first, low), high if last is None else max(last, high), False))
        yield pd.DataFrame({c: pd.Series([], dtype="int64") for c in (*self.names, "first_alert_time")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, told = self.seen.get()
        if told:
            self.seen.clear()
            return
        self.seen.update((first, last, True))
        if self.keep_ms is not None:
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield pd.DataFrame({**dict(zip(self.names, ([k] for k in key))), "first_alert_time": [first]})

    def close(self) -> None:
        pass


def first_alerts(alerts: DataFrame, keys: Sequence[str] = ENTITY, delay: str = "1 hour", keep: str | None = None,
                 time: str = "window_end") -> DataFrame:
    """(keys, first_alert_time): one row for each entity out of the stream, once the watermark has passed its earliest
    alert. ``keys`` are numbers or NULL, which is an entity like any other; alerts without a time are no first ones.
    With ``keep``, an entity silent for so long is forgotten, and its next alert is a first one again.

    Timers need the state store on disk, which the session is set to. The processor travels by value, as the
    workers that run it may not have this package on their path."""
    state_on_disk(alerts.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    named = [*keys, "__nulls"]  # pandas has no NULL of numbers: a bit for each key says which ones are
    nulls = sum((F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(keys)), F.lit(0)).cast("long")
    dated = alerts.where(F.col(time).isNotNull()).select(
        *[F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(k) for k in keys], nulls.alias("__nulls"), F.col(time).alias("time"))
    timed = event_time(dated, "time").withWatermark("ts", delay)
    processor = FirstAlert(named, _micros(keep) // 1000 if keep else None)
    told = timed.groupBy(*named).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=", ".join(f"{c} long" for c in (*named, "first_alert_time")),
        outputMode="append", timeMode="EventTime")
    return told.select(*[F.when(F.col("__nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(k)).alias(k) for i, k in enumerate(keys)], "first_alert_time")


def still_held(alerts: DataFrame, told: DataFrame, keys: Sequence[str] = ENTITY, time: str = "window_end") -> DataFrame:
    """First alerts of a finite input that its stream has not told, as the watermark ends before them. NULL keys
    are equal."""
    first = alerts.groupBy(*keys).agg(F.min(time).alias("first_alert_time"))
    known = told.select(F.struct(*keys).alias("__told"))
    return first.join(known, F.struct(*[F.col(k).cast("long").alias(k) for k in keys]) == F.col("__told"), "left_anti")


def run_window_states(usage: DataFrame, window_us: int, table_path: str, state_path: str,
                      keys: Sequence[str] = ENTITY) -> StreamingQuery:
    """Store each batch of samples as states of the windows it meets. Nothing is held between batches and no
    sample is too late: ``read_window_states`` adds a window's parts up. A replayed batch overwrites its own folder."""
    def store(batch: DataFrame, batch_id: int) -> None:
        window_states(batch, window_us, keys).write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    return (
        usage.writeStream.foreachBatch(store).outputMode("append")
        .option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )


def read_window_states(spark: SparkSession, table_path: str, schema: StructType, keys: Sequence[str] = ENTITY) -> DataFrame:
    """States of all windows that have been stored; ``schema`` is that of ``window_states``."""
    return merged_states(spark.read.schema(schema).parquet(table_path).select(*schema.names), keys=keys)


def stream_labels(windows: DataFrame, failures: DataFrame, window_us: int, horizon_us: int, delay: str,
                  keys: Sequence[str] = ENTITY) -> DataFrame:
    """Closed windows with the first failure in (end, end + horizon], or NULL once none can come.

    A failure is told to every window end that it can label (horizon / width of them), and those are reduced to
    their earliest failure; a window then meets one row at most. That row is ready a horizon after the end, so
    the watermark of failures runs a horizon behind it.
    """
    keys = list(keys)
    width = F.lit(window_us)
    down = lambda t: F.floor(t / width).cast("long") * width
    ends = F.sequence(-down(F.lit(horizon_us) - F.col("time")), down(F.col("time") - 1), width)
    first = (
        failures.select(*[F.col(k).alias(f"f_{k}") for k in keys], "time", F.explode(ends).alias("f_window_end"))
        .withColumn("ready", F.timestamp_micros(F.col("f_window_end") + F.lit(horizon_us)))
        .withWatermark("ready", f"{_micros(delay) + horizon_us} microseconds")
        .groupBy(*[f"f_{k}" for k in keys], "f_window_end", F.window("ready", f"{window_us} microseconds"))
        .agg(F.min("time").alias("fail_time"))
        .withColumn("f_closed_at", F.window_time("window"))
    )
    same = F.col("window_end") == F.col("f_window_end")
    for k in keys:
        same = same & (F.col(k) == F.col(f"f_{k}"))
    reach = same & (F.col("f_closed_at") > F.col("closed_at")) & (
        F.col("f_closed_at") <= F.col("closed_at") + F.expr(f"INTERVAL '{(horizon_us + 2 * window_us) / 1e6:f}' SECOND")
    )
    return windows.join(first, reach, "leftOuter").select(*windows.columns, "fail_time")


def _micros(delay: str) -> int:
    amount, unit = delay.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000


def closed_until(times: DataFrame, time: str, window_us: int, delay: str) -> int:
    """The end of the last window that the watermark has passed once a finite input is drained."""
    last = times.agg(F.max(time)).first()[0]
    return (last - _micros(delay)) // window_us * window_us if last is not None else 0
