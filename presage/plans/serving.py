"""Tables behind the per-machine view."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presage.config import ENTITY, REMOVE, TASK_LABEL, US_PER_DAY
from presage.functions import minutes_between
from presage.operators.joins import latest_as_of
from presage.operators.sampling import sample_exact


def sample_machines(machine_events: DataFrame, seeds: Sequence[int] = (), n_removed: int = 3,
                    n_healthy: int = 3, seed: int = 42) -> DataFrame:
    """Given machines, plus some removed and some never removed ones.

    One aggregation tells the two kinds apart.
    """
    spark = machine_events.sparkSession
    status = machine_events.groupBy("machine_id").agg(
        F.bool_or(F.col("event_type") == REMOVE).alias("removed")
    )
    fixed = spark.createDataFrame([(m,) for m in seeds], "machine_id long")
    removed = status.where(F.col("removed") & ~F.col("machine_id").isin(list(seeds)))
    healthy = status.where(~F.col("removed"))
    return (
        fixed.unionByName(sample_exact(removed, n_removed, ["machine_id"], seed).select("machine_id"))
        .unionByName(sample_exact(healthy, n_healthy, ["machine_id"], seed).select("machine_id"))
        .distinct()
    )


def machine_risk_series(scored: DataFrame, risk: str = "predicted_risk") -> DataFrame:
    """Load, task count, highest risk and any positive per (machine, window)."""
    return scored.groupBy("machine_id", "window_start", "window_end").agg(
        F.sum("cpu_mean").alias("cpu_sum"),
        F.sum("mem_mean").alias("mem_sum"),
        F.count(F.lit(1)).alias("n_tasks"),
        F.max(risk).alias("max_predicted_risk"),
        F.max(TASK_LABEL).alias("any_fail_soon"),
    )


def event_markers(windows: DataFrame, machine_events: DataFrame) -> DataFrame:
    """Distinct task failures seen in the windows, and all machine removals."""
    failed = (
        windows.where(F.col("fail_time").isNotNull())
        .select("machine_id", *ENTITY, F.col("fail_time").alias("time"))
        .distinct()
        .withColumn("event", F.lit("task_fail"))
    )
    removed = machine_events.where(F.col("event_type") == REMOVE).select(
        "machine_id",
        *[F.lit(None).cast("long").alias(k) for k in ENTITY],
        "time",
        F.lit("machine_remove").alias("event"),
    )
    return failed.unionByName(removed)


def machine_summary(series: DataFrame, markers: DataFrame) -> DataFrame:
    """Windows, peak risk, failures and status of every machine with windows."""
    observed = series.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("max_predicted_risk").alias("peak_risk")
    )
    events = markers.groupBy("machine_id").agg(
        F.count_if(F.col("event") == "task_fail").alias("n_task_fail"),
        F.bool_or(F.col("event") == "machine_remove").alias("removed"),
    )
    return observed.join(events, "machine_id", "left").select(
        "machine_id", "n_windows", "peak_risk",
        F.coalesce("n_task_fail", F.lit(0)).alias("n_task_fail"),
        F.when(F.coalesce("removed", F.lit(False)), "removed").otherwise("healthy").alias("status"),
    )


_STATE = ("cpu_sum", "mem_sum", "n_tasks", "max_predicted_risk")


def state_as_of(series: DataFrame, markers: DataFrame, as_of: Column | int, threshold: float) -> DataFrame:
    """What an operator sees of each machine at one moment: latest window, alert flag,
    events so far and minutes to the first event."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    latest = latest_as_of(series.select("machine_id", "window_start", *_STATE), ["machine_id"], "window_start", as_of)
    timed = markers.withColumn("__now", as_of)
    events = timed.groupBy("machine_id").agg(
        F.count_if(F.col("time") <= F.col("__now")).alias("n_events"),
        F.min(minutes_between("time", "__now")).alias("minutes_to_first_event"),
    )
    return latest.join(events, "machine_id", "left").withColumns({
        "n_events": F.coalesce("n_events", F.lit(0)),
        "alert": F.col("max_predicted_risk") >= threshold,
    })


def replay(series: DataFrame, markers: DataFrame, threshold: float, steps: int = 200) -> DataFrame:
    """``state_as_of`` at every slider position of every machine.

    Positions are ``steps`` equal moves from a machine's first window to its
    last. A window is first visible at a position found by arithmetic, so the
    series shrinks to one row per (machine, position) before anything is
    ordered, and at most ``steps + 1`` rows of a machine meet in one window.
    """
    spans = series.groupBy("machine_id").agg(
        F.min("window_start").alias("t0"), (F.max("window_start") - F.min("window_start")).alias("span")
    )

    def first_visible(time: str) -> Column:
        """Smallest i with t0 + (span * i) div steps >= time; past ``steps`` if there is none."""
        return F.expr(
            f"CASE WHEN {time} <= t0 THEN 0L WHEN span = 0 THEN {steps + 1}L "
            f"ELSE (({time} - t0) * {steps} + span - 1) div span END"
        )

    seen = (
        series.join(spans, "machine_id")
        .groupBy("machine_id", first_visible("window_start").alias("position"))
        .agg(F.max(F.struct("window_start", *_STATE)).alias("state"))
    )
    happened = (
        markers.join(spans, "machine_id")
        .groupBy("machine_id", first_visible("time").alias("position"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_event"))
    )
    grid = spans.select("machine_id", "t0", "span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("position"))
    so_far = Window.partitionBy("machine_id").orderBy("position")
    ever = Window.partitionBy("machine_id")
    early = happened.groupBy("machine_id").agg(F.min("first_event").alias("first_event"))
    filled = (
        grid.join(seen, ["machine_id", "position"], "left")
        .join(happened.drop("first_event"), ["machine_id", "position"], "left")
        .join(early, "machine_id", "left")
        .withColumn("state", F.last("state", ignorenulls=True).over(so_far))
        .withColumn("n_events", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    )
    now = F.expr(f"t0 + (span * position) div {steps}")
    return filled.select(
        "machine_id", "position", now.alias("replay_time"),
        *[F.col(f"state.{c}").alias(c) for c in ("window_start", *_STATE)],
        (F.col("state.max_predicted_risk") >= threshold).alias("alert"),
        "n_events",
        minutes_between(F.col("first_event"), now).alias("minutes_to_first_event"),
    )


def state_intervals(series: DataFrame, markers: DataFrame, threshold: float) -> DataFrame:
    """What an operator sees of each machine, as rows (from_time, to_time) while it holds: a row for each window and
    each moment with an event, whatever grid is laid over them. ``to_time`` of the last one is NULL."""
    changes = series.select("machine_id", F.col("window_start").alias("time"), F.struct("window_start", *_STATE).alias("state"), F.lit(0).alias("n")).unionByName(
        markers.select("machine_id", "time", F.lit(1).alias("n")), allowMissingColumns=True)
    moments = changes.groupBy("machine_id", "time").agg(F.max("state").alias("state"), F.sum("n").alias("n"))
    by_time = Window.partitionBy("machine_id").orderBy("time")
    held = moments.select(
        "machine_id", F.col("time").alias("from_time"), F.lead("time").over(by_time).alias("to_time"),
        F.last("state", ignorenulls=True).over(by_time).alias("state"), F.sum("n").over(by_time).alias("n_events"),
        F.min(F.when(F.col("n") > 0, F.col("time"))).over(Window.partitionBy("machine_id")).alias("first_event"),
    ).where("state IS NOT NULL")
    return held.select(
        "machine_id", "from_time", "to_time", *[F.col(f"state.{c}").alias(c) for c in ("window_start", *_STATE)],
        (F.col("state.max_predicted_risk") >= threshold).alias("alert"), "n_events", "first_event")


def states_at(intervals: DataFrame, moments: DataFrame, slice_us: int = US_PER_DAY) -> DataFrame:
    """``moments`` (machine_id, replay_time and others) with the state that held then. Both meet by slices of time, so a
    machine with a long history is many keys. ``intervals`` must reach to the last moment of their machine."""
    down = lambda t: F.floor(t / F.lit(slice_us)).cast("long")
    ends = moments.groupBy("machine_id").agg(F.max("replay_time").alias("__end"))
    until = F.greatest(F.col("from_time"), F.coalesce(F.col("to_time") - 1, F.col("__end")))
    cut = intervals.join(ends, "machine_id").where(F.col("from_time") <= F.col("__end")).withColumn(
        "__slice", F.explode(F.sequence(down(F.col("from_time")), down(F.least(until, F.greatest("__end", "from_time"))))))
    asked = moments.withColumn("__slice", down(F.col("replay_time")))
    holds = (F.col("from_time") <= F.col("replay_time")) & (F.col("to_time").isNull() | (F.col("replay_time") < F.col("to_time")))
    met = asked.join(cut, ["machine_id", "__slice"]).where(holds)
    return met.withColumn("minutes_to_first_event", minutes_between(F.col("first_event"), F.col("replay_time"))).drop(
        "__slice", "__end", "from_time", "to_time", "first_event")


def replay_moments(series: DataFrame, steps: int = 200) -> DataFrame:
    """(machine_id, position, replay_time): equal moves from a machine's first window to its last."""
    spans = series.groupBy("machine_id").agg(F.min("window_start").alias("t0"), (F.max("window_start") - F.min("window_start")).alias("span"))
    grid = spans.select("machine_id", "t0", "span", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("position"))
    return grid.select("machine_id", "position", F.expr(f"t0 + (span * position) div {steps}").alias("replay_time"))
