"""Quantile and distinct-count sketches kept as data, one for each day and column.

A day is read once; whatever span of days is asked for later, its sketches are merged. Quantiles
come out exact: merged sketches say where each rank must lie, and one scan of the days asked for
counts what is below and keeps what is inside.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.functions import floor_to
from presage.config import US_PER_DAY
from presage.operators.ordered import running
from presage.session import staged

#: Size of a quantile sketch, and the rank error of one that is hardly ever passed.
KLL_K, RANK_ERROR = 400, 0.02
#: log2 of the registers of a distinct sketch, and the relative error of one that is hardly ever passed.
HLL_K, DISTINCT_ERROR = 12, 0.06


def day_of(time: str):
    return (floor_to(time, US_PER_DAY) / F.lit(US_PER_DAY)).cast("long")


def _long(df: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    """(day, feature, value) without NULLs."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(day_of(time).alias("day"), F.inline(cells)).where("value IS NOT NULL")


def daily_quantile_sketches(df: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    """(day, feature, sketch): combined map-side, so a busy day is a partial sketch for each task."""
    per_day = df.groupBy(day_of(time).alias("day")).agg(*[F.expr(f"kll_sketch_agg_double(CAST(`{c}` AS DOUBLE), {KLL_K})").alias(c) for c in columns])
    return per_day.select("day", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("sketch")) for c in columns])))


def _spans(spark, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(name, a, b) for name, (a, b) in spans.items()], "span string, first_day long, last_day long")


def quantiles_by_span(df: DataFrame, sketches: DataFrame, spans: Mapping[str, tuple[int, int]], columns: Sequence[str],
                      quantiles: Mapping[str, float], time: str) -> DataFrame:
    """(span, feature, n, one column for each quantile): exact, interpolated between neighbours.

    ``spans`` are first and last day of each report. Should a rank lie outside its bracket, which the sketch all but
    rules out, the scan is done again with wider ones, in the end the whole axis.
    """
    spark = df.sparkSession
    asked = _spans(spark, spans)
    merged = staged(sketches.join(asked, F.col("day").between(F.col("first_day"), F.col("last_day"))).groupBy("span", "first_day", "last_day", "feature").agg(
        F.expr(f"kll_merge_agg_double(sketch, {KLL_K})").alias("sketch")), "merged-sketches")
    first, last = min(a for a, _ in spans.values()), max(b for _, b in spans.values())
    days = df.where((F.col(time) >= first * US_PER_DAY) & (F.col(time) < (last + 1) * US_PER_DAY))
    error = RANK_ERROR
    while True:
        ends = F.array(*[F.struct(
            F.lit(name).alias("quantile"), F.lit(q).alias("q"),
            F.when(F.lit(q - error <= 0), float("-inf")).otherwise(F.expr(f"kll_sketch_get_quantile_double(sketch, {max(q - error, 0.0)}D)")).alias("low"),
            F.when(F.lit(q + error >= 1), float("inf")).otherwise(F.expr(f"kll_sketch_get_quantile_double(sketch, {min(q + error, 1.0)}D)")).alias("high"),
        ) for name, q in quantiles.items()])
        brackets = staged(merged.where(F.expr("kll_sketch_get_n_double(sketch)") > 0).select("span", "first_day", "last_day", F.col("feature").alias("f"), F.inline(ends)), "brackets")
        met = _long(days, columns, time).join(brackets, (F.col("feature") == F.col("f")) & F.col("day").between(F.col("first_day"), F.col("last_day")))
        kind = F.when(F.col("value") < F.col("low"), -1).when(F.col("value") > F.col("high"), 1).otherwise(0)
        near = staged(met.groupBy("span", "feature", "quantile", "q", kind.alias("side"), F.when(kind == 0, F.col("value")).alias("value")).agg(
            F.count(F.lit(1)).alias("n")), "bracketed")
        sizes = near.groupBy("span", "feature", "quantile", "q").agg(
            F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(c) for s, c in ((-1, "below"), (0, "inside"))])
        place = (F.col("all") - 1) * F.col("q")
        placed = staged(sizes.withColumns({"lo": F.floor(place) - F.col("below"), "hi": F.ceil(place) - F.col("below"), "part": place - F.floor(place)}), "places")
        if error >= 1 or placed.where("lo < 0 OR hi >= inside").isEmpty():
            break
        error *= 10
    keys = ["span", "feature", "quantile"]
    ranked = running(near.where("side = 0").select(*keys, "value", "n"), "value", {"n": ("sum", F.col("n"))}, keys).join(
        placed.select(*keys, "all", "lo", "hi", "part"), keys)
    at = lambda rank: F.max(F.when((F.col("n_run") - F.col("n") <= F.col(rank)) & (F.col(rank) < F.col("n_run")), F.col("value")))
    found = ranked.groupBy(*keys, "all", "part").agg(at("lo").alias("a"), at("hi").alias("b")).withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return found.groupBy("span", "feature").agg(
        F.max("all").alias("n"), *[F.max(F.when(F.col("quantile") == name, F.col("x"))).alias(name) for name in quantiles])


def daily_distinct_sketches(df: DataFrame, kinds: Mapping[str, Sequence[str]], time: str) -> DataFrame:
    """(day, what, sketch) of how many different keys there are; NULL is a key like any other, of several columns too."""
    per_day = df.groupBy(day_of(time).alias("day")).agg(*[
        F.hll_sketch_agg(F.xxhash64(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), HLL_K).alias(what) for what, keys in kinds.items()])
    return per_day.select("day", F.inline(F.array(*[F.struct(F.lit(what).alias("what"), F.col(what).alias("sketch")) for what in kinds])))


def distinct_by_span(sketches: DataFrame, spans: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(span, what, n_about) by merging days; the rows themselves are not read."""
    asked = _spans(sketches.sparkSession, spans)
    return sketches.join(asked, F.col("day").between(F.col("first_day"), F.col("last_day"))).groupBy("span", "what").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_about"))
