"""Exact binary-classification metrics and threshold choice."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presage.functions import float_grid
from presage.operators.ordered import running

# The threshold grids (start, step, points).
PROBABILITY_GRID = (0.05, 0.05, 19)
ZSCORE_GRID = (1.0, 0.25, 29)


def _known(score: Column) -> Column:
    """The score, or an error: a row without a score is a fault upstream and not a negative."""
    return F.coalesce(score, F.raise_error(F.lit("a row has no score")).cast("double"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def with_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 from tp, fp, fn; 0 where a denominator is empty."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    })


def confusion(df: DataFrame, label: str, flagged: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, n_test and n_positive in one pass, with precision, recall and F1. A NULL flag raises."""
    positive = F.col(label) == 1
    flagged = F.coalesce(flagged, F.raise_error(F.lit("a row has no score")).cast("boolean"))
    return with_prf(df.groupBy(*by).agg(
        F.count_if(positive & flagged).alias("tp"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(positive).alias("n_positive"),
    ))


def evaluate(df: DataFrame, label: str, score: str, threshold: Column | float,
             by: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every metric of a scored frame, per group if ``by`` is given.

    ROC-AUC counts ties half; PR-AUC is average precision (the step sum, not a
    trapezoid). Both are NULL when a class is missing. Rows are reduced to one
    per distinct score, ranked without a global sort, and everything else is an
    aggregate over that. A NULL score raises.
    """
    by = list(by)
    df = df.withColumn(score, _known(F.col(score)))
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    ranked = running(
        df, score,
        {"pos": ("sum", (F.col(label) == 1).cast("long")), "n": ("sum", F.lit(1))},
        keys=by, descending=True,
    ).withColumn("__threshold", threshold)
    flagged = F.col(score) > F.col("__threshold") if strict else F.col(score) >= F.col("__threshold")
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    neg_total = F.col("n_total") - F.col("pos_total")
    neg_below = neg_total - (F.col("n_run") - F.col("pos_run"))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    parts = ranked.groupBy(*by).agg(
        total(F.when(flagged, pos)).alias("tp"),
        total(F.when(flagged, neg)).alias("fp"),
        total(F.when(~flagged, pos)).alias("fn"),
        total(F.when(~flagged, neg)).alias("tn"),
        total(F.col("n")).alias("n_test"),
        total(pos).alias("n_positive"),
        F.sum(pos * (neg_below + neg / 2)).alias("__pairs"),
        F.sum(pos * F.col("pos_run") / F.col("n_run")).alias("__steps"),
    )
    p, n = F.col("n_positive"), F.col("n_test") - F.col("n_positive")
    both = (p > 0) & (n > 0)
    return with_prf(parts).withColumns({
        "roc_auc": F.when(both, F.col("__pairs") / (p.cast("double") * n)),
        "pr_auc": F.when(both, F.col("__steps") / p),
    }).drop("__pairs", "__steps")


def threshold_sweep(df: DataFrame, label: str, score: str, grid: tuple[float, float, int] = PROBABILITY_GRID,
                    strict: bool = False) -> DataFrame:
    """Confusion counts and F1 at every grid threshold, in one pass over the scores.

    Each row is reduced to how many thresholds it passes; suffix sums over that
    table (at most grid size + 1 rows) give the counts of every threshold. A NULL
    score raises.
    """
    points = float_grid(*grid)
    s = _known(F.col(score))
    passed = sum(((s > t) if strict else (s >= t)).cast("int") for t in points)
    by_passed = (
        df.select(passed.alias("passed"), (F.col(label) == 1).cast("long").alias("pos"))
        .groupBy("passed")
        .agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    grid_rows = F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("passed"), F.lit(t).alias("threshold")) for i, t in enumerate(points)
    ]))
    spark = df.sparkSession
    table = spark.range(1).select(grid_rows).join(by_passed, "passed", "full")
    table = table.select("passed", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"),
                         F.coalesce("n", F.lit(0)).alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("passed").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    counts = table.select(
        "threshold",
        F.sum("pos").over(up).alias("tp"),
        F.sum(F.col("n") - F.col("pos")).over(up).alias("fp"),
        (F.sum("pos").over(every) - F.sum("pos").over(up)).alias("fn"),
    ).where(F.col("threshold").isNotNull())
    return with_prf(counts)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest F1."""
    return sweep.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)
