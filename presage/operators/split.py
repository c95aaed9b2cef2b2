"""Time split, imputation and class balance."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.config import SplitConfig
from presage.operators.ordered import column_quantiles, exact_quantiles
from presage.operators.sampling import sample_exact


def fit_cutoff(windows: DataFrame, test_frac: float = 0.2, time: str = "window_end") -> int | None:
    """The window end at rank ``round((n - 1) * (1 - test_frac))``, as a plain number, so
    that later filters on it reach the file scan. Windows end at few moments: counts of
    these are ranked, and no window is."""
    row = exact_quantiles(windows, time, {"cutoff": 1 - test_frac}, method="nearest").first()
    return int(row["cutoff"]) if row and row["cutoff"] is not None else None


def split_at(windows: DataFrame, cutoff: int | None, embargo_us: int = 0, time: str = "window_end"):
    """(train, test): up to the cutoff, and after it. With an embargo, train windows
    whose label would look past the cutoff are left out."""
    edge = F.lit(cutoff).cast("long")
    return windows.where(F.col(time) <= edge - F.lit(embargo_us)), windows.where(F.col(time) > edge)


def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column (one number each reaches the driver)."""
    return {r["feature"]: r["median"] for r in column_quantiles(train, columns, {"median": 0.5}).collect()}


def fill_medians(df: DataFrame, medians: Mapping[str, float], columns: Sequence[str]) -> DataFrame:
    """Replace NULLs by the fitted medians; a column without one stays as it is."""
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")) for c in columns
    })


def undersample(train: DataFrame, label: str, keys: Sequence[str], ratio: float, seed: int) -> DataFrame:
    """All positives and ``min(n_neg, int(n_pos * ratio))`` negatives in hash order."""
    positives = train.where(F.col(label) == 1)
    negatives = train.where(F.col(label) == 0)
    keep = train.agg(
        F.floor(F.count_if(F.col(label) == 1) * F.lit(float(ratio))).cast("long")
    ).scalar()
    return positives.unionByName(sample_exact(negatives, keep, keys, seed))


def balanced_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Add the class weight n / (2 * n_class)."""
    counts = df.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")
    )).scalar()
    sized = df.withColumn("__counts", counts)
    n, pos = F.col("__counts.n"), F.col("__counts.pos")
    own = F.when(F.col(label) == 1, pos).otherwise(n - pos)
    return sized.withColumn(weight, n / (2.0 * own)).drop("__counts")


@dataclass(frozen=True)
class TimeSplit:
    train: DataFrame
    test: DataFrame
    cutoff: int | None
    medians: Mapping[str, float]


def time_split(windows: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
               config: SplitConfig = SplitConfig(), balance: bool = True) -> TimeSplit:
    """Cut by time, impute every feature with train medians, undersample train negatives.

    The test side keeps its natural imbalance. ``windows`` is read several times
    (cutoff, medians, both sides): pass a stored table.
    """
    cutoff = fit_cutoff(windows, config.test_frac)
    train, test = split_at(windows, cutoff, config.embargo_us)
    medians = fit_medians(train, features)
    train, test = (fill_medians(side, medians, features) for side in (train, test))
    if balance:
        train = undersample(train, label, keys, config.negative_ratio, config.seed)
    return TimeSplit(train, test, cutoff, medians)
