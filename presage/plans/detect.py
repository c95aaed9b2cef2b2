"""The z-score anomaly detector."""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presage.config import TASK_LABEL, ZSCORE_FEATURES
from presage.functions import max_abs_zscore

ZERO_STD = 1e-6


def normal_stats(train: DataFrame, features: Sequence[str] = ZSCORE_FEATURES,
                 label: str = TASK_LABEL) -> DataFrame:
    """One row: mean and population deviation of each feature over negative rows."""
    fields = []
    for c in features:
        sigma = F.stddev_pop(c)
        fields += [
            F.avg(c).alias(f"{c}_mu"),
            F.when(sigma == 0, F.lit(ZERO_STD)).otherwise(sigma).alias(f"{c}_sigma"),
        ]
    return train.where(F.col(label) == 0).agg(*fields)


def fit_normal(train: DataFrame, features: Sequence[str] = ZSCORE_FEATURES,
               label: str = TASK_LABEL) -> dict[str, tuple[float, float]]:
    """Feature -> (mean, deviation): two numbers per feature reach the driver."""
    row = normal_stats(train, features, label).first()
    return {c: (row[f"{c}_mu"], row[f"{c}_sigma"]) for c in features}


def zscore(df: DataFrame, normal: Mapping[str, tuple[float, float]], output: str = "score") -> DataFrame:
    """Add the largest absolute z-score over the fitted features."""
    return df.withColumn(output, max_abs_zscore(normal))
