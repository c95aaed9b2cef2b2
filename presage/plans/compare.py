"""The model comparison table."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.config import MODEL_LABELS
from presage.sources.profile import upsert

METRIC_COLUMNS = ("precision", "recall", "f1", "roc_auc", "pr_auc")


def model_order(spark: SparkSession, labels: Mapping[str, str] = MODEL_LABELS) -> DataFrame:
    rows = [(i + 1, model, label) for i, (model, label) in enumerate(labels.items())]
    return spark.createDataFrame(rows, "position int, model string, label string")


def compare_models(metrics: DataFrame, labels: Mapping[str, str] = MODEL_LABELS) -> DataFrame:
    """Metrics in fixed model order; a model without results is kept and marked."""
    known = metrics.select("model", *METRIC_COLUMNS, "threshold", F.lit(True).alias("__known"))
    return model_order(metrics.sparkSession, labels).join(known, "model", "left").select(
        "position", "model", "label", *METRIC_COLUMNS, "threshold",
        F.col("__known").isNull().alias("missing"),
    )


def save_result(registry: DataFrame, result: DataFrame) -> DataFrame:
    """Registry with the new result in place of the model's old one."""
    return upsert(registry, result, ["model"])
