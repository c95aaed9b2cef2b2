"""The batch jobs end to end: raw shards to typed tables, samples to features, models on disk."""

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presage.config import ENTITY, TASK_LABEL, WindowConfig
from presage.operators.split import fill_medians
from presage.operators.windows import task_windows
from presage.plans.models import score
from presage.sources.profile import feature_manifest, table_profile, upsert
from presage.sources.schemas import TABLES
from presage.sources.shards import ingest_table
from presage.sources.tables import write_table

MANIFEST_KEYS = ("table_name", "column_name")


def ingest_trace(spark: SparkSession, raw_dir: str, out_dir: str, manifest: DataFrame | None = None) -> DataFrame:
    """Ingest every table of the trace and profile what was written. With a ``manifest`` of an earlier run, rows
    of this one replace the same (table, column) there."""
    profiles = None
    for table in TABLES:
        for name, path in ingest_table(spark, raw_dir, out_dir, table).items():
            one = table_profile(spark.read.parquet(path)).select(F.lit(name).alias("table_name"), "*")
            profiles = one if profiles is None else profiles.unionByName(one)
    return profiles if manifest is None else upsert(manifest, profiles, MANIFEST_KEYS)


def build_features(usage: DataFrame, task_events: DataFrame, path: str, config: WindowConfig = WindowConfig()) -> DataFrame:
    """Task windows as Parquet sorted by their end, so that a time split reads few row groups; their manifest."""
    write_table(task_windows(usage, task_events, config), path, sort_by="window_end")
    return feature_manifest(usage.sparkSession.read.parquet(path), ENTITY, TASK_LABEL)


@dataclass(frozen=True)
class StoredModel:
    model: PipelineModel
    features: tuple[str, ...]
    threshold: float
    medians: Mapping[str, float] = field(default_factory=dict)


def save_model(spark: SparkSession, stored: StoredModel, path: str) -> None:
    """A model with its features, operating threshold and medians for unknown values beside it."""
    stored.model.write().overwrite().save(f"{path}/model")
    facts = json.dumps({"features": stored.features, "threshold": stored.threshold, "medians": dict(stored.medians)})
    spark.range(1).select(F.lit(facts).alias("value")).write.mode("overwrite").text(f"{path}/facts")


def load_model(spark: SparkSession, path: str) -> StoredModel:
    facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
    return StoredModel(PipelineModel.load(f"{path}/model"), tuple(facts["features"]), facts["threshold"], facts.get("medians", {}))


def stored_scorer(stored: StoredModel) -> Callable[[DataFrame], DataFrame]:
    """Scores a batch of windows as the model was fitted: unknown values are the medians of its train side."""
    return lambda windows: score(stored.model, fill_medians(windows, stored.medians, stored.features))
