"""Trained model plus its description, saved side by side."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

DOCUMENT_SCHEMA = "document string"


@dataclass(frozen=True)
class ModelBundle:
    """``model`` maps raw columns to an array column ``probs``; the rest describes it."""

    model: PipelineModel
    model_name: str
    dataset_name: str
    feature_types: dict[str, str]
    target_definition: str
    threshold: float | None = None
    class_names: dict[str, str] = field(default_factory=dict)
    num_classes: int = 2
    metrics: dict = field(default_factory=dict)
    report: dict = field(default_factory=dict)
    saved_at: str | None = None

    @property
    def feature_names(self) -> list[str]:
        return list(self.feature_types)


def save_model_bundle(spark: SparkSession, bundle: ModelBundle, path: str) -> ModelBundle:
    stamped = replace(bundle, saved_at=datetime.now(timezone.utc).isoformat())
    stamped.model.write().overwrite().save(f"{path}/model")
    facts = asdict(replace(stamped, model=None))
    facts.pop("model")
    document = spark.createDataFrame([(json.dumps(facts),)], DOCUMENT_SCHEMA).coalesce(1)
    document.write.mode("overwrite").text(f"{path}/facts")
    return stamped


def load_model_bundle(spark: SparkSession, path: str) -> ModelBundle:
    try:
        facts = spark.read.text(f"{path}/facts").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"No model at {path}. Train one first.") from error
    if facts is None:
        raise FileNotFoundError(f"No model at {path}. Train one first.")
    return ModelBundle(model=PipelineModel.load(f"{path}/model"), **json.loads(facts[0]))
