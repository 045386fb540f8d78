"""Credit policy, kept apart from any model."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from obligor.session import small_table


@dataclass(frozen=True)
class Band:
    name: str
    min_pd: float
    max_pd: float


@dataclass(frozen=True)
class DecisionPolicy:
    approve_max_pd: float
    manual_review_max_pd: float
    bands: tuple[Band, ...]


def _from_dict(raw: dict) -> DecisionPolicy:
    return DecisionPolicy(
        float(raw["approve_max_pd"]),
        float(raw["manual_review_max_pd"]),
        tuple(
            Band(str(b["name"]), float(b["min_pd"]), float(b["max_pd"])) for b in raw["risk_bands"]
        ),
    )


@cache
def default_policy() -> DecisionPolicy:
    text = resources.files("obligor.sources").joinpath("decision_policy.json").read_text("utf-8")
    return _from_dict(json.loads(text))


def load_policy(spark: SparkSession, path: str) -> DecisionPolicy:
    """Policy from a JSON document on any file system Spark can read."""
    return _from_dict(spark.read.json(path, multiLine=True).first().asDict(recursive=True))


BAND_SCHEMA = T.StructType(
    [
        T.StructField("band_order", T.IntegerType()),
        T.StructField("risk_band", T.StringType()),
        T.StructField("min_pd", T.DoubleType()),
        T.StructField("max_pd", T.DoubleType()),
    ]
)


def band_table(spark: SparkSession, policy: DecisionPolicy | None = None) -> DataFrame:
    """The bands as rows, for joins and reports; one row per band of the policy."""
    bands = (policy or default_policy()).bands
    rows = [(i, b.name, b.min_pd, b.max_pd) for i, b in enumerate(bands)]
    return small_table(spark, rows, BAND_SCHEMA)
