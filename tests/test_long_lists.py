"""Category lists beyond what a model holds: a table of codes, joined."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from obligor.operators import encoding
from obligor.operators.profile import SchemaProfile
from obligor.plans import training

PROFILE = SchemaProfile(categorical=["kind", "city", "zip"])


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the cities are one value and a quarter is missing; the numbers are categories too."""
    n = F.col("id")
    city = F.when(n % 2 == 0, "hot").when(n % 4 == 1, F.concat(F.lit("c"), n.cast("string")))
    return spark.range(4000).select(
        "id", city.alias("city"), (n % 900).cast("double").alias("zip"), F.when(n % 3 == 0, "a").otherwise("b").alias("kind")
    )


def codes(df, state):
    return sorted(map(tuple, encoding.encode(df, state, False).select("id", "cat__kind", "cat__city", "cat__zip").collect()))


def test_joined_codes_equal_listed_ones(spark, rows):
    listed = encoding.fit_encoder(rows, PROFILE, {})
    stored = encoding.fit_encoder(rows, PROFILE, {}, max_categories=2)
    assert set(stored.hot) == {"city", "zip"} and stored.values["kind"] == ["a", "b"]
    assert "hot" in stored.hot["city"] and len(stored.hot["city"]) <= encoding.HOT_PARTS + 1
    strange = rows.withColumns(
        {"city": F.when(F.col("id") % 5 == 0, "unseen").otherwise(F.col("city")), "zip": F.when(F.col("id") % 7 != 0, F.col("zip"))}
    )
    for asked in (rows, strange, strange.where("id < 0"), strange.union(strange)):
        assert codes(asked, stored) == codes(asked, listed)


def test_only_rare_values_meet_the_table(spark, rows):
    state = encoding.fit_encoder(rows, PROFILE, {}, max_categories=902)
    assert list(state.hot) == ["city"]
    assert state.hot["city"] == {"hot": sorted({f"c{i}" for i in range(4000) if i % 4 == 1} | {"hot"}).index("hot")}
    got = {r["id"]: r["cat__city"] for r in encoding.encode(rows, state, False).collect()}
    # Missing cities are imputed by the mode, which is looked up in place.
    assert {got[i] for i in range(4000) if i % 4 != 1} == {float(state.hot["city"]["hot"])}


def test_saved_encoder_carries_its_codes(spark, rows, tmp_path):
    state = encoding.fit_encoder(rows, PROFILE, {}, max_categories=2)
    model = encoding.TableEncoderModel(state=state.to_json(), scaled=False)
    stages = [model, *encoding.vector_stages(spark, state)]
    PipelineModel(stages).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert loaded.stages[0].fitted.codes.startswith(str(tmp_path))
    pick = [F.col("id"), vector_to_array("features").alias("f")]
    small = rows.where("id < 40")
    assert sorted(PipelineModel(stages).transform(small).select(*pick).collect()) == sorted(loaded.transform(small).select(*pick).collect())


def test_a_column_without_values(spark, rows):
    empty = rows.withColumn("city", F.lit(None).cast("string"))
    state = encoding.fit_encoder(empty, PROFILE, {}, max_categories=2)
    assert {r["cat__city"] for r in encoding.encode(rows, state, False).collect()} == {0.0}


def test_codes_on_a_stream(spark, rows, tmp_path):
    state = encoding.fit_encoder(rows, PROFILE, {}, max_categories=2)
    rows.write.parquet(str(tmp_path / "in"))
    stream = encoding.encode(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), state, False)
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "cat__kind", "cat__city", "cat__zip")
    assert sorted(map(tuple, got.collect())) == codes(rows, state)


def test_training_scores_and_explains_long_lists(spark, tmp_path, monkeypatch):
    from obligor.plans.scoring import score
    from obligor.plans.training import TrainConfig, train_experiment
    from obligor.sources.bundles import load_model_bundle, save_model_bundle

    n = F.col("id")
    loans = spark.range(600).select(
        n.alias("row_id"), F.concat(F.lit("c"), (n % 140).cast("string")).alias("city"), (n * 7919 % 101).cast("double").alias("amount"),
        ((n % 140 < 60).cast("int")).alias("default"),
    )
    own = encoding._long_lists
    monkeypatch.setattr(encoding, "_long_lists", lambda state, most: own(state, 5))
    config = TrainConfig(folds=2, candidates=["logistic_regression"], space={"logistic_regression": [{"C": 1.0}]}, repeats=2)
    result = train_experiment(loans, config)
    state = result.bundle.model.stages[1].fitted
    assert list(state.hot) == ["city"] and not result.failures
    assert result.comparison["logistic_regression"]["cv_roc_auc_mean"] > 0.9
    names = {r["feature"] for r in result.shapley.collect()}
    assert any(name.startswith("cat__city_c") for name in names) and "" not in names
    save_model_bundle(spark, result.bundle, str(tmp_path / "bundle"))
    scored = score(loans.drop("default"), load_model_bundle(spark, str(tmp_path / "bundle")))
    assert scored.count() == 600
    assert training.slot_names(state, range(3)).keys() <= {0, 1, 2}


def test_lists_of_different_lengths_keep_their_own_unknown_code(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y")], "id int, k string, m string")
    state = encoding.fit_encoder(df, SchemaProfile(categorical=["k", "m"]), {})
    asked = spark.createDataFrame([(1, "new", "new"), (2, "c", None)], "id int, k string, m string")
    encoded = encoding.encode(asked, state, False)
    assert [tuple(r)[3:] for r in encoded.orderBy("id").collect()] == [(3.0, 2.0), (2.0, 0.0)]
    vectors = PipelineModel(encoding.vector_stages(spark, state)).transform(encoded)
    got = [r["f"] for r in vectors.orderBy("id").select(vector_to_array("features").alias("f")).collect()]
    assert got == [[0.0] * 5, [0.0, 0.0, 1.0, 1.0, 0.0]]
