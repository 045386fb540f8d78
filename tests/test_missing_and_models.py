"""NaN as a missing value, reserved names, ids, and models that stand alone."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from obligor.functions.dates import parse_mixed
from obligor.operators import encoding, features, profile, woe
from obligor.plans import scoring, training
from obligor.plans.analyze import analyze, preview
from obligor.sources.bundles import load_model_bundle, save_model_bundle

NAN = float("nan")
RATES = {"n_estimators": 1, "max_depth": 2, "min_samples_leaf": 1, "class_weight": None}


@pytest.fixture(scope="module")
def loans(spark):
    rows = [
        (i, NAN if i % 9 == 0 else 1000.0 + i * 37 % 500, float(200 + i * 53 % 800), "abc"[i % 3], int(i % 3 == 0))
        for i in range(120)
    ]
    return spark.createDataFrame(rows, "row_id long, income double, loan_amount double, segment string, default int")


def settings(*names, **options):
    space = {"random_forest": [RATES], "logistic_regression": [{"C": 1.0, "class_weight": None}]}
    return training.TrainConfig(
        candidates=names or ("random_forest",), space=space, folds=3, repeats=2, as_of="2020-01-01", **options
    )


def test_nan_is_missing_in_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (NAN,)], "x double")
    assert encoding.medians(df, ["x"]) == {"x": 2.0}
    assert profile.column_facts(df)[0].nulls == 1
    assert profile.missing_summary(df).first()["missing_rate"] == 0.25
    counted = df.select(features.delinquency_count([F.col("x")]).alias("n")).collect()
    assert [row["n"] for row in counted] == [1, 1, 1, 0]
    values = encoding.category_counts(df, ["x"]).select("value").collect()
    assert {row["value"] for row in values} == {"1.0", "2.0", "3.0"}


def test_mostly_nan_column_is_dropped(spark):
    df = spark.createDataFrame([(i, NAN if i else 1.0, float(i)) for i in range(200)], "id long, x double, y double")
    assert profile.profile_schema(df, "id")[0].dropped == ["x"]
    assert {r["column"] for r in preview(df, "id").columns.collect()} == {"x", "y"}


@pytest.mark.parametrize("name", ["logistic_regression", "random_forest"])
def test_training_and_scoring_with_nan(spark, loans, name):
    result = training.train_experiment(loans, settings(name), explained=False)
    scored = scoring.score(loans.drop("default"), result.bundle).collect()
    assert len(scored) == 120 and all(0 <= r["probability_default"] <= 1 for r in scored)
    nan, null = (
        scoring.score(spark.createDataFrame([(1, v, 500.0, "a")], "row_id long, income double, loan_amount double, segment string"), result.bundle).first()
        for v in (NAN, None)
    )
    assert nan["probability_default"] == null["probability_default"]


@pytest.mark.parametrize("name", ["fold", "split", "weight", "features", "prediction", "num__x"])
def test_reserved_names_are_refused(loans, name):
    with pytest.raises(ValueError, match=name):
        training.prepare(loans.withColumnRenamed("income", name), settings())


def test_ids_are_checked(loans):
    with pytest.raises(ValueError, match="no 'row_id'"):
        training.prepare(loans.withColumn("row_id", F.when(F.col("row_id") > 5, F.col("row_id"))), settings())
    with pytest.raises(ValueError, match="more than one row"):
        training.prepare(loans.withColumn("row_id", F.col("row_id") % 30), settings())


def test_report_and_explanations_come_with_the_experiment(spark, loans, tmp_path):
    result = training.train_experiment(loans, settings(), "loans", class_names={0: "good", 1: "bad"})
    save_model_bundle(spark, result.bundle, str(tmp_path / "model"))
    report = load_model_bundle(spark, str(tmp_path / "model")).report
    assert report["n_train"] == 96 and report["n_test"] == 24 and report["cv_folds"] == 3
    assert set(report["top_features"]) == {"income", "loan_amount", "segment"}
    assert report["class_names"] == {"0": "good", "1": "bad"}
    assert {r["feature"] for r in result.dependence.collect()} == {"income", "loan_amount"}
    names = {r["feature"] for r in result.shapley.collect()}
    assert {"cat__segment_a", "cat__segment_b", "cat__segment_c", "num__income"} <= names


def test_shapley_values_of_the_matrix_add_up(loans):
    result = training.train_experiment(loans, settings(), explained=False)
    prepared, model = result.prepared, result.bundle.model
    values = training.encoded_shapley(model, prepared.test, "row_id", sample=12)
    sums = {r["row_id"]: r["total"] for r in values.groupBy("row_id").agg(F.sum("shapley").alias("total")).collect()}
    scores = training.predictor(model)(prepared.test).select("row_id", F.col("probs")[1].alias("p")).collect()
    chosen = {r["row_id"]: r["p"] for r in scores if r["row_id"] in sums}
    mean = sum(chosen.values()) / len(chosen)
    assert len(sums) == 12
    assert all(abs(sums[i] - (p - mean)) < 1e-9 for i, p in chosen.items())


def test_analysis_holds_every_table(loans):
    found = analyze(loans.withColumnRenamed("default", "bad"), "bad", settings(), folds=3)
    assert set(found.tables) == {
        "roc_curve", "pr_curve", "calibration_curve", "lift_gain", "prediction_distribution",
        "residuals", "confusion_matrix", "shapley", "partial_dependence",
    }
    assert all(table.count() > 0 for table in found.tables.values())


def test_two_digit_years_weekdays_and_fractions(spark):
    texts = ["01/05/20", "5-Jan-2020", "2020.01.05", "Jan 5 2020", "01/05/2020 3:04 PM", "Sun, 05 Jan 2020", "2020/01/05 10:00:00.5", "1/5/70"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) for r in df.select(parse_mixed(F.col("t"))).collect()]
    assert [g[:10] for g in got] == ["2020-01-05"] * 7 + ["1970-01-05"]
    assert got[4][11:16] == "15:04" and got[6][11:] == "10:00:00.500000"


def test_target_definition():
    assert training.target_definition("t", 2, None) == "t mapped to default=1 / non-default=0"
    assert training.target_definition("t", 3, {1: "b", 0: "a"}) == "t classified into 3 classes (0=a, 1=b)"
    assert training.target_definition("t", 3, None) == "t classified into 3 classes"


SECOND = """
import sys
from pyspark.ml import PipelineModel
from obligor.operators.woe import WeightOfEvidenceModel
from obligor.plans.scoring import score
from obligor.session import get_spark
from obligor.sources.bundles import load_model_bundle
top, scratch = sys.argv[1:]
spark = get_spark("second", master="local[2]", **{"spark.checkpoint.dir": scratch, "spark.ui.enabled": "false"})
bundle = load_model_bundle(spark, f"{top}/model")
rows = spark.createDataFrame([(i, f"c{i}") for i in range(0, 2600, 7)], "row_id long, city string")
score(rows, bundle).select("row_id", "probability_default").write.parquet(f"{top}/scores")
weights = PipelineModel.load(f"{top}/woe").transform(rows)
weights.write.parquet(f"{top}/weighed")
spark.stop()
"""


def test_saved_models_need_no_other_folder(spark, tmp_path):
    """Saved here, moved away from where it was trained, scored by a session with its own scratch."""
    df = spark.range(5000).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("c"), (F.col("id") % 2500).cast("string")).alias("city"),
        (F.col("id") % 2).cast("int").alias("default"),
    )
    prepared = training.prepare(df, settings())
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, "random_forest", RATES, prepared.train, fitted)
    bundle = training.ModelBundle(model, "random_forest", "cities", {"city": "string"}, "default=1", 0.5)
    save_model_bundle(spark, bundle, str(tmp_path / "here" / "model"))
    from pyspark.ml import PipelineModel

    weigher = woe.WeightOfEvidence(["city"], "default").fit(df)
    PipelineModel([weigher]).write().overwrite().save(str(tmp_path / "here" / "woe"))
    (tmp_path / "here").rename(tmp_path / "there")
    top = str(tmp_path / "there")
    done = subprocess.run([sys.executable, "-c", SECOND, top, str(tmp_path / "scratch")], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = spark.createDataFrame([(i, f"c{i}") for i in range(0, 2600, 7)], "row_id long, city string")
    want = {r["row_id"]: r["probability_default"] for r in scoring.score(rows, bundle).collect()}
    got = {r["row_id"]: r["probability_default"] for r in spark.read.parquet(f"{top}/scores").collect()}
    assert got == want
    weighed = {r["row_id"]: r["city"] for r in spark.read.parquet(f"{top}/weighed").collect()}
    assert weighed == {r["row_id"]: r["city"] for r in weigher.transform(rows).collect()}
