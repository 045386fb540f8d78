import math

import pytest
from pyspark.sql import functions as F

from obligor.plans import analyze, candidates, scoring, training
from obligor.session import pin
from obligor.sources import bundles
from obligor.streaming.scoring import read_applicant_stream, score_stream

TINY = {
    "logistic_regression": [
        {"C": 1.0, "class_weight": None, "max_iter": 20},
        {"C": 0.01, "class_weight": "balanced", "max_iter": 20},
    ],
    "ridge_logistic_regression": [{"C": 0.5, "class_weight": None, "max_iter": 20}],
    "random_forest": [{"n_estimators": 4, "max_depth": 3, "min_samples_leaf": 2, "class_weight": "balanced"}],
    "xgboost": [{"n_estimators": 2, "max_depth": 2, "learning_rate": 0.1, "subsample": 0.9, "colsample": 0.9}],
}


def binary_rows(spark, n=40):
    rows = [
        (i, 1000 + i * 37 % 500, 200 + i * 53 % 800, "bad" if i % 3 == 0 else "good") for i in range(n)
    ]
    return spark.createDataFrame(rows, "row_id bigint, income bigint, loan_amount bigint, outcome string")


def multiclass_rows(spark, n=60):
    base = {"A": 1000, "B": 1500, "C": 2000}
    rows = []
    for i in range(n):
        label = "ABC"[i % 3]
        rows.append((i, base[label] + i * 17 % 200, 300 + i * 29 % 400, label))
    return spark.createDataFrame(rows, "row_id bigint, income bigint, loan_amount bigint, outcome string")


def coded(df, codes):
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("outcome")]
    return df.withColumn("default", code).drop("outcome")


def config(*names, **options):
    names = names or tuple(TINY)
    return training.TrainConfig(candidates=names, space=TINY, as_of="2024-01-01", **options)


@pytest.fixture(scope="module")
def binary(spark):
    seen = []
    rows = coded(binary_rows(spark), {"good": 0, "bad": 1})
    result = training.train_experiment(
        rows, config(folds=3), target_name="outcome", progress=lambda *step: seen.append(step)
    )
    return result, seen


def test_every_candidate_is_compared(binary):
    result, seen = binary
    assert list(result.comparison) == list(candidates.CANDIDATES)
    assert result.champion in result.comparison
    assert [(done, total) for done, total, _ in seen] == [(i, 4) for i in range(1, 5)]
    assert training.seconds_left(1, 4, 2.0) == 6.0 and training.seconds_left(4, 4, 9.0) == 0.0
    for name, metrics in result.comparison.items():
        assert metrics["cv_folds"] == 3
        assert metrics["numeric_scaled"] == (name in candidates.SCALED)
        assert 0.05 <= metrics["threshold"] <= 0.95
        assert metrics["gini"] == pytest.approx(2 * metrics["roc_auc"] - 1)
        (tn, fp), (fn, tp) = metrics["confusion_matrix"]
        assert tn + fp + fn + tp == 8
        assert metrics["recall"] == pytest.approx(tp / (tp + fn))
    best = max(m["cv_roc_auc_mean"] for m in result.comparison.values())
    assert result.comparison[result.champion]["cv_roc_auc_mean"] == best


def test_split_sizes_and_definition(binary):
    result, _ = binary
    assert (result.prepared.train.count(), result.prepared.test.count()) == (32, 8)
    assert result.bundle.target_definition == "outcome mapped to default=1 / non-default=0"
    assert result.bundle.feature_names == ["income", "loan_amount"]
    assert "debt_to_income_ratio" in {c for s, _, c in result.report if s == "derived"}


def test_champion_rules():
    comparison = {
        "a": {"cv_test_mse": 0.2, "auc": math.nan},
        "b": {"cv_test_mse": 0.1, "auc": 0.7},
        "c": {"cv_test_mse": 0.1, "auc": 0.7},
    }
    assert training.champion_of(comparison, "cv_test_mse") == "b"
    assert training.champion_of(comparison, "auc") == "b"
    with pytest.raises(RuntimeError):
        training.champion_of({"a": {"auc": math.nan}, "b": {"auc": None}}, "auc")


def test_search_is_reproducible_and_in_range():
    assert candidates.sample_params("xgboost") == candidates.sample_params("xgboost")
    assert len(candidates.sample_params("random_forest")) == 8
    for params in candidates.sample_params("logistic_regression", 50):
        assert 0.05 <= params["C"] <= 8.05 and params["class_weight"] in (None, "balanced")
    for params in candidates.sample_params("random_forest", 50):
        assert 150 <= params["n_estimators"] < 450 and 2 <= params["min_samples_leaf"] < 12
    for params in candidates.sample_params("xgboost", 50):
        assert 2 <= params["max_depth"] < 5 and 0.025 <= params["learning_rate"] <= 0.175


def test_best_param_set():
    rows = [
        {"param_set": s, "roc_auc": v}
        for s, v in ((0, 0.5), (0, 0.7), (1, 0.6), (1, 0.6), (2, None), (2, 0.9))
    ]
    assert training.best_param_set(rows) == 0


def test_out_of_fold_covers_every_training_row_once(spark):
    rows = coded(binary_rows(spark, 60), {"good": 0, "bad": 1})
    prepared = training.prepare(rows, config("logistic_regression", folds=4))
    states = training.fit_states(prepared)
    oof = training.out_of_fold(prepared, "logistic_regression", TINY["logistic_regression"], states)
    counts = oof.groupBy("param_set", "row_id").count().collect()
    assert len(counts) == 2 * 48 and all(r["count"] == 1 for r in counts)
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in oof.collect())
    # The held-out rows never enter the statistics of their own fold.
    kept = prepared.train.where("fold <> 0").select(F.percentile("income", 0.5)).first()[0]
    assert states[0].state.fills["income"] == kept


def test_bundle_round_trip_and_scoring(spark, binary, tmp_path):
    result, _ = binary
    saved = bundles.save_model_bundle(spark, result.bundle, str(tmp_path / "bundle"))
    loaded = bundles.load_model_bundle(spark, str(tmp_path / "bundle"))
    assert loaded.saved_at == saved.saved_at and loaded.model_name == result.champion
    assert loaded.feature_types == result.bundle.feature_types
    asked = spark.createDataFrame(
        [(1, "1200", None, "x"), (2, "oops", 300.0, "y"), (3, "1400", 900.0, "z")],
        "row_id bigint, income string, loan_amount double, extra string",
    )
    before = scoring.score(asked, result.bundle).orderBy("row_id").collect()
    after = scoring.score(asked, loaded).orderBy("row_id").collect()
    assert before == after
    for row in after:
        assert 0.0 <= row["probability_default"] <= 1.0
        assert row["threshold"] == result.bundle.threshold
        assert row["model_name"] == result.champion
        assert row["decision"] in ("Approve", "Manual Review", "Reject")
    # A column the model needs but the input lacks is NULL and imputed.
    assert scoring.score(asked.select("row_id"), loaded).count() == 3
    with pytest.raises(FileNotFoundError):
        bundles.load_model_bundle(spark, str(tmp_path / "absent"))


def test_scoring_has_no_shuffle(spark, binary):
    result, _ = binary
    scored = scoring.score(result.prepared.test, result.bundle)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_stream_equals_batch(spark, binary, tmp_path):
    result, _ = binary
    rows = coded(binary_rows(spark), {"good": 0, "bad": 1}).drop("default")
    source = str(tmp_path / "in")
    rows.where("row_id < 20").write.parquet(source)
    stream = read_applicant_stream(spark, source, rows.schema, "*.parquet", 1)
    sink, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    score_stream(stream, result.bundle, sink, progress).awaitTermination()
    rows.where("row_id >= 20").write.mode("append").parquet(source)
    score_stream(stream, result.bundle, sink, progress).awaitTermination()
    streamed = spark.read.parquet(sink)
    batch = scoring.score(rows, result.bundle)
    assert streamed.count() == 40
    assert batch.select(streamed.columns).exceptAll(streamed).count() == 0


def test_text_target_without_codes_is_refused(spark):
    rows = binary_rows(spark).withColumn("default", F.lit(2)).drop("outcome")
    with pytest.raises(ValueError):
        training.prepare(rows, config())


def test_multiclass_analysis(spark):
    result = analyze.analyze(
        multiclass_rows(spark),
        "outcome",
        config("logistic_regression", "random_forest", "xgboost", repeats=2),
        folds=2,
    )
    comparison = result.experiment.comparison
    assert result.class_names == {0: "A", 1: "B", 2: "C"}
    assert all("accuracy" in m and "ks_statistic" not in m for m in comparison.values())
    assert all(len(m["confusion_matrix"]) == 3 for m in comparison.values())
    best = min(m["cv_test_mse"] for m in comparison.values())
    assert comparison[result.experiment.champion]["cv_test_mse"] == best
    assert result.leaderboard.first()["model"] == result.experiment.champion
    assert result.experiment.bundle.target_definition == (
        "default classified into 3 classes (0=A, 1=B, 2=C)"
    ).replace("default", "outcome")
    assert result.importance.first()["feature"] == "income"
    assert {r["section"] for r in result.report.select("section").distinct().collect()} >= {
        "original", "derived", "encoding", "importance",
    }
    assert result.tables["confusion_matrix"].count() == 9
    asked = multiclass_rows(spark, 3).drop("outcome")
    classes = scoring.score_classes(asked, result.experiment.bundle).collect()
    assert {r["predicted_label"] for r in classes} <= {"A", "B", "C"}
    long = scoring.class_probabilities(asked, result.experiment.bundle, "row_id")
    sums = long.groupBy("row_id").agg(F.sum("probability").alias("s"), F.count("*").alias("n")).collect()
    assert all(r["n"] == 3 and abs(r["s"] - 1) < 1e-9 for r in sums)


def test_boosted_multiclass_probabilities(spark):
    rows = coded(multiclass_rows(spark), {"A": 0, "B": 1, "C": 2})
    prepared = training.prepare(rows, config("xgboost", folds=2))
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, "xgboost", TINY["xgboost"][0], prepared.train, fitted)
    probs = [r["probs"] for r in training.predictor(model)(prepared.test).collect()]
    assert all(len(p) == 3 and abs(sum(p) - 1) < 1e-9 for p in probs)


def test_binary_analysis_tables(spark):
    steps = []
    result = analyze.analyze(
        binary_rows(spark, 80),
        "outcome",
        config("logistic_regression", "ridge_logistic_regression", repeats=2),
        positive="bad",
        folds=2,
        progress=lambda *s: steps.append(s),
    )
    assert result.experiment.prepared.config.selection == "cv_test_mse"
    assert {"roc_curve", "calibration_curve", "lift_gain", "confusion_matrix"} <= set(result.tables)
    assert result.tables["lift_gain"].agg(F.sum("applicants")).first()[0] == 16
    assert result.comparison.columns[1:] == [
        "roc_auc", "pr_auc", "ks_statistic", "gini", "precision", "recall", "f1", "threshold",
    ]
    assert len(steps) == 2
    preview = analyze.preview(binary_rows(spark), "row_id")
    assert [r["column"] for r in preview.candidates.collect()] == ["outcome"]
    with pytest.raises(ValueError, match="Folds"):
        analyze.analyze(binary_rows(spark), "outcome", config(), positive="bad", folds=1000)
    with pytest.raises(ValueError, match="no value"):
        gaps = binary_rows(spark).withColumn("outcome", F.when(F.col("row_id") > 3, F.col("outcome")))
        analyze.analyze(pin(gaps), "outcome", config(), positive="bad", folds=2)


def test_a_forest_reads_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(training, "FOREST_ROWS", 50)
    whole = spark.range(1000).coalesce(2)
    dealt = training._dealt(whole, 1000)
    sizes = [len(part) for part in dealt.rdd.glom().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    assert training._dealt(whole, 80) is whole
