import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from obligor.operators import features, profile, targets


def mixed(spark):
    rows = [
        (1, 1000, 50000, "low", "card", "2024-01-01", 1),
        (2, 2000, 60000, "medium", "loan", "2024-02-01", 1),
        (3, 5000, 80000, "high", "loan", "2024-03-01", 1),
        (4, 7000, 90000, "medium", "card", "2024-04-01", 1),
    ]
    return spark.createDataFrame(
        rows,
        "row_id bigint, loan_amount bigint, income bigint, risk_grade string,"
        " product_type string, application_date string, constant int",
    )


def test_profile_of_mixed_schema(spark):
    found, orders = profile.profile_schema(mixed(spark), "row_id")
    assert found.numeric == ["loan_amount", "income"]
    assert found.ordinal == ["risk_grade"]
    assert found.categorical == ["product_type"]
    assert found.date == ["application_date"]
    assert found.dropped == ["constant"]
    assert orders == {"risk_grade": ["low", "medium", "high"]}


def test_roles_overlap_when_an_order_is_configured(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 1, 6), (3, 0, 7)], "id int, flag int, n int")
    found, _ = profile.profile_schema(df, "id", {"flag": [0, 1], "n": [5, 6, 7], "absent": [1]})
    assert found.boolean == ["flag"]
    assert found.ordinal == ["flag", "n"]
    assert found.numeric == ["n"]
    assert found.detected() == {"flag": "ordinal", "n": "numeric"}


def test_boolean_tokens_are_case_sensitive_and_floats_count(spark):
    df = spark.createDataFrame(
        [(1, "Y", "y", 1.0, True), (2, "N", "n", 0.0, False), (3, None, "y", None, True)],
        "id int, a string, b string, c double, d boolean",
    )
    found, _ = profile.profile_schema(df, "id")
    assert found.boolean == ["a", "c", "d"]
    assert found.categorical == ["b"]


def test_null_rate_limit(spark):
    df = spark.range(100).select(
        "id",
        F.when(F.col("id") < 2, F.col("id")).alias("two"),
        F.when(F.col("id") < 3, F.col("id")).alias("three"),
        F.lit(None).cast("string").alias("empty"),
    )
    found, _ = profile.profile_schema(df, "id")
    assert found.dropped == ["two", "empty"]
    assert found.numeric == ["three"]


def test_date_share_uses_the_first_hundred_values_in_id_order(spark):
    text = F.when(F.col("id") < 80, "2024-01-01").otherwise("zzz")
    df = spark.range(500).select("id", text.alias("a"), F.lit("12").alias("b"))
    assert profile.date_columns(df, ["a", "b"], "id") == ["a"]
    later = spark.range(500).select("id", F.when(F.col("id") >= 21, "2024-01-01").otherwise("z").alias("a"))
    assert profile.date_columns(later, ["a"], "id") == []


def test_ordinal_labels_are_lower_case_unless_normalized(spark):
    df = spark.createDataFrame([("Low",), ("HIGH ",), ("low",)], "risk_level string")
    assert profile.infer_ordinal_mappings(df) == {"risk_level": ["low", "high"]}
    spelled = profile.infer_ordinal_mappings(df, normalize=True)
    assert spelled == {"risk_level": ["Low", "low", "HIGH "]}


def test_ordinals_need_a_telling_name_and_few_values(spark):
    df = spark.createDataFrame([("low", "low", "low")] * 2 + [("high", "low", "odd")], "a string, risk string, grade string")
    assert profile.infer_ordinal_mappings(df) == {}


def test_unique_counts_match_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, None, 0.0, -0.0, 2.0], "b": ["x", "x", None, "y", "z"], "c": [None] * 5})
    df = spark.createDataFrame(pdf.astype({"c": "string"}), "a double, b string, c string")
    counts = {r["column"]: r["unique_values"] for r in profile.unique_counts(df, ["a", "b", "c"]).collect()}
    # A float column arrives with NaN for missing; count it as pandas does after cleaning.
    from obligor.functions.numeric import nan_to_null

    cleaned = profile.unique_counts(nan_to_null(df), ["a", "b", "c"])
    assert {r["column"]: r["unique_values"] for r in cleaned.collect()} == {
        c: pdf[c].nunique() for c in pdf
    }
    assert counts["b"] == 3


def test_target_candidates_wording(spark):
    df = spark.createDataFrame(
        [("0", 10, 1.0, "b"), ("1", 2, 0.0, "a"), ("0", 1, 1.0, "b")],
        "zero_one string, three int, float_flag double, pair string",
    )
    rows = {r["column"]: r["encoding"] for r in targets.target_candidates(df, df.columns).collect()}
    assert rows["zero_one"] == "already 0/1 (assumes 1 = positive/default outcome)"
    assert rows["three"] == "'1' → 0, '10' → 1, '2' → 2"
    assert rows["float_flag"] == "'0.0' / '1.0' — you'll choose which is positive"
    assert rows["pair"] == "'a' / 'b' — you'll choose which is positive"


def test_target_needs_two_to_twenty_values(spark):
    df = spark.range(21).select("id", F.lit(1).alias("one"), (F.col("id") % 20).alias("twenty"))
    assert [r["column"] for r in targets.target_candidates(df, df.columns).collect()] == ["twenty"]
    with pytest.raises(ValueError):
        targets.class_codes(df, "id")


def test_class_codes(spark):
    df = spark.createDataFrame([("good", 10), ("bad", 2), ("good", 1)], "o string, n int")
    assert targets.class_codes(df, "o", "bad") == {"bad": 1, "good": 0}
    assert targets.class_codes(df, "n") == {"1": 0, "10": 1, "2": 2}
    with pytest.raises(ValueError, match="positive"):
        targets.class_codes(df, "o")
    coded = targets.encode_target(df, "o", {"good": 0, "bad": 1})
    assert [r["default"] for r in coded.orderBy("n").collect()] == [0, 1, 0]


def test_fold_limits(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 9, "t string")
    assert tuple(targets.fold_limits(df, "t").first()) == (3, 3)
    rare = spark.createDataFrame([("a",)] + [("b",)] * 9, "t string")
    assert tuple(targets.fold_limits(rare, "t").first()) == (2, 2)


def test_missing_summary_is_cut_before_zeros_are_removed(spark):
    columns = {f"c{i:02d}": F.when(F.col("id") != 0, 1) if i % 2 else F.lit(1) for i in range(30)}
    df = spark.range(4).select(*[v.alias(k) for k, v in columns.items()])
    top = profile.top_missing(df).collect()
    assert len(top) == 15 and all(r["missing_rate"] == 0.25 for r in top)


def test_interactions(spark):
    df = spark.createDataFrame(
        [(1, 10, 1000, 2, 30), (2, 20, 5000, 4, 50)],
        "row_id int, duration int, credit_amount int, installment_commitment int, age int",
    )
    plan = features.plan_features(df, "row_id")
    out = features.add_features(df, plan)
    assert "age_squared" in out.columns
    assert out.orderBy("row_id").first()["credit_amount_per_duration"] == 100


def test_age_bands_are_right_closed(spark):
    ages = [0, 1, 25, 26, 35, 45, 55, 65, 66, 120, 121, None]
    df = spark.createDataFrame([(None if a is None else float(a),) for a in ages], "age double")
    got = [r[0] for r in df.select(features.age_band(F.col("age"))).collect()]
    want = pd.cut(pd.Series(ages, dtype=float), [0, 25, 35, 45, 55, 65, 120], labels=False)
    assert got == [None if pd.isna(v) else int(v) for v in want]


def test_delinquency_counts_ignore_missing_values(spark):
    df = spark.createDataFrame(
        [(1, 2.0, None, 5.0, None), (2, 0.0, -1.0, None, None), (3, 1.0, 1.0, 1.0, 1.0)],
        "id int, late_a double, dpd_b double, payment_a double, installment_b double",
    )
    out = features.add_features(df, features.plan_features(df, "id")).orderBy("id").collect()
    assert [r["delinquency_count"] for r in out] == [1, 0, 2]
    assert [r["missed_payment_ratio"] for r in out] == [1.0, 0.0, 1.0]


def test_negative_days_become_years(spark):
    df = spark.createDataFrame([(1, -3652.5, -365.25)], "id int, days_birth double, days_employed double")
    row = features.add_features(df, features.plan_features(df, "id")).first()
    assert row["age_squared"] == pytest.approx(100.0)
    assert row["age_band"] == 0
    assert row["employment_stability_score"] == pytest.approx(0.6931471805599453)


def test_date_features(spark):
    df = spark.createDataFrame(
        [(1, datetime.datetime(2024, 5, 6, 12)), (2, None)], "id int, opened timestamp"
    )
    out = features.add_features(df, features.plan_features(df, "id"), "2024-05-08").orderBy("id").collect()
    first = out[0]
    assert (first["opened_month"], first["opened_quarter"], first["opened_age_days"]) == (5, 2, 1)
    assert out[1]["opened_month"] is None


def test_plan_is_frozen_for_scoring(spark, tmp_path):
    df = mixed(spark)
    plan = features.plan_features(df, "row_id")
    stage = features.CreditFeatures(plan=plan.to_json(), asOf="2024-06-01")
    stage.write().overwrite().save(str(tmp_path / "stage"))
    loaded = features.CreditFeatures.load(str(tmp_path / "stage"))
    one = df.where("row_id = 1").withColumn("application_date", F.lit("not a date"))
    out = loaded.transform(one)
    assert out.columns == ["row_id", *stage.names_out(df.columns[1:])]
    assert out.first()["application_date_month"] is None
