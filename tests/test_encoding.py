import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from obligor.operators import encoding, woe
from obligor.operators.profile import SchemaProfile


def test_clipper_caps_extremes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (1000.0,)], "x double")
    bounds = encoding.clip_bounds(df, ["x"], low=0.0, high=0.75, skew_threshold=0.0)
    assert bounds["x"].high == pytest.approx(252.25)
    assert encoding.clipped(df, bounds).agg(F.max("x")).first()[0] < 1000


def test_skew_is_bias_corrected(spark):
    numbers = [1.0, 2.0, 2.5, 9.0, 30.0]
    df = spark.createDataFrame([(v,) for v in numbers], "x double")
    known = encoding.moments(df, ["x"])["x"]
    assert known.skew == pytest.approx(abs(pd.Series(numbers).skew()))
    assert known.deviation == pytest.approx(np.std(numbers))


def test_constant_and_short_columns_have_no_skew(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    known = encoding.moments(df, ["a", "b"])
    assert known["a"].skew == known["b"].skew == 0.0
    assert known["a"].deviation == 1.0


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("a", 10), ("b", 9), (None, None)], "t string, n int")
    counts = encoding.category_counts(df, ["t", "n"])
    got = {r["column"]: r["value"] for r in encoding.most_frequent(counts, ["n"]).collect()}
    # As text "10" would come before "9".
    assert got == {"t": "a", "n": "9"}


def fitted(spark):
    rows = [
        (1, 10.0, "Y", "low", "card"),
        (2, None, "N", "high", "loan"),
        (3, 30.0, None, None, None),
        (4, 20.0, "Y", "high", "loan"),
    ]
    df = spark.createDataFrame(rows, "id int, x double, flag string, risk string, kind string")
    found = SchemaProfile(numeric=["x"], boolean=["flag"], ordinal=["risk"], categorical=["kind"])
    return df, found, {"risk": ["low", "medium", "high"]}


def vectors(spark, df, model):
    state = model.fitted
    out = PipelineModel(encoding.vector_stages(spark, state)).transform(model.transform(df))
    rows = out.orderBy("id").select(vector_to_array("features").alias("f")).collect()
    return [r["f"] for r in rows]


def test_encoder_matches_the_definition(spark, tmp_path):
    df, found, orders = fitted(spark)
    model = encoding.TableEncoder(found, orders, scaled=True).fit(df)
    numbers = np.array([10.0, 20.0, 30.0, 20.0])
    scaled = (numbers - numbers.mean()) / numbers.std()
    want = [
        [scaled[0], 1, 0, 1, 0],
        [scaled[1], 0, 2, 0, 1],
        [scaled[2], 1, 2, 0, 1],
        [scaled[3], 1, 2, 0, 1],
    ]
    assert np.allclose(vectors(spark, df, model), want)
    model.write().overwrite().save(str(tmp_path / "encoder"))
    loaded = encoding.TableEncoderModel.load(str(tmp_path / "encoder"))
    assert np.allclose(vectors(spark, df, loaded), want)


def test_unknown_values(spark):
    df, found, orders = fitted(spark)
    model = encoding.TableEncoder(found, orders, scaled=False).fit(df)
    strange = spark.createDataFrame(
        [(1, 5.0, "maybe", "extreme", "lease")], "id int, x double, flag string, risk string, kind string"
    )
    assert vectors(spark, strange, model) == [[5.0, -1.0, -1.0, 0.0, 0.0]]


def test_numeric_orders_compare_as_numbers(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 7.0)], "id int, level double")
    found = SchemaProfile(ordinal=["level"])
    model = encoding.TableEncoder(found, {"level": [1, 2, 3]}, scaled=False).fit(df)
    rows = model.transform(df).orderBy("id").collect()
    assert [r["ord__level"] for r in rows] == [2.0, 0.0, -1.0]


def test_fitting_uses_training_rows_only(spark):
    df, found, orders = fitted(spark)
    state = encoding.fit_encoder(df.where("id <= 2"), found, orders)
    assert state.fills == {"x": 10.0}
    assert state.values["kind"] == ["card", "loan"]


def test_encoding_counts_include_zero(spark):
    rows = encoding.engineering_report(["a", "b"], [], SchemaProfile(numeric=["a", "b"]), False)
    counts = encoding.encoding_counts(encoding.report_frame(spark, rows)).collect()
    assert {r["kind"]: r["columns"] for r in counts} == {
        "numeric": 2,
        "boolean": 0,
        "ordinal": 0,
        "one_hot": 0,
        "date": 0,
    }


def test_woe(spark, tmp_path):
    df = spark.createDataFrame([("A", 0), ("A", 0), ("B", 1), ("C", 1), (None, 0)], "grade string, y int")
    model = woe.WeightOfEvidence(["grade"], "y").fit(df)
    model.write().overwrite().save(str(tmp_path / "woe"))
    loaded = woe.WeightOfEvidenceModel.load(str(tmp_path / "woe"))
    asked = spark.createDataFrame([("A", 1), ("B", 2), (None, 3), ("new", 4)], "grade string, at int")
    got = [r["grade"] for r in loaded.transform(asked).orderBy("at").collect()]
    good, bad = 3.5, 2.5

    def weight(g, b):
        return np.log(((g + 0.5) / good) / ((b + 0.5) / bad))

    assert got == pytest.approx([weight(2, 0), weight(0, 1), weight(1, 0), 0.0])


def test_woe_lookup_equals_join(spark, monkeypatch):
    rows = [
        (i, None if i % 2 else f"v{i % 7}", "nan" if i % 5 == 0 else f"w{i % 3}", None if i % 11 else float(i), i % 3 % 2)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "id long, a string, b string, c double, y int").repartition(4)
    columns = ["a", "b", "c"]
    table = woe.woe_table(df, columns, "y")
    asked = df.union(spark.createDataFrame([(300, "new", None, 0.5, 0)], df.schema))

    def weighed():
        out = woe.apply_woe(asked, table, columns)
        assert out.columns == asked.columns
        return out

    looked_up = weighed()
    plan = looked_up._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(woe, "LISTED", 0)
    want = {(r["column"], r["value"]): r["woe"] for r in table.collect()}
    for result in (looked_up.collect(), weighed().collect()):
        got = {r["id"]: r for r in result}
        assert len(result) == 301 and tuple(got[300])[1:4] == (0.0, want["b", "nan"], 0.0)
        for i, a, b, c, _ in rows:
            texts = [str(v) if v is not None else "nan" for v in (a, b, c)]
            assert tuple(got[i])[1:4] == pytest.approx([want[k] for k in zip(columns, texts, strict=True)])
