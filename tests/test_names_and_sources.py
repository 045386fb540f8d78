import datetime
import json

import pytest
from pyspark.sql import functions as F

from obligor.functions import names
from obligor.functions.dates import parse_mixed, whole_days_between
from obligor.functions.decisions import loose_cast
from obligor.functions.numeric import finite, floored_ratio, nan_to_null
from obligor.session import scratch_root, small_table
from obligor.sources import policy, readers, sinks
from obligor.sources.datasets import (
    DatasetConfig,
    get_dataset_config,
    register_dataset,
    registered,
)


def test_normalize_name():
    assert names.normalize_name("  Loan-Amount (USD) ") == "loan_amount_usd"
    assert names.normalize_name("__") == ""


def test_find_columns_uses_column_order_and_exclusions():
    columns = ["credit_limit", "Loan Amount", "amount_income", "amount"]
    assert names.find_columns(columns, ["amount"], ["income"]) == ["Loan Amount", "amount"]
    assert names.find_column(columns, ["nothing"]) is None
    # Patterns are not anchored: "age" is found inside "wage".
    assert names.find_column(["wage"], ["age"]) == "wage"


def test_name_rules_on_data_match_the_driver_rules(spark):
    texts = ["Loan-Amount", "x", "  A  b ", "__q__", "Ünïcode 9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        names.normalized(F.col("t")), names.matches(F.col("t"), ["amount$", "^a_"])
    )
    for text, (name, hit) in zip(texts, rows.collect(), strict=True):
        assert name == names.normalize_name(text)
        assert hit == names.matches_any(text, ["amount$", "^a_"])


def test_registry():
    assert get_dataset_config("german").target_column == "class"
    assert get_dataset_config("german").target_mapping == {"good": 0, "bad": 1}
    assert get_dataset_config("give_me_some_credit").target_column == "SeriousDlqin2yrs"
    assert list(get_dataset_config("home_credit").ignored_columns) == ["SK_ID_CURR"]
    with pytest.raises(ValueError, match=", ".join(registered())):
        get_dataset_config("absent")
    register_dataset(DatasetConfig("mine", "Mine", "y", path="a"))
    register_dataset(DatasetConfig("mine", "Mine", "y", path="b"))
    assert get_dataset_config("mine").path == "b"


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="source type"):
        readers.read_source(spark, DatasetConfig("x", "X", "y", "openml", "p"))
    with pytest.raises(ValueError, match="no path"):
        readers.read_source(spark, DatasetConfig("x", "X", "y"))
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, DatasetConfig("x", "X", "y", "csv", str(tmp_path / "no.csv")))
    with pytest.raises(FileNotFoundError):
        readers.read_source(spark, DatasetConfig("x", "X", "y", "table", "no_such_table"))


def _csv(tmp_path, text):
    path = tmp_path / "data.csv"
    path.write_text(text)
    return str(path)


def test_load_maps_drops_and_names_the_target(spark, tmp_path):
    path = _csv(tmp_path, "id,a,outcome,skip\n1,2.5,good,x\n2,,bad,y\n")
    register_dataset(
        DatasetConfig(
            "d", "D", "outcome", "csv", path, {"good": 0, "bad": 1}, ignored_columns=["skip", "no"]
        )
    )
    frame, _ = readers.load_credit_dataset(spark, "d")
    assert frame.columns == ["id", "a", "default"]
    assert [tuple(r) for r in frame.orderBy("id").collect()] == [(1, 2.5, 0), (2, None, 1)]


def test_load_refuses_targets_without_a_code(spark, tmp_path):
    rows = "\n".join(f"{1000 + i},{'abc'[i % 3]}" for i in range(30))
    path = _csv(tmp_path, f"income,segment\n{rows}\n")
    register_dataset(DatasetConfig("text", "T", "segment", "csv", path))
    with pytest.raises(ValueError, match="class code"):
        readers.load_credit_dataset(spark, "text")
    register_dataset(DatasetConfig("part", "T", "segment", "csv", path, {"a": 0, "b": 1}))
    with pytest.raises(ValueError, match="10 rows"):
        readers.load_credit_dataset(spark, "part")
    register_dataset(DatasetConfig("none", "T", "missing", "csv", path))
    with pytest.raises(ValueError, match="no column"):
        readers.load_credit_dataset(spark, "none")


def test_float_targets_are_truncated_and_text_is_read(spark):
    floats = spark.createDataFrame([(1.5,), (0.0,)], "y double")
    assert [r[0] for r in readers.prepare_target(floats, "y").collect()] == [1, 0]
    texts = spark.createDataFrame([(" 1",), ("0",)], "y string")
    assert [r[0] for r in readers.prepare_target(texts, "y").collect()] == [1, 0]
    with pytest.raises(ValueError):
        readers.prepare_target(spark.createDataFrame([("1.5",)], "y string"), "y")


def test_nan_becomes_null_and_ratios_guard_missing_denominators(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, 2.0), (2, 0.5, 3.0), (3, None, 4.0)], "i int, b double, t double")
    rows = nan_to_null(df).select(floored_ratio(F.col("t"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [None, 3.0, None]
    values = spark.createDataFrame([(inf,), (-inf,), (nan,), (1.0,), (None,)], "x double")
    assert [r[0] for r in values.select(finite(F.col("x"))).collect()] == [None] * 3 + [1.0, None]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-01-05", datetime.datetime(2024, 1, 5)),
        ("2024-01-05 10:30:00", datetime.datetime(2024, 1, 5, 10, 30)),
        ("2024-01-05T10:30:00Z", datetime.datetime(2024, 1, 5, 10, 30)),
        ("02/03/2024", datetime.datetime(2024, 2, 3)),
        ("13/03/2024", datetime.datetime(2024, 3, 13)),
        ("20240105", datetime.datetime(2024, 1, 5)),
        ("Jan 5, 2024", datetime.datetime(2024, 1, 5)),
        ("5 January 2024", datetime.datetime(2024, 1, 5)),
        ("2019", datetime.datetime(2019, 1, 1)),
        ("12", None),
        ("A", None),
        ("Q1", None),
        ("1-3", None),
        ("", None),
    ],
)
def test_parse_mixed(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(parse_mixed(F.col("t"))).first()
    assert row[0] == expected


def test_clock_time_counts_as_a_date(spark):
    row = spark.createDataFrame([("10:30",)], "t string").select(parse_mixed(F.col("t"))).first()
    assert (row[0].hour, row[0].minute) == (10, 30)


def test_whole_days_are_floored(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-02 12:00:00' AS a, timestamp'2024-01-03 00:00:00' AS b"
    )
    days = df.select(
        whole_days_between(F.col("a"), F.col("b")), whole_days_between(F.col("b"), F.col("a"))
    )
    assert tuple(days.first()) == (-1, 0)


def test_loose_cast(spark):
    df = spark.createDataFrame([("1e3", "x", "z"), ("n/a", "2", "z")], "a string, b string, c string")
    out = loose_cast(df, {"a": "double", "b": "int", "d": "double"})
    assert [(r.a, r.b, r.c, r.d) for r in out.collect()] == [(1000.0, None, "z", None), (None, 2, "z", None)]


def test_policy_document_round_trip(spark, tmp_path):
    path = tmp_path / "policy.json"
    text = {
        "approve_max_pd": 0.1,
        "manual_review_max_pd": 0.2,
        "risk_bands": [{"name": "All", "min_pd": 0.0, "max_pd": 1.0}],
    }
    path.write_text(json.dumps(text, indent=2))
    loaded = policy.load_policy(spark, str(path))
    assert loaded.approve_max_pd == 0.1
    assert [b.name for b in loaded.bands] == ["All"]
    assert policy.band_table(spark).count() == 4


def test_metric_sink_round_trip(spark, tmp_path):
    frame = sinks.metrics_frame(spark, {"m": {"roc_auc": 0.5, "folds": 3, "params": {"C": 1.0}}})
    sinks.save_metrics(frame, str(tmp_path / "nested" / "metrics"))
    back = {r.metric: (r.value, r.text) for r in sinks.load_metrics(spark, str(tmp_path / "nested" / "metrics")).collect()}
    assert back == {"roc_auc": (0.5, None), "folds": (3.0, None), "params": (None, "{'C': 1.0}")}


def test_scratch_comes_from_the_session(spark):
    assert scratch_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_small_table_is_local(spark):
    out = small_table(spark, [("a", 1, None)], "s string, n bigint, x double")
    assert [tuple(r) for r in out.collect()] == [("a", 1, None)]


def test_clear_scratch_deletes_what_was_written(spark, monkeypatch):
    from pathlib import Path

    from obligor import session

    monkeypatch.setattr(session, "_scratch_paths", {})
    kept = session.pin(spark.range(5).toDF("id"), "gone")
    path = session._scratch_paths[spark.sparkContext.applicationId][0]
    assert kept.count() == 5 and Path(path).exists()
    assert session.clear_scratch(spark) == 1
    assert not Path(path).exists() and session.clear_scratch(spark) == 0
