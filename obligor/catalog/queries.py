"""Spark side: one query per operator over the applicant view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.functions import decisions, names
from obligor.functions.dates import parse_mixed
from obligor.functions.probabilities import top_class
from obligor.operators import (
    encoding,
    explain,
    features,
    lift,
    profile,
    ranking,
    scorecard,
    splitting,
    targets,
    thresholds,
    weights,
    woe,
)
from obligor.plans import analyze, reporting, scoring, training
from obligor.plans.applicants import ID, applicants, class_weights_by_id, features_only, table
from obligor.session import pin, scratch_path, small_table
from obligor.sources import bundles, policy, readers, sinks
from obligor.sources.datasets import DatasetConfig, get_dataset_config, register_dataset, registered
from obligor.streaming.scoring import read_applicant_stream, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2000-01-01 00:00:00"
SEED = 42


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def view(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The needed columns of the applicant view, built once."""
    return pin(applicants(spark, sf).select(ID, *columns), "applicants")


def scored_view(spark: SparkSession, sf: str) -> DataFrame:
    """Not written here: a metric that needs several passes writes its two columns itself."""
    return applicants(spark, sf).select(ID, "y", "pd_score")


# --- flagship -----------------------------------------------------------------------


def decision_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Applications, mean score and exposure by product, risk band and decision."""
    a = applicants(spark, sf)
    decided = decisions.with_decision(a, F.col("pd_score")).withColumn(
        "debt_to_income", features.floored_ratio(F.col("loan_amount"), F.col("income"))
    )
    mix = decided.groupBy("product_type", "risk_band", "decision").agg(
        F.count(F.lit(1)).alias("applications"),
        F.avg("pd_score").alias("avg_pd"),
        F.avg("debt_to_income").alias("avg_debt_to_income"),
        F.sum("loan_amount").alias("exposure"),
    )
    return rounded(mix, "avg_pd", "avg_debt_to_income").withColumn(
        "exposure", F.round("exposure", 2)
    )


QUERIES["decision_mix"] = decision_mix


# --- sources and sinks --------------------------------------------------------------


@query
def s1_dataset_registry(spark, sf):
    """Register two tables, look both up and count their rows per class."""
    register_dataset(
        DatasetConfig("orders_status", "Orders", "o_orderstatus", "parquet", f"{sf}/orders.parquet")
    )
    register_dataset(
        DatasetConfig("label_quality", "Labels", "quality", "parquet", f"{sf}/labels.parquet")
    )
    parts = []
    for name in registered():
        config = get_dataset_config(name)
        if config.name in ("orders_status", "label_quality"):
            target = F.col(config.target_column).cast("string").alias("target_value")
            parts.append(
                readers.read_source(spark, config)
                .groupBy(target)
                .agg(F.count(F.lit(1)).alias("row_count"))
                .select(F.lit(config.name).alias("dataset"), "target_value", "row_count")
            )
    return parts[0].unionByName(parts[1])


@query
def s2_csv_scan(spark, sf):
    """Write customers as CSV, scan the file with inferred types, summarise."""
    path = scratch_path(spark, "customers-csv")
    sinks.write_table(table(spark, sf, "customer"), path)
    frame = readers.read_source(spark, DatasetConfig("c", "Customers", "c_mktsegment", "csv", path))
    return rounded(
        frame.groupBy("c_mktsegment").agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("c_acctbal").alias("balance"),
            F.max("c_name").alias("last_name"),
        ),
        "balance",
        digits=2,
    )


@query
def s3_load_dataset(spark, sf):
    """Mapped target, ignored columns dropped."""
    register_dataset(
        DatasetConfig(
            "orders_target",
            "Orders",
            "o_orderstatus",
            "parquet",
            f"{sf}/orders.parquet",
            target_mapping={"F": 0, "O": 1, "P": 2},
            ignored_columns=["o_custkey", "absent_column"],
        )
    )
    frame, _ = readers.load_credit_dataset(spark, "orders_target")
    return frame.drop("o_orderdate")


@query
def s4_table_sink(spark, sf):
    """Lift table through a CSV file and back."""
    path = scratch_path(spark, "lift-csv")
    lifted = lift.lift_gain_table(scored_view(spark, sf), "y", "pd_score", ID)
    sinks.write_table(lifted, path, single_file=True)
    back = spark.read.csv(path, header=True, inferSchema=True)
    return rounded(back, "avg_pd", "gain", "lift").withColumns(
        {c: F.col(c).cast("bigint") for c in ("bucket", "applicants", "defaults", "cumulative_defaults")}
    )


@query
def s5_metrics_sink(spark, sf):
    """Metrics of a rule score through a JSON file and back."""
    path = scratch_path(spark, "metrics-json")
    row = scorecard.binary_metrics(scored_view(spark, sf), "y", "pd_score", 0.5).first().asDict()
    sinks.save_metrics(sinks.metrics_frame(spark, {"rule": row}), path)
    return rounded(sinks.load_metrics(spark, path).select("model", "metric", "value"), "value")


@query
def s7_policy_bands(spark, sf):
    """Policy document on disk, read back and applied; its bands joined to the counts."""
    path = scratch_path(spark, "policy")
    rule = policy.default_policy()
    bands = [{"name": b.name, "min_pd": b.min_pd, "max_pd": b.max_pd} for b in rule.bands]
    document = spark.createDataFrame(
        [(rule.approve_max_pd, rule.manual_review_max_pd, bands)],
        "approve_max_pd double, manual_review_max_pd double,"
        " risk_bands array<struct<name string, min_pd double, max_pd double>>",
    )
    document.coalesce(1).write.json(path)
    loaded = policy.load_policy(spark, path)
    scores = applicants(spark, sf).select("pd_score")
    counts = scores.groupBy(decisions.risk_band(F.col("pd_score"), loaded).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("applications"), F.avg("pd_score").alias("avg_pd")
    )
    return rounded(policy.band_table(spark, loaded).join(counts, "risk_band"), "avg_pd")


# --- names, types, profiles ---------------------------------------------------------


@query
def p1_normalize_names(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", names.normalized(F.col("url")).alias("normalized_name")
    )


URL_PATTERNS = ("page", "^https_m", "ref_x$")


@query
def p2_matches_any(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", names.matches(F.col("url"), URL_PATTERNS).alias("matched")
    )


@query
def p3_semantic_columns(spark, sf):
    """Mean of every column that a feature source resolves to by name."""
    a = applicants(spark, sf)
    plan = features.plan_features(a, ID, dates=[])
    found = [(role, name) for role, name in plan.sources.items()]
    found += [("delinquency", c) for c in plan.delinquency] + [("payment", c) for c in plan.payment]
    means = a.agg(*[F.avg(F.col(n)).alias(f"m{i}") for i, (_, n) in enumerate(found)])
    rows = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"), F.lit(name).alias("column_name"), F.col(f"m{i}").alias("mean")
            )
            for i, (role, name) in enumerate(found)
        ]
    )
    return rounded(means.select(F.inline(rows)), "mean", digits=4)


def text_columns(spark, sf):
    """Orders with dates spelled in several ways, next to other text."""
    key = F.col("o_orderkey")
    moment = F.col("o_orderdate")
    spelled = (
        F.when(key % 5 == 0, F.date_format(moment, "yyyy-MM-dd"))
        .when(key % 5 == 1, F.date_format(moment, "MM/dd/yyyy"))
        .when(key % 5 == 2, F.date_format(moment, "yyyyMMdd"))
        .when(key % 5 == 3, F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(moment, "d MMM yyyy"))
    )
    return table(spark, sf, "orders").select(
        key.alias(ID),
        spelled.alias("signed_on"),
        F.when(key % 3 == 0, F.date_format(moment, "yyyy-MM-dd")).otherwise("unknown").alias("half_known"),
        F.when(key % 7 > 2, F.date_format(moment, "yyyy")).alias("year_text"),
        F.col("o_orderpriority").alias("priority"),
    )


@query
def p4_date_columns(spark, sf):
    """Parsed share of the first 100 values of text columns and the resulting verdict."""
    df = text_columns(spark, sf)
    shares = profile.date_shares(df, [c for c in df.columns if c != ID], ID)
    share = F.col("parsed") / F.col("sampled")
    return shares.select(
        F.col("column").alias("column_name"),
        "sampled",
        "parsed",
        (share >= profile.DATE_SHARE).alias("is_date"),
    )


@query
def p5_ordinal_values(spark, sf):
    """Known order fitted by values that differ in case and blanks."""
    a = applicants(spark, sf)
    spelled = F.when(F.col(ID) % 3 == 0, F.initcap("risk_grade")).otherwise(
        F.concat(F.lit(" "), F.upper("risk_grade"))
    )
    return profile.ordinal_values(a.select(spelled.alias("risk_grade")), "risk_grade")


@query
def p6_ordinal_mappings(spark, sf):
    """Value orders inferred for all text columns, and a configured one."""
    a = view(spark, sf, "risk_grade", "product_type", "is_urgent", "outcome")
    orders = profile.infer_ordinal_mappings(a, {"outcome": ["O", "P", "F"]})
    rows = [(c, i, str(v)) for c, values in orders.items() for i, v in enumerate(values)]
    known = small_table(spark, rows, "column_name string, position int, label string")
    counts = profile.value_counts(a, list(orders)).withColumnsRenamed(
        {"column": "column_name", "value": "label", "rows": "row_count"}
    )
    return known.join(counts, ["column_name", "label"])


PROFILED = (
    "loan_amount",
    "duration_months",
    "income",
    "risk_grade",
    "product_type",
    "is_urgent",
    "application_date",
    "constant",
    "y",
    "mostly_missing",
)


def profiled(spark, sf):
    sparse = F.when(F.col(ID) % 100 == 0, F.col("loan_amount"))
    a = applicants(spark, sf).withColumn("mostly_missing", sparse)
    return pin(a.select(ID, *PROFILED), "profiled")


@query
def p7_schema_profile(spark, sf):
    """Role of every column, with its missing rate."""
    df = profiled(spark, sf)
    found = profile.profile_schema(df, ID)[0]
    roles = [(c, r) for r in profile.TYPE_ORDER for c in getattr(found, r)]
    rates = profile.missing_summary(df, PROFILED)
    listed = small_table(spark, roles, "column string, role string")
    return rounded(
        listed.join(rates, "column").withColumnRenamed("column", "column_name"), "missing_rate"
    )


@query
def p8_detect_columns(spark, sf):
    return profile.detect_columns(profiled(spark, sf), ID).withColumnRenamed("column", "column_name")


@query
def p9_target_candidates(spark, sf):
    df = profiled(spark, sf)
    return targets.target_candidates(df, PROFILED).withColumnRenamed("column", "column_name")


@query
def p10_target_encoding(spark, sf):
    """Three classes numbered in text order."""
    a = view(spark, sf, "outcome")
    return targets.encode_target(a, "outcome", targets.class_codes(a, "outcome"))


@query
def p10_binary_target(spark, sf):
    """Two classes with a named positive value."""
    a = view(spark, sf, "is_urgent")
    return targets.encode_target(a, "is_urgent", targets.class_codes(a, "is_urgent", "N"))


@query
def p11_fold_limits(spark, sf):
    return targets.fold_limits(applicants(spark, sf), "product_type")


@query
def p12_missing_summary(spark, sf):
    rates = profile.missing_summary(profiled(spark, sf), PROFILED)
    return rounded(rates.withColumnRenamed("column", "column_name"), "missing_rate")


@query
def p12_top_missing(spark, sf):
    rates = profile.top_missing(profiled(spark, sf), PROFILED)
    return rounded(rates.withColumnRenamed("column", "column_name"), "missing_rate")


# --- derived features ---------------------------------------------------------------

FEATURE_OF = {
    "f1_loan_per_duration": "loan_amount_per_duration_months",
    "f2_debt_to_income": "debt_to_income_ratio",
    "f3_savings_to_loan": "savings_to_loan_ratio",
    "f4_age_squared": "age_squared",
    "f5_age_band": "age_band",
    "f6_employment_stability": "employment_stability_score",
    "f7_credit_exposure": "credit_exposure_score",
    "f8_credit_utilization": "credit_utilization_ratio",
    "f9_delinquency_count": "delinquency_count",
    "f10_missed_payment_ratio": "missed_payment_ratio",
    "f11_date_month": "application_date_month",
    "f12_date_quarter": "application_date_quarter",
    "f13_date_age_days": "application_date_age_days",
}


def _feature_query(name: str, feature: str) -> Query:
    def run(spark, sf):
        df = features_only(applicants(spark, sf))
        plan = features.plan_features(df, ID, dates=["application_date"])
        out = features.add_features(df, plan, AS_OF).select(ID, feature)
        # More digits where six would meet exact ties of cents over round numbers.
        digits = {"f1_loan_per_duration": 9, "f8_credit_utilization": 10}.get(name, 6)
        return rounded(out, feature, digits=digits)

    run.__name__ = name
    return run


for _name, _feature in FEATURE_OF.items():
    QUERIES[_name] = _feature_query(_name, _feature)


@query
def f4_features_from_days(spark, sf):
    """Ages and employment recorded as negative days, dates as text."""
    df = applicants(spark, sf).select(
        ID,
        (-F.col("age") * 365).alias("days_birth"),
        (-F.col("employment_years") * 365).alias("days_employed"),
        F.date_format("application_date", "MM/dd/yyyy").alias("signed_on"),
    )
    plan = features.plan_features(df, ID)
    out = features.add_features(df, plan, AS_OF).drop("days_birth", "days_employed", "signed_on")
    return rounded(out, *[c for c in out.columns if c != ID])


@query
def f14_feature_names(spark, sf):
    """Every name after feature building, with how often it has a value."""
    df = features_only(applicants(spark, sf))
    plan = features.plan_features(df, ID, dates=["application_date"])
    stage = features.CreditFeatures(plan=plan.to_json(), asOf=AS_OF)
    names_out = stage.names_out([c for c in df.columns if c != ID])
    counts = stage.transform(df).agg(*[F.count(F.col(c)).alias(c) for c in names_out])
    return counts.unpivot([], names_out, "feature", "present")


# --- encoding -----------------------------------------------------------------------

NUMERIC = ("loan_amount", "income", "savings", "revolving_balance")


def engineered(spark, sf):
    df = features_only(applicants(spark, sf))
    plan = features.plan_features(df, ID, dates=["application_date"])
    return pin(features.add_features(df, plan, AS_OF), "engineered")


@query
def e1_median_impute(spark, sf):
    a = view(spark, sf, *NUMERIC)
    filled = encoding.imputed(a, encoding.medians(a, NUMERIC))
    return rounded(filled.select(ID, *NUMERIC), *NUMERIC)


@query
def e2_outlier_clip(spark, sf):
    """Text lengths, clipped because they are heavy-tailed, and ids, which are not."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.col("doc_id").alias("position"))
    bounds = encoding.clip_bounds(docs, ["n_chars", "position"])
    return rounded(encoding.clipped(docs, bounds), "n_chars", "position")


@query
def e2_clip_bounds(spark, sf):
    """Bounds of the engineered columns whose skew calls for clipping."""
    columns = (
        "loan_amount",
        "loan_amount_per_duration_months",
        "debt_to_income_ratio",
        "savings_to_loan_ratio",
    )
    df = engineered(spark, sf)
    filled = encoding.imputed(df, encoding.medians(df, columns)).select(*columns)
    known = encoding.moments(filled, columns)
    bounds = encoding.clip_bounds(filled, columns, known=known)
    rows = [
        (c, known[c].skew, *((bounds[c].low, bounds[c].high) if c in bounds else (None, None)))
        for c in columns
    ]
    out = small_table(spark, rows, "column_name string, skew double, low double, high double")
    return rounded(out, "skew", "low", "high", digits=4)


@query
def e3_standard_scale(spark, sf):
    a = view(spark, sf, "loan_amount", "savings", "credit_limit")
    columns = ("loan_amount", "savings", "credit_limit")
    known = encoding.moments(a, columns)
    scaled = [
        F.round((F.col(c) - known[c].mean) / known[c].deviation, 6).alias(c) for c in columns
    ]
    return a.select(ID, *scaled)


def with_gaps(spark, sf, *extra):
    """Categories with a missing value in every seventh row."""
    present = F.col(ID) % 7 != 0
    return view(spark, sf, "is_urgent", "risk_grade", "product_type", "outcome", *extra).select(
        ID,
        *[F.when(present, F.col(c)).alias(c) for c in ("is_urgent", "risk_grade", "product_type")],
        "outcome",
        *extra,
    )


@query
def e4_most_frequent(spark, sf):
    df = with_gaps(spark, sf)
    counts = encoding.category_counts(df, ["is_urgent", "risk_grade", "product_type", "outcome"])
    return encoding.most_frequent(counts).withColumnRenamed("column", "column_name")


def coded(spark, sf):
    df = with_gaps(spark, sf).drop("outcome")
    found = profile.SchemaProfile(
        boolean=["is_urgent"], ordinal=["risk_grade"], categorical=["product_type"]
    )
    return df, encoding.fit_encoder(df, found, {"risk_grade": ["low", "medium", "high"]})


@query
def e5_boolean_code(spark, sf):
    df, state = coded(spark, sf)
    out = encoding.encode(df, state, False).select(ID, F.col("bool__is_urgent").alias("code"))
    return out.withColumn("code", F.col("code").cast("int"))


@query
def e6_ordinal_code(spark, sf):
    """A given order; a value outside it is -1."""
    a = view(spark, sf, "risk_grade")
    code = encoding.code_of(F.col("risk_grade"), ["low", "medium"])
    return a.select(ID, code.alias("code"))


@query
def e7_one_hot(spark, sf):
    """One column per category after imputing; unseen categories are all zeros."""
    df, state = coded(spark, sf)
    unseen = F.when(F.col(ID) % 11 == 0, "NEW").otherwise(F.col("product_type"))
    return df.select(ID, unseen.alias("product_type")).select(
        ID, *encoding.one_hot_columns(df, state, "product_type")
    )


@query
def e7_category_codes(spark, sf):
    """Codes of a column with many categories, kept as a table."""
    counts = encoding.category_counts(table(spark, sf, "customer"), ["c_name"])
    return encoding.code_table(counts, ["c_name"]).withColumnRenamed("column", "column_name")


@query
def e8_assembled_vector(spark, sf):
    """Assembled vectors as (slot, value) rows: numeric, boolean, ordinal, one-hot."""
    df = with_gaps(spark, sf, "loan_amount").drop("outcome")
    found = profile.SchemaProfile(
        numeric=["loan_amount"],
        boolean=["is_urgent"],
        ordinal=["risk_grade"],
        categorical=["product_type"],
    )
    order = {"risk_grade": ["low", "medium", "high"]}
    model = encoding.TableEncoder(found, order, scaled=True).fit(df)
    stages = encoding.vector_stages(spark, model.fitted)
    vectors = PipelineModel(stages).transform(model.transform(df))
    slots = vectors.select(ID, F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return rounded(slots, "value")


@query
def e9_engineering_report(spark, sf):
    return _report(spark, sf).withColumnRenamed("column", "column_name")


def _report(spark, sf):
    df = features_only(applicants(spark, sf))
    plan = features.plan_features(df, ID, dates=["application_date"])
    full = pin(features.add_features(df, plan, AS_OF), "engineered")
    found = profile.profile_schema(full, ID)[0]
    original = [c for c in df.columns if c != ID]
    rows = encoding.engineering_report(original, features.feature_names(plan), found, True)
    return encoding.report_frame(spark, rows)


@query
def e10_woe_table(spark, sf):
    df = with_gaps(spark, sf).withColumn("bad", (F.col("outcome") == "F").cast("int"))
    weights_of = woe.woe_table(df, ["product_type", "risk_grade"], "bad")
    return rounded(weights_of.withColumnsRenamed({"column": "column_name", "rows": "row_count"}), "woe")


@query
def e10_woe_encoded(spark, sf):
    """Labels joined to documents: quality by language, unseen languages weigh zero."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    train = docs.join(table(spark, sf, "labels"), "doc_id")
    model = woe.WeightOfEvidence(["lang", "source"], "quality").fit(train)
    shifted = docs.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "xx").otherwise(F.col("lang")))
    return rounded(model.transform(shifted), "lang", "source")


@query
def e11_encoding_counts(spark, sf):
    return encoding.encoding_counts(_report(spark, sf))


# --- splits -------------------------------------------------------------------------


@query
def t1_stratified_split(spark, sf):
    a = view(spark, sf, "outcome", "y")
    key = splitting.portable_key(ID, SEED)
    out = splitting.stratified_split(a, "y", ID, key=key)
    return out.select(ID, "y", "split")


@query
def t2_stratified_folds(spark, sf):
    a = class_weights_by_id(view(spark, sf, "outcome")).withColumnRenamed("code", "y")
    key = splitting.portable_key(ID, SEED)
    return splitting.stratified_folds(a, "y", ID, 5, key=key).select(ID, "y", "fold")


@query
def t4_fixed_sample(spark, sf):
    a = applicants(spark, sf).select(ID, "loan_amount")
    return splitting.fixed_sample(a, ID, key=splitting.portable_key(ID, SEED))


# --- ranking metrics ----------------------------------------------------------------


def _ranking(spark, sf, *columns):
    rounded_columns = rounded(
        ranking.ranking_metrics(scored_view(spark, sf), "y", "pd_score"), *columns
    )
    return rounded_columns.select(*columns)


@query
def g1_roc_auc(spark, sf):
    return _ranking(spark, sf, "roc_auc")


@query
def g2_pr_auc(spark, sf):
    return _ranking(spark, sf, "pr_auc")


@query
def g3_ks_statistic(spark, sf):
    return _ranking(spark, sf, "ks_statistic")


@query
def g4_gini(spark, sf):
    return _ranking(spark, sf, "gini")


@query
def g5_threshold_metrics(spark, sf):
    a = applicants(spark, sf).select("product_type", "y", "pd_score")
    out = thresholds.threshold_metrics(a, "y", "pd_score", 0.5, ["product_type"])
    return rounded(out, "precision", "recall", "f1").drop("threshold")


@query
def g6_pr_curve_auc(spark, sf):
    return _ranking(spark, sf, "pr_curve_auc")


@query
def g7_confusion_matrix(spark, sf):
    m = class_weights_by_id(applicants(spark, sf))
    out = thresholds.confusion_matrix(
        m.withColumn("predicted", top_class(F.col("probs"))), "code", "predicted"
    )
    return out.withColumnRenamed("rows", "row_count")


@query
def g8_best_threshold(spark, sf):
    return rounded(
        thresholds.best_threshold(scored_view(spark, sf), "y", "pd_score"), "threshold", "f1"
    )


@query
def g8_f1_by_threshold(spark, sf):
    a = applicants(spark, sf).select("risk_grade", "y", "pd_score")
    out = thresholds.f1_by_threshold(a, "y", "pd_score", ["risk_grade"])
    return rounded(out, "threshold", "f1")


@query
def g9_binary_metrics(spark, sf):
    out = scorecard.binary_metrics(scored_view(spark, sf), "y", "pd_score")
    return rounded(
        out,
        "roc_auc",
        "pr_auc",
        "ks_statistic",
        "gini",
        "precision",
        "recall",
        "f1",
        "threshold",
        "pr_curve_auc",
    )


@query
def g10_macro_metrics(spark, sf):
    m = class_weights_by_id(applicants(spark, sf))
    out = scorecard.macro_metrics(
        m.withColumn("predicted", top_class(F.col("probs"))), "code", "predicted"
    )
    return rounded(out, "accuracy", "precision", "recall", "f1")


@query
def g11_weighted_ovr_auc(spark, sf):
    m = class_weights_by_id(view(spark, sf, "outcome"))
    return rounded(scorecard.weighted_ovr_auc(m, "code", "probs"), "roc_auc")


@query
def g12_lift_gain(spark, sf):
    out = lift.lift_gain_table(scored_view(spark, sf), "y", "pd_score", ID)
    return rounded(out, "avg_pd", "gain", "lift")


@query
def g13_calibration_curve(spark, sf):
    out = lift.calibration_curve(scored_view(spark, sf), "y", "pd_score")
    return rounded(out.withColumnRenamed("rows", "row_count"), "mean_score", "default_rate")


@query
def g14_roc_points(spark, sf):
    out = ranking.roc_points(scored_view(spark, sf), "y", "pd_score")
    finite = F.when(F.col("threshold") < F.lit(float("inf")), F.col("threshold"))
    return rounded(out.withColumn("threshold", finite), "threshold", "fpr", "tpr")


@query
def g15_pr_points(spark, sf):
    out = ranking.pr_points(scored_view(spark, sf), "y", "pd_score")
    return rounded(out, "threshold", "precision", "recall")


@query
def g16_prediction_distribution(spark, sf):
    out = lift.prediction_distribution(scored_view(spark, sf), "y", "pd_score")
    return rounded(out.withColumnRenamed("rows", "row_count"), "low", "high")


@query
def g17_residuals(spark, sf):
    return rounded(lift.residuals(applicants(spark, sf), "y", "pd_score", ID), "score", "residual")


# --- model comparison over rule scores ----------------------------------------------

RULES = ("base", "squared", "income", "flat")


def rule_scores(spark, sf):
    """Four fixed scores per applicant with a fold: a comparison without any fitting."""
    a = view(spark, sf, "y", "pd_score", "loan_amount", "age")
    scores = {
        "base": F.col("pd_score"),
        "squared": F.col("pd_score") * F.col("pd_score"),
        "income": 1 - F.col("age") / 100,
        "flat": F.lit(0.5),
    }
    folded = splitting.stratified_folds(a, "y", ID, 5, key=splitting.portable_key(ID, SEED))
    wide = folded.select(ID, "y", "fold", *[s.alias(n) for n, s in scores.items()])
    return pin(wide.unpivot([ID, "y", "fold"], list(RULES), "model", "score"), "rules")


def rule_metrics(spark, sf):
    """Long (model, metric, value) rows of the rule scores."""
    rows = rule_scores(spark, sf)
    by_fold = ranking.ranking_metrics(rows, "y", "score", ["model", "fold"])
    cv = scorecard.fold_summary(by_fold, ["model"])
    whole = ranking.ranking_metrics(rows, "y", "score", ["model"]).drop("positives", "negatives")
    cut = thresholds.threshold_metrics(rows, "y", "score", 0.5, ["model"])
    wide = (
        cv.join(scorecard.brier(rows, "y", "score", ["model"]), "model")
        .join(whole, "model")
        .join(cut.drop("tp", "fp", "fn", "tn"), "model")
    )
    metrics = [c for c in wide.columns if c != "model"]
    # Rounded so that equal models stay equal whatever the order of summation.
    return pin(rounded(wide.unpivot(["model"], metrics, "metric", "value"), "value", digits=9), "metrics")


@query
def m5_balanced_weights(spark, sf):
    a = class_weights_by_id(view(spark, sf, "outcome"))
    return rounded(weights.with_weight(a.select(ID, "code"), "code", True), "weight")


@query
def m7_fold_metrics(spark, sf):
    by_fold = ranking.ranking_metrics(rule_scores(spark, sf), "y", "score", ["model", "fold"])
    out = scorecard.fold_summary(by_fold, ["model"])
    return rounded(out, "cv_roc_auc_mean", "cv_roc_auc_std", "cv_pr_auc_mean")


@query
def m8_brier(spark, sf):
    return rounded(scorecard.brier(rule_scores(spark, sf), "y", "score", ["model"]), "cv_test_mse")


@query
def m8_brier_multi(spark, sf):
    m = class_weights_by_id(applicants(spark, sf))
    return rounded(scorecard.brier_multi(m, "code", "probs"), "cv_test_mse")


@query
def m9_champion_by_auc(spark, sf):
    out = reporting.champion_row(rule_metrics(spark, sf), "cv_roc_auc_mean", RULES)
    return rounded(out, "value")


@query
def m9_champion_by_mse(spark, sf):
    return rounded(reporting.champion_row(rule_metrics(spark, sf), "cv_test_mse", RULES), "value")


@query
def m12_leaderboard(spark, sf):
    out = reporting.leaderboard(rule_metrics(spark, sf))
    return rounded(out, "cv_test_mse", "roc_auc", "pr_auc")


@query
def m13_comparison(spark, sf):
    return rounded(reporting.comparison_table(rule_metrics(spark, sf)), *reporting.BINARY_COLUMNS)


# --- training -----------------------------------------------------------------------

def training_rows(spark, sf):
    """All features, and a target they can explain: many late lines on a large loan."""
    a = pin(features_only(applicants(spark, sf), "pd_score"), "training")
    risk = F.col("pd_score") + 0.2 * F.col("late_lines") + F.col("loan_amount") / 1000000
    return a.withColumn("default", (risk > 0.95).cast("int")).drop("pd_score")


def config(*candidates: str, **options) -> training.TrainConfig:
    options.setdefault("parallelism", 8)
    return training.TrainConfig(id_col=ID, candidates=candidates, as_of=AS_OF, **options)


def drawn(name: str) -> dict:
    """The first parameter set of the random search."""
    return config(name).params(name)[0]


def _fold_state(spark, sf, *candidates, **options):
    prepared = training.prepare(training_rows(spark, sf), config(*candidates, **options))
    return prepared, training.fit_states(prepared)


def _candidate(name: str) -> Query:
    """Fit on the training rows, score the test rows."""

    def run(spark, sf):
        prepared = training.prepare(training_rows(spark, sf), config(name))
        fitted = training.fit_rows(prepared, prepared.train)
        model = training.fit_model(prepared, name, drawn(name), prepared.train, fitted)
        scored = training.predictor(model)(prepared.test)
        return scored.select(ID, "default", F.col("probs")[1].alias("probability_default"))

    run.__name__ = name
    return run


QUERIES["m1_logistic_regression"] = _candidate("logistic_regression")
QUERIES["m2_ridge_logistic_regression"] = _candidate("ridge_logistic_regression")
QUERIES["m3_random_forest"] = _candidate("random_forest")
QUERIES["m4_boosted_trees"] = _candidate("xgboost")


@query
def m4_boosted_trees_multiclass(spark, sf):
    """Three classes, one tree each a round; probabilities sum to one."""
    a = training_rows(spark, sf)
    third = F.when(F.col("late_lines") >= 3, 2).otherwise(F.col("default"))
    prepared = training.prepare(a.withColumn("default", third), config("xgboost"))
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, "xgboost", drawn("xgboost"), prepared.train, fitted)
    return training.predictor(model)(prepared.test).select(ID, "default", "probs")


@query
def t3_out_of_fold(spark, sf):
    prepared, states = _fold_state(spark, sf, "logistic_regression")
    oof = training.out_of_fold(
        prepared, "logistic_regression", [drawn("logistic_regression")], states
    )
    return oof.select(ID, "fold", "default", F.col("probs")[1].alias("probability_default"))


@query
def m6_random_search(spark, sf):
    """Mean cross-validated score of every parameter set drawn."""
    prepared, states = _fold_state(spark, sf, "logistic_regression")
    params = prepared.config.params("logistic_regression")
    oof = training.out_of_fold(prepared, "logistic_regression", params, states)
    return training.fold_scores(oof, 2).groupBy("param_set").agg(
        F.avg("roc_auc").alias("mean_score")
    )


@query
def g18_honest_threshold(spark, sf):
    """Cutoff learned out of fold, applied to the test rows as it is."""
    prepared, states = _fold_state(spark, sf, "ridge_logistic_regression")
    metrics, _, scores = training.run_candidate(prepared, "ridge_logistic_regression", states)
    flat = scores.select("default", F.col("probs")[1].alias("pd"))
    return thresholds.threshold_metrics(flat, "default", "pd", metrics["threshold"])


@query
def g18_rule_threshold(spark, sf):
    """The same for a fixed score: cutoff from the training part, metrics on the test part."""
    a = view(spark, sf, "y", "pd_score", "age")
    riskier = a.withColumn("score", F.col("pd_score") * F.col("age") / 80)
    parts = splitting.stratified_split(riskier, "y", ID, key=splitting.portable_key(ID, SEED))
    learned = thresholds.best_threshold(parts.where("split = 'train'"), "y", "score").first()
    held = thresholds.threshold_metrics(
        parts.where("split = 'test'"), "y", "score", learned["threshold"]
    )
    return rounded(held, "threshold", "precision", "recall", "f1")


def _experiment(spark, sf, *candidates, progress=None, **options):
    return training.train_experiment(
        training_rows(spark, sf), config(*candidates, **options), progress=progress, explained=False
    )


@query
def m10_train_experiment(spark, sf):
    """All candidates compared, one drawn set each; the long metrics table."""
    result = _experiment(spark, sf, *training.CANDIDATES, iterations=1)
    return sinks.metrics_frame(spark, result.comparison).withColumn(
        "champion", F.lit(result.champion)
    )


@query
def m11_progress(spark, sf):
    """One row per finished candidate; the time left reaches zero."""
    steps = []
    _experiment(
        spark,
        sf,
        "logistic_regression",
        "ridge_logistic_regression",
        progress=lambda done, total, seconds: steps.append(
            (done, total, training.seconds_left(done, total, seconds) > 0)
        ),
    )
    return small_table(spark, steps, "done int, total int, time_left boolean")


@query
def m14_target_definition(spark, sf):
    """Description of the target with the sizes of both parts."""
    prepared = training.prepare(training_rows(spark, sf), config("logistic_regression"))
    text = training.target_definition("default_flag", prepared.num_classes, None)
    return (
        prepared.train.agg(F.count(F.lit(1)).alias("n_train"))
        .withColumn("n_test", F.lit(prepared.test.count()).cast("bigint"))
        .withColumn("target_definition", F.lit(text))
        .withColumn("features", F.lit(len(prepared.features)))
    )


def _bundle(spark, sf, name="logistic_regression"):
    prepared = training.prepare(training_rows(spark, sf), config(name))
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, name, drawn(name), prepared.train, fitted)
    kinds = {c: prepared.train.schema[c].dataType.simpleString() for c in prepared.features}
    bundle = bundles.ModelBundle(
        model, name, "applicants", kinds, "default=1", threshold=0.5, num_classes=2
    )
    return prepared, bundle


@query
def s6_bundle_round_trip(spark, sf):
    """Save, load, score: difference to the model in memory."""
    path = scratch_path(spark, "bundle")
    prepared, bundle = _bundle(spark, sf)
    bundles.save_model_bundle(spark, bundle, path)
    loaded = bundles.load_model_bundle(spark, path)
    before = scoring.score(prepared.test, bundle).select(ID, "probability_default")
    after = scoring.score(prepared.test, loaded).select(ID, F.col("probability_default").alias("p"))
    gap = F.max(F.abs(F.col("p") - F.col("probability_default")))
    return before.join(after, ID).agg(F.count(F.lit(1)).alias("row_count"), gap.alias("largest_gap"))


@query
def d4_score_applicants(spark, sf):
    """Loosely typed applicants with an extra and without a known column."""
    _, bundle = _bundle(spark, sf)
    loose = applicants(spark, sf).select(
        ID,
        F.col("loan_amount").cast("string").alias("loan_amount"),
        F.col("income").cast("string").alias("income"),
        F.when(F.col(ID) % 5 == 0, "n/a").otherwise(F.col("age").cast("string")).alias("age"),
        "risk_grade",
        "product_type",
        F.lit("ignored").alias("extra"),
    )
    return scoring.score(loose, bundle)


@query
def d4_score_stream(spark, sf):
    """Events as a file stream, scored by a model trained on event values."""
    events = table(spark, sf, "events")
    rows = events.select(
        F.col("event_id").alias(ID),
        "event_type",
        F.col("props").cast("string").alias("props"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("value") > 10).cast("int").alias("default"),
    ).drop("props")
    prepared = training.prepare(rows, config("logistic_regression"))
    fitted = training.fit_rows(prepared, prepared.train)
    params = drawn("logistic_regression")
    model = training.fit_model(prepared, "logistic_regression", params, prepared.train, fitted)
    kinds = {c: prepared.train.schema[c].dataType.simpleString() for c in prepared.features}
    bundle = bundles.ModelBundle(model, "logistic_regression", "events", kinds, "value > 10", 0.5)
    stream = read_applicant_stream(spark, sf, events.schema, "events.parquet").select(
        F.col("event_id").alias(ID),
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
    )
    sink, state_dir = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    score_stream(stream, bundle, sink, state_dir).awaitTermination()
    return spark.read.parquet(sink)


class _ClassesById:
    """Stands in for a fitted model: class probabilities that follow from the id."""

    def transform(self, df: DataFrame) -> DataFrame:
        weights = [(1 + F.col(ID) % m).cast("double") for m in (7, 5, 3)]
        total = weights[0] + weights[1] + weights[2]
        return df.withColumn("probs", F.array(*[w / total for w in weights]))


def closed_form_bundle() -> bundles.ModelBundle:
    kinds = {ID: "bigint", "outcome": "string"}
    names = {"0": "F", "1": "O", "2": "P"}
    return bundles.ModelBundle(
        _ClassesById(), "by id", "applicants", kinds, "outcome", class_names=names, num_classes=3
    )


@query
def d5_score_classes(spark, sf):
    """Label and confidence of the most probable of three classes."""
    a = applicants(spark, sf).select(ID, "outcome")
    scored = scoring.score_classes(a, closed_form_bundle())
    return rounded(scored.select(ID, "predicted_label", "confidence"), "confidence")


@query
def d5_label_probabilities(spark, sf):
    a = applicants(spark, sf).select(ID, "outcome")
    return rounded(scoring.class_probabilities(a, closed_form_bundle(), ID), "probability")


# --- training and scoring that SQL can follow ------------------------------------------

# One tree of one split, or one free weight per category: the fitted probability of a row
# is then a rate of the rows it was fitted on.
RATES = {
    "logistic_regression": {"C": 1e9, "class_weight": None},
    "ridge_logistic_regression": {"C": 1e9, "class_weight": "balanced"},
    "random_forest": {
        "n_estimators": 1,
        "max_depth": 1,
        "min_samples_leaf": 1,
        "class_weight": None,
        "bootstrap": False,
    },
    "xgboost": {
        "n_estimators": 1,
        "max_depth": 1,
        "learning_rate": 0.1,
        "subsample": 1.0,
        "colsample": 1.0,
    },
}


def mostly(flag: Column) -> Column:
    """A target that is mostly 1 with the flag and mostly 0 without, so a split is kept."""
    with_flag, without = (F.col(ID) % 4 > 0).cast("int"), (F.col(ID) % 5 == 0).cast("int")
    return F.when(flag == "Y", with_flag).otherwise(without)


def rate_rows(spark, sf, feature):
    rows = view(spark, sf, "is_urgent", "product_type")
    return rows.select(ID, feature, mostly(F.col("is_urgent")).alias("default"))


def rate_config(*candidates: str, **options) -> training.TrainConfig:
    options.setdefault("space", {c: [RATES[c]] for c in candidates})
    return config(*candidates, portable=True, **options)


def _rates(name: str, feature: str, digits: int) -> Query:
    """A model whose probabilities are rates, fitted on the training rows."""

    def run(spark, sf):
        prepared = training.prepare(rate_rows(spark, sf, feature), rate_config(name))
        fitted = training.fit_rows(prepared, prepared.train)
        model = training.fit_model(prepared, name, RATES[name], prepared.train, fitted)
        scored = training.predictor(model)(prepared.test)
        return rounded(scored.select(ID, F.col("probs")[1].alias("pd")), "pd", digits=digits)

    return run


QUERIES["m1_category_rates"] = _rates("logistic_regression", "product_type", 3)
QUERIES["m2_balanced_rates"] = _rates("ridge_logistic_regression", "product_type", 3)
QUERIES["m3_split_rates"] = _rates("random_forest", "is_urgent", 9)
QUERIES["m4_split_odds"] = _rates("xgboost", "is_urgent", 9)


@query
def m4_split_classes(spark, sf):
    """One round for three classes: a leaf per class and side of the split."""
    third = F.when((F.col("is_urgent") == "Y") & (F.col(ID) % 3 == 0), 2)
    rows = view(spark, sf, "is_urgent").select(
        ID, "is_urgent", third.otherwise(mostly(F.col("is_urgent"))).alias("default")
    )
    prepared = training.prepare(rows, rate_config("xgboost"))
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, "xgboost", RATES["xgboost"], prepared.train, fitted)
    probs = [F.col("probs")[k].alias(f"p{k}") for k in range(3)]
    scored = training.predictor(model)(prepared.test).select(ID, *probs)
    return rounded(scored, "p0", "p1", "p2", digits=9)


@query
def t3_rates_out_of_fold(spark, sf):
    """Each row gets the rate of the other folds."""
    rows, settings = rate_rows(spark, sf, "is_urgent"), rate_config("random_forest")
    prepared = training.prepare(rows, settings)
    states = training.fit_states(prepared)
    oof = training.out_of_fold(prepared, "random_forest", [RATES["random_forest"]], states)
    return rounded(oof.select(ID, "fold", "default", F.col("probs")[1].alias("pd")), "pd", digits=9)


@query
def m6_rates_search(spark, sf):
    """A split against no split: mean score over the folds."""
    rows, settings = rate_rows(spark, sf, "is_urgent"), rate_config("random_forest")
    prepared = training.prepare(rows, settings)
    sets = [RATES["random_forest"], {**RATES["random_forest"], "min_samples_leaf": 10**9}]
    oof = training.out_of_fold(prepared, "random_forest", sets, training.fit_states(prepared))
    scores = training.fold_scores(oof, 2).groupBy("param_set").agg(F.avg("roc_auc").alias("mean_score"))
    return rounded(scores, "mean_score", digits=9)


def _rate_experiment(spark, sf, **options):
    settings = rate_config("random_forest", "xgboost")
    return training.train_experiment(rate_rows(spark, sf, "is_urgent"), settings, "applicants", **options)


@query
def m10_rates_experiment(spark, sf):
    """Two candidates that rank alike: the first wins; errors are those out of fold."""
    result = _rate_experiment(spark, sf, explained=False)
    rows = [
        (name, float(m["cv_roc_auc_mean"]), float(m["cv_test_mse"]), name == result.champion)
        for name, m in result.comparison.items()
    ]
    frame = small_table(
        spark, rows, "model string, cv_roc_auc_mean double, cv_test_mse double, champion boolean"
    )
    return rounded(frame, "cv_roc_auc_mean", "cv_test_mse", digits=9)


@query
def m10_analyzed(spark, sf):
    """The whole way from a text target to compared models: errors out of fold."""
    rows = rate_rows(spark, sf, "is_urgent")
    named = rows.withColumn("outcome", F.when(F.col("default") == 1, "bad").otherwise("good")).drop("default")
    settings = rate_config("random_forest", "xgboost")
    result = analyze.analyze(pin(named, "named"), "outcome", settings, positive="bad", folds=5)
    return rounded(result.leaderboard.select("model", "cv_test_mse"), "cv_test_mse", digits=9)


@query
def p9_previewed(spark, sf):
    """Target candidates that the preview of the whole table shows."""
    found = analyze.preview(profiled(spark, sf), ID).candidates
    return found.withColumnRenamed("column", "column_name")


@query
def m11_rates_progress(spark, sf):
    """One call per candidate; nothing is left after the last one."""
    steps = []
    _rate_experiment(
        spark,
        sf,
        explained=False,
        progress=lambda done, total, seconds: steps.append(
            (done, total, training.seconds_left(done, total, seconds) > 0)
        ),
    )
    return small_table(spark, steps, "done int, total int, time_left boolean")


@query
def m14_run_report(spark, sf):
    """Countable parts of what is kept beside a model, read back from a saved one."""
    path = scratch_path(spark, "reported")
    bundles.save_model_bundle(spark, _rate_experiment(spark, sf).bundle, path)
    kept = bundles.load_model_bundle(spark, path).report
    row = (
        kept["dataset"],
        kept["champion_model"],
        kept["selection_metric"],
        kept["cv_folds"],
        kept["n_train"],
        kept["n_test"],
        ",".join(kept["top_features"]),
        ",".join(kept["feature_engineering"]["original"]),
    )
    return small_table(
        spark,
        [row],
        "dataset string, champion string, selection_metric string, cv_folds int, n_train bigint,"
        " n_test bigint, top_features string, original string",
    )


def _rate_bundle(prepared, feature_types):
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(
        prepared, "random_forest", RATES["random_forest"], prepared.train, fitted
    )
    return bundles.ModelBundle(model, "random_forest", "rates", feature_types, "default=1", 0.5)


@query
def d4_rates_scored(spark, sf):
    """All applicants scored and decided, with an extra column and missing values as NaN."""
    rows = rate_rows(spark, sf, "is_urgent")
    prepared = training.prepare(rows, rate_config("random_forest"))
    bundle = _rate_bundle(prepared, {"is_urgent": "string"})
    loose = rows.select(
        ID,
        F.when(F.col(ID) % 10 > 0, F.col("is_urgent")).alias("is_urgent"),
        F.lit(float("nan")).alias("extra"),
    )
    scored = scoring.score(loose, bundle).drop("extra", "threshold", "is_urgent")
    return rounded(scored, "probability_default", digits=9)


@query
def d4_rates_streamed(spark, sf):
    """The same for events that arrive as a file stream."""
    events = table(spark, sf, "events")
    flag = F.when(F.col("event_id") % 3 == 0, "Y").otherwise("N").alias("flag")
    rows = events.select(F.col("event_id").alias(ID), flag)
    rows = rows.withColumn("default", mostly(F.col("flag")))
    bundle = _rate_bundle(training.prepare(rows, rate_config("random_forest")), {"flag": "string"})
    stream = read_applicant_stream(spark, sf, events.schema, "events.parquet").select(
        F.col("event_id").alias(ID), flag
    )
    sink, state_dir = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    score_stream(stream, bundle, sink, state_dir).awaitTermination()
    scored = spark.read.parquet(sink).select(ID, "probability_default", "decision")
    return rounded(scored, "probability_default", digits=9)


def _rule_importance(spark, sf):
    """Permutation importance of the closed-form model, rows paired by plain arithmetic."""
    a = view(spark, sf, "y", *RULE_FEATURES)
    key = splitting.portable_key(ID, SEED)
    return explain.permutation_importance(a, rule_model, "y", list(RULE_FEATURES), ID, key=key)


@query
def x1_rule_importance(spark, sf):
    return rounded(_rule_importance(spark, sf), "importance_mean", "importance_std")


@query
def x3_rule_total(spark, sf):
    """Shapley values of a row add up to its prediction less the mean of the sample."""
    a = view(spark, sf, *RULE_FEATURES)
    key = splitting.portable_key(ID, SEED)
    values = explain.shapley_values(a, rule_model, list(RULE_FEATURES), ID, key=key)
    return rounded(values.groupBy(ID).agg(F.sum("shapley").alias("total")), "total")


@query
def s6_saved_codes(spark, sf):
    """A column of very many categories: the saved encoder knows them all by itself."""
    a = view(spark, sf, "product_type").select(ID, F.col(ID).cast("string").alias("label"))
    state = encoding.fit_encoder(a, profile.SchemaProfile(categorical=["label"]), {})
    path = scratch_path(spark, "encoder")
    encoding.TableEncoderModel(state=state.to_json(), scaled=False).write().overwrite().save(path)
    unseen = a.withColumn("label", F.when(F.col(ID) % 5 == 0, "none").otherwise(F.col("label")))
    coded = encoding.TableEncoderModel.load(path).transform(unseen)
    return coded.select(ID, F.col("cat__label").cast("bigint").alias("code"))


# --- NaN is a missing value ----------------------------------------------------------


def nan_view(spark, sf):
    """The applicant view with NaN instead of NULL in one column and in place of zeros."""
    income = F.coalesce(F.col("income"), F.lit(float("nan"))).alias("income")
    late = F.when(F.col(ID) % 7 == 0, float("nan")).otherwise(F.col("late_lines")).alias("late_lines")
    return view(spark, sf, "income", "late_lines").select(ID, income, late)


@query
def p7_nan_profile(spark, sf):
    return rounded(profile.missing_summary(nan_view(spark, sf)), "missing_rate")


@query
def e1_nan_median(spark, sf):
    found = encoding.medians(nan_view(spark, sf), ["income", "late_lines"])
    return rounded(small_table(spark, sorted(found.items()), "feature string, median double"), "median")


@query
def f9_nan_delinquency(spark, sf):
    counted = features.delinquency_count([F.col("late_lines"), F.col("income")])
    return nan_view(spark, sf).select(ID, counted.alias("delinquency_count"))


@query
def d6_nan_text(spark, sf):
    """The text "nan" is a missing number (shown as -1)."""
    text = F.when(F.col(ID) % 4 == 0, "nan").when(F.col(ID) % 4 == 1, "NaN").otherwise("2.5")
    typed = decisions.loose_cast(view(spark, sf, "y").select(ID, text.alias("x")), {"x": "double"})
    return typed.select(ID, F.coalesce("x", F.lit(-1.0)).alias("x"))


@query
def p4_date_layouts(spark, sf):
    """One day in many layouts, all read back."""
    a = view(spark, sf, "application_date")
    day = F.date_trunc("day", "application_date")
    shapes = [F.date_format(day, layout) for layout in WRITTEN_DATES]
    text = F.element_at(F.array(*shapes), (F.col(ID) % len(shapes) + 1).cast("int"))
    return a.select(ID, F.to_date(parse_mixed(text)).cast("string").alias("day"))


WRITTEN_DATES = (
    "yyyy-MM-dd",
    "M/d/yy",
    "d-MMM-yyyy",
    "yyyy.MM.dd",
    "MMM d yyyy",
    "MM/dd/yyyy hh:mm:ss a",
    "EEE, d MMM yyyy",
    "yyyy/MM/dd HH:mm:ss.S",
)


# --- explanations -------------------------------------------------------------------


@query
def x1_permutation_importance(spark, sf):
    prepared, bundle = _bundle(spark, sf)
    return explain.permutation_importance(
        prepared.test, training.predictor(bundle.model), "default", prepared.features, ID
    )


@query
def x2_partial_dependence(spark, sf):
    prepared, bundle = _bundle(spark, sf)
    return explain.partial_dependence(
        prepared.test, training.predictor(bundle.model), ["loan_amount", "risk_grade", "late_lines"]
    )


RULE_FEATURES = ("loan_amount", "late_lines", "age")


def rule_model(df):
    """A model known in closed form, for checking explanations without any fitting."""
    p = 0.1 + F.col("loan_amount") / 1000000 + 0.05 * F.col("late_lines") * F.col("age") / 80
    return df.withColumn("probs", F.array(1 - p, p))


@query
def x2_rule_dependence(spark, sf):
    """Partial dependence of the closed-form model, over all applicants."""
    a = view(spark, sf, "loan_amount", "late_lines", "age")
    out = explain.partial_dependence(a, rule_model, ["loan_amount", "late_lines", "age"])
    return rounded(out, "grid_value", "average")


@query
def x3_shapley_summary(spark, sf):
    prepared, bundle = _bundle(spark, sf)
    return explain.shapley_summary(training.encoded_shapley(bundle.model, prepared.test, ID))


@query
def x4_top_importance(spark, sf):
    top = explain.top_importance(_rule_importance(spark, sf), 2)
    return rounded(top.drop("importance_std"), "importance_mean")


@query
def x5_feature_report(spark, sf):
    df = features_only(applicants(spark, sf))
    missing = profile.top_missing(df, [c for c in df.columns if c != ID])
    out = reporting.feature_report(_report(spark, sf), missing, _rule_importance(spark, sf))
    return rounded(out, "value")


# --- decisions ----------------------------------------------------------------------


@query
def d1_risk_band(spark, sf):
    a = applicants(spark, sf)
    # Push some scores to the edges and out of range.
    pd = F.when(F.col(ID) % 50 == 0, 1.0).when(F.col(ID) % 50 == 1, -0.1).otherwise(F.col("pd_score"))
    return a.select(ID, decisions.risk_band(pd).alias("risk_band"))


@query
def d2_business_decision(spark, sf):
    a = applicants(spark, sf)
    pd = F.when(F.col(ID) % 50 == 0, 0.35).when(F.col(ID) % 50 == 1, 0.55).otherwise(F.col("pd_score"))
    return a.select(ID, decisions.business_decision(pd).alias("decision"))


@query
def d3_prediction_confidence(spark, sf):
    a = applicants(spark, sf)
    return a.select(ID, decisions.decision_confidence(F.col("pd_score")).alias("confidence"))


@query
def d6_loose_input(spark, sf):
    """Text input brought to fitted types; what cannot be read is NULL (shown as -1)."""
    a = applicants(spark, sf).select(
        ID,
        F.when(F.col(ID) % 4 == 0, "unknown").otherwise(F.col("age").cast("string")).alias("age"),
        F.col("pd_score").cast("string").alias("pd_score"),
    )
    typed = decisions.loose_cast(a, {"age": "bigint", "pd_score": "double", "income": "double"})
    return rounded(typed.withColumn("age", F.coalesce("age", F.lit(-1))), "pd_score")
