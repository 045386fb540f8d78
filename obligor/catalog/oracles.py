"""DuckDB side: the SQL each query is checked against."""

from __future__ import annotations

from itertools import islice

from obligor.operators.explain import candidate_maps

ID = "application_id"

APPLICANTS = """
l AS (
  SELECT l_orderkey, count(*) AS payment_lines,
         count(*) FILTER (WHERE l_returnflag = 'R') AS late_lines
  FROM lineitem GROUP BY l_orderkey),
n AS (SELECT o_custkey AS ck, count(*) AS existing_loans FROM orders GROUP BY o_custkey),
a AS (
  SELECT o.o_orderkey AS application_id,
         o.o_totalprice AS loan_amount,
         1 + o.o_orderkey % 60 AS duration_months,
         CASE WHEN c.c_acctbal >= 0 THEN c.c_acctbal END AS income,
         abs(c.c_acctbal) / 2 AS savings,
         18 + o.o_custkey % 60 AS age,
         CAST(o.o_custkey % 400 AS DOUBLE) / 10 AS employment_years,
         n.existing_loans AS existing_loans,
         abs(c.c_acctbal) AS revolving_balance,
         5000 + 100 * (o.o_custkey % 50) AS credit_limit,
         CAST(coalesce(l.late_lines, 0) AS BIGINT) AS late_lines,
         l.payment_lines AS payment_lines,
         CASE WHEN o.o_totalprice < 150000 THEN 'low' WHEN o.o_totalprice < 350000 THEN 'medium'
              ELSE 'high' END AS risk_grade,
         c.c_mktsegment AS product_type,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS is_urgent,
         o.o_orderdate AS application_date,
         1 AS constant,
         CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
         o.o_orderstatus AS outcome,
         floor((0.5::DOUBLE * ((o.o_orderkey * 37) % 101) / 100
                + 0.5::DOUBLE * least(o.o_totalprice / 500000, 1.0::DOUBLE)) * 10000::DOUBLE
               + 0.5::DOUBLE) / 10000::DOUBLE AS pd_score
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN n ON n.ck = o.o_custkey
  LEFT JOIN l ON l.l_orderkey = o.o_orderkey)"""


def on_applicants(body: str, *tables: str) -> str:
    """A statement over the applicant view ``a`` and further common tables."""
    return "WITH " + ",\n".join([APPLICANTS, *tables]) + "\n" + body


ORACLES: dict[str, str] = {}

BAND = (
    "CASE WHEN {p} >= 0 AND {p} < 0.2 THEN 'Low' WHEN {p} >= 0.2 AND {p} < 0.35 THEN 'Medium'"
    " WHEN {p} >= 0.35 AND {p} < 0.55 THEN 'High' ELSE 'Very High' END"
)
DECISION = (
    "CASE WHEN {p} <= 0.35 THEN 'Approve' WHEN {p} <= 0.55 THEN 'Manual Review' ELSE 'Reject' END"
)


def r6(expression: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {alias}"


ORACLES["decision_mix"] = on_applicants(
    f"""SELECT product_type, {BAND.format(p='pd_score')} AS risk_band,
       {DECISION.format(p='pd_score')} AS decision, count(*) AS applications,
       {r6('avg(pd_score)', 'avg_pd')},
       {r6('avg(CASE WHEN income IS NOT NULL THEN loan_amount / greatest(abs(income), 1) END)',
           'avg_debt_to_income')},
       {r6('sum(loan_amount)', 'exposure', 2)}
FROM a GROUP BY 1, 2, 3"""
)

# --- sources and sinks --------------------------------------------------------------

ORACLES["s1_dataset_registry"] = """
SELECT 'orders_status' AS dataset, o_orderstatus AS target_value, count(*) AS row_count
FROM orders GROUP BY 2
UNION ALL
SELECT 'label_quality', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY 2"""

ORACLES["s2_csv_scan"] = f"""
SELECT c_mktsegment, count(*) AS customers, {r6('sum(c_acctbal)', 'balance', 2)},
       max(c_name) AS last_name
FROM customer GROUP BY 1"""

ORACLES["s3_load_dataset"] = """
SELECT o_orderkey, o_totalprice, o_orderpriority,
       CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS INTEGER)
         AS "default"
FROM orders"""

BINNED = """
ranked AS (
  SELECT y, pd_score, row_number() OVER (ORDER BY pd_score DESC, application_id) - 1 AS i,
         count(*) OVER () AS n
  FROM a),
bucketed AS (
  SELECT *, greatest(1, (SELECT count(*) FROM range(0, 11) t(k)
                         WHERE (k::DOUBLE / 10) * (n - 1) < i)) AS bucket
  FROM ranked)"""

ORACLES["g12_lift_gain"] = on_applicants(
    f"""SELECT CAST(bucket AS INTEGER) AS bucket, applicants, CAST(defaults AS BIGINT) AS defaults,
       {r6('avg_pd', 'avg_pd')},
       CAST(sum(defaults) OVER w AS BIGINT) AS cumulative_defaults,
       {r6('sum(defaults) OVER w / greatest((SELECT sum(y) FROM a), 1)', 'gain')},
       {r6('avg_pd / (SELECT avg(y) FROM a)', 'lift')}
FROM (SELECT bucket, count(*) AS applicants, sum(y) AS defaults, avg(pd_score) AS avg_pd
      FROM bucketed GROUP BY bucket)
WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    BINNED,
)
ORACLES["s4_table_sink"] = ORACLES["g12_lift_gain"].replace(
    "CAST(bucket AS INTEGER)", "CAST(bucket AS BIGINT)"
)

ORACLES["s7_policy_bands"] = on_applicants(
    f"""SELECT CAST(band_order AS INTEGER) AS band_order, risk_band, min_pd, max_pd, applications,
       {r6('mean_pd', 'avg_pd')}
FROM (VALUES (0, 'Low', 0.0::DOUBLE, 0.2::DOUBLE), (1, 'Medium', 0.2, 0.35), (2, 'High', 0.35, 0.55),
             (3, 'Very High', 0.55, 1.0)) b(band_order, risk_band, min_pd, max_pd)
JOIN (SELECT {BAND.format(p='pd_score')} AS risk_band, count(*) AS applications,
             avg(pd_score) AS mean_pd FROM a GROUP BY 1) USING (risk_band)"""
)

# --- names, types, profiles ---------------------------------------------------------

NORMALIZED_URL = "trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_')"
ORACLES["p1_normalize_names"] = f"SELECT page_id, {NORMALIZED_URL} AS normalized_name FROM pages"
ORACLES["p2_matches_any"] = f"""
SELECT page_id, regexp_matches({NORMALIZED_URL}, 'page')
             OR regexp_matches({NORMALIZED_URL}, '^https_m')
             OR regexp_matches({NORMALIZED_URL}, 'ref_x$') AS matched
FROM pages"""

_ROLES = (
    ("loan_amount", "loan_amount"),
    ("duration", "duration_months"),
    ("income", "income"),
    ("savings", "savings"),
    ("age", "age"),
    ("employment", "employment_years"),
    ("existing_loans", "existing_loans"),
    ("revolving_balance", "revolving_balance"),
    ("credit_limit", "credit_limit"),
    ("delinquency", "late_lines"),
    ("payment", "payment_lines"),
)
ORACLES["p3_semantic_columns"] = on_applicants(
    "\nUNION ALL ".join(
        f"SELECT '{role}' AS role, '{c}' AS column_name, {r6(f'avg({c})', 'mean', 4)} FROM a"
        for role, c in _ROLES
    )
)

TEXTS = """
t AS (
  SELECT o_orderkey AS id,
         CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
              WHEN 2 THEN strftime(o_orderdate, '%Y%m%d')
              WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
              ELSE strftime(o_orderdate, '%-d %b %Y') END AS signed_on,
         CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END
           AS half_known,
         CASE WHEN o_orderkey % 7 > 2 THEN strftime(o_orderdate, '%Y') END AS year_text,
         o_orderpriority AS priority
  FROM orders),
u AS (
  SELECT 'signed_on' AS column_name, id, signed_on AS v FROM t
  UNION ALL SELECT 'half_known', id, half_known FROM t
  UNION ALL SELECT 'year_text', id, year_text FROM t
  UNION ALL SELECT 'priority', id, priority FROM t),
heads AS (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY id) AS rn FROM u WHERE v IS NOT NULL)"""
ORACLES["p4_date_columns"] = f"""WITH {TEXTS}
SELECT column_name, count(*) AS sampled, count(d) AS parsed, count(d) / count(*) >= 0.8 AS is_date
FROM (SELECT column_name, try_strptime(v, ['%Y-%m-%d', '%m/%d/%Y', '%Y%m%d', '%Y-%m-%d %H:%M:%S',
                                           '%d %b %Y', '%Y']) AS d
      FROM heads WHERE rn <= 100)
GROUP BY 1"""

ORACLES["p5_ordinal_values"] = on_applicants(
    """SELECT CAST(row_number() OVER (ORDER BY spot) - 1 AS INTEGER) AS position, label
FROM (SELECT DISTINCT lower(trim(spelled)) AS label
      FROM (SELECT CASE WHEN application_id % 3 = 0 THEN upper(risk_grade[1]) || risk_grade[2:]
                        ELSE ' ' || upper(risk_grade) END AS spelled FROM a)) v
JOIN (VALUES ('none', 0), ('low', 1), ('medium', 2), ('high', 3), ('very high', 4)) s(name, spot)
  ON s.name = v.label"""
)

ORACLES["p6_ordinal_mappings"] = on_applicants(
    """SELECT 'risk_grade' AS column_name, risk_grade AS label,
       CAST(CASE risk_grade WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS position,
       count(*) AS row_count
FROM a WHERE (SELECT count(DISTINCT risk_grade) FROM a) BETWEEN 2 AND 8 GROUP BY 2
UNION ALL
SELECT 'outcome', outcome,
       CAST(CASE outcome WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS INTEGER), count(*)
FROM a GROUP BY 2"""
)

_PROFILED = (
    ("loan_amount", "number"),
    ("duration_months", "number"),
    ("income", "number"),
    ("risk_grade", "text"),
    ("product_type", "text"),
    ("is_urgent", "text"),
    ("application_date", "date"),
    ("constant", "number"),
    ("y", "number"),
    ("mostly_missing", "number"),
)


def _flag(column: str, kind: str) -> str:
    if kind == "number":
        return f"bool_and({column} IN (0, 1))"
    if kind == "text":
        return f"bool_and({column} IN ('0', '1', 'Y', 'N', 'yes', 'no'))"
    return "false"


def _ordinal(column: str, kind: str) -> str:
    if kind == "text" and "risk" in column:
        return f"bool_and({column} IN ('none', 'low', 'medium', 'high', 'very high'))"
    return "false"


PROFILED = (
    "b AS (SELECT *, CASE WHEN application_id % 100 = 0 THEN loan_amount END AS mostly_missing FROM a)",
    "facts AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS kind,"
        f" avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing_rate,"
        f" count(DISTINCT {c}) AS unique_values, {_flag(c, k)} AS flag, {_ordinal(c, k)} AS ordered"
        " FROM b"
        for c, k in _PROFILED
    )
    + ")",
    """typed AS (
  SELECT *, CASE WHEN missing_rate >= 0.98 OR unique_values <= 1 THEN 'dropped'
                 WHEN kind = 'date' THEN 'date' WHEN flag THEN 'boolean'
                 WHEN ordered THEN 'ordinal' WHEN kind = 'number' THEN 'numeric'
                 ELSE 'categorical' END AS role
  FROM facts)""",
)
ORACLES["p7_schema_profile"] = on_applicants(
    f"SELECT column_name, role, {r6('missing_rate', 'missing_rate')} FROM typed", *PROFILED
)
ORACLES["p8_detect_columns"] = on_applicants(
    "SELECT column_name, role AS detected_type, unique_values FROM typed", *PROFILED
)
ORACLES["p12_missing_summary"] = on_applicants(
    f"SELECT column_name, {r6('missing_rate', 'missing_rate')} FROM typed", *PROFILED
)
ORACLES["p12_top_missing"] = on_applicants(
    f"""SELECT column_name, {r6('missing_rate', 'missing_rate')}
FROM (SELECT * FROM typed ORDER BY missing_rate DESC, column_name LIMIT 20) WHERE missing_rate > 0""",
    *PROFILED,
)
ORACLES["p9_previewed"] = ORACLES["p9_target_candidates"] = on_applicants(
    """SELECT column_name, CAST(len(v) AS BIGINT) AS classes,
       CASE WHEN v = ['0', '1'] THEN 'already 0/1 (assumes 1 = positive/default outcome)'
            WHEN len(v) = 2 THEN '''' || v[1] || ''' / ''' || v[2] || ''' — you''ll choose which is positive'
            ELSE array_to_string(list_transform(range(1, len(v) + 1),
                   lambda i: '''' || v[i] || ''' → ' || (i - 1)::VARCHAR), ', ') END AS encoding
FROM lists WHERE len(v) BETWEEN 2 AND 20""",
    PROFILED[0],
    "lists AS ("
    + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, list_sort(list(DISTINCT CAST({c} AS VARCHAR))"
        f" FILTER (WHERE {c} IS NOT NULL)) AS v FROM b"
        for c, _ in _PROFILED
    )
    + ")",
)
ORACLES["p10_target_encoding"] = on_applicants(
    """SELECT application_id, CAST(dense_rank() OVER (ORDER BY outcome) - 1 AS INTEGER) AS "default"
FROM a"""
)
ORACLES["p10_binary_target"] = on_applicants(
    """SELECT application_id, CAST(CASE is_urgent WHEN 'N' THEN 1 WHEN 'Y' THEN 0 END AS INTEGER)
       AS "default" FROM a"""
)
ORACLES["p11_fold_limits"] = on_applicants(
    """SELECT greatest(2, min(n)) AS max_folds, least(5, greatest(2, min(n))) AS default_folds
FROM (SELECT count(*) AS n FROM a GROUP BY product_type)"""
)

# --- derived features ---------------------------------------------------------------


def _ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} IS NOT NULL THEN {top} / greatest(abs({bottom}), 1) END"


def _band(age: str) -> str:
    return (
        f"CASE WHEN {age} <= 0 OR {age} > 120 THEN NULL WHEN {age} <= 25 THEN 0"
        f" WHEN {age} <= 35 THEN 1 WHEN {age} <= 45 THEN 2 WHEN {age} <= 55 THEN 3"
        f" WHEN {age} <= 65 THEN 4 WHEN {age} <= 120 THEN 5 END"
    )


AGE_DAYS = "floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us({d})) / 86400000000.0)"
_FEATURES = {
    "f1_loan_per_duration": ("loan_amount_per_duration_months", _ratio("loan_amount", "duration_months")),
    "f2_debt_to_income": ("debt_to_income_ratio", _ratio("loan_amount", "income")),
    "f3_savings_to_loan": ("savings_to_loan_ratio", _ratio("savings", "loan_amount")),
    "f4_age_squared": ("age_squared", "age * age"),
    "f5_age_band": ("age_band", _band("age")),
    "f6_employment_stability": ("employment_stability_score", "ln(1 + abs(employment_years))"),
    "f7_credit_exposure": ("credit_exposure_score", "existing_loans * loan_amount"),
    "f8_credit_utilization": ("credit_utilization_ratio", _ratio("revolving_balance", "credit_limit")),
    "f9_delinquency_count": ("delinquency_count", "CASE WHEN late_lines > 0 THEN 1 ELSE 0 END"),
    "f10_missed_payment_ratio": (
        "missed_payment_ratio",
        "(CASE WHEN late_lines > 0 THEN 1 ELSE 0 END)"
        " / greatest(CASE WHEN payment_lines IS NOT NULL THEN 1 ELSE 0 END, 1)",
    ),
    "f11_date_month": ("application_date_month", "month(application_date)"),
    "f12_date_quarter": ("application_date_quarter", "quarter(application_date)"),
    "f13_date_age_days": ("application_date_age_days", AGE_DAYS.format(d="application_date")),
}
for _name, (_alias, _expression) in _FEATURES.items():
    # More digits where six would meet exact ties of cents over round numbers.
    _digits = {"f1_loan_per_duration": 9, "f8_credit_utilization": 10}.get(_name, 6)
    ORACLES[_name] = on_applicants(
        f"SELECT application_id, {r6(_expression, _alias, _digits)} FROM a"
    )

ORACLES["f4_features_from_days"] = on_applicants(
    f"""SELECT application_id, {r6('years * years', 'age_squared')}, {r6(_band('years'), 'age_band')},
       {r6('ln(1 + abs(-employment_years * 365) / 365.25)', 'employment_stability_score')},
       {r6('month(d)', 'signed_on_month')}, {r6('quarter(d)', 'signed_on_quarter')},
       {r6(AGE_DAYS.format(d='d'), 'signed_on_age_days')}
FROM (SELECT *, abs(-age * 365) / 365.25::DOUBLE AS years,
             CAST(CAST(application_date AS DATE) AS TIMESTAMP) AS d FROM a)"""
)

_INPUTS = (
    "loan_amount duration_months income savings age employment_years existing_loans"
    " revolving_balance credit_limit late_lines payment_lines risk_grade product_type is_urgent"
    " application_date constant"
).split()
ORACLES["f14_feature_names"] = on_applicants(
    "\nUNION ALL ".join(
        [f"SELECT '{c}' AS feature, count({c}) AS present FROM a" for c in _INPUTS]
        + [f"SELECT '{n}', count({e}) FROM a" for n, e in _FEATURES.values()]
    )
)

# --- encoding -----------------------------------------------------------------------

_NUMERIC = ("loan_amount", "income", "savings", "revolving_balance")
ORACLES["e1_median_impute"] = on_applicants(
    "SELECT application_id, "
    + ", ".join(r6(f"coalesce({c}, (SELECT median({c}) FROM a))", c) for c in _NUMERIC)
    + " FROM a"
)


def _clip(column: str, source: str) -> str:
    q = f"(SELECT quantile_cont({column}, {{p}}) FROM {source})"
    skewed = f"(SELECT abs(skewness({column})) >= 3 FROM {source})"
    inside = f"least(greatest({column}, {q.format(p=0.01)}), {q.format(p=0.99)})"
    return r6(f"CASE WHEN {skewed} THEN {inside} ELSE {column} END", column)


ORACLES["e2_outlier_clip"] = f"""
WITH d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(doc_id AS DOUBLE) AS position
           FROM documents)
SELECT doc_id, {_clip('n_chars', 'd')}, {_clip('position', 'd')} FROM d"""

_CLIPPED = {
    "loan_amount": "loan_amount",
    "loan_amount_per_duration_months": _ratio("loan_amount", "duration_months"),
    "debt_to_income_ratio": _ratio("loan_amount", "income"),
    "savings_to_loan_ratio": _ratio("savings", "loan_amount"),
}
ORACLES["e2_clip_bounds"] = on_applicants(
    f"""SELECT column_name, {r6('abs(s)', 'skew', 4)},
       {r6('CASE WHEN abs(s) >= 3 THEN lo END', 'low', 4)},
       {r6('CASE WHEN abs(s) >= 3 THEN hi END', 'high', 4)}
FROM ("""
    + "\nUNION ALL ".join(
        f"SELECT '{n}' AS column_name, skewness(v) AS s, quantile_cont(v, 0.01) AS lo,"
        f" quantile_cont(v, 0.99) AS hi FROM"
        f" (SELECT coalesce(x, median(x) OVER ()) AS v FROM (SELECT {e} AS x FROM a))"
        for n, e in _CLIPPED.items()
    )
    + ")"
)
ORACLES["e3_standard_scale"] = on_applicants(
    "SELECT application_id, "
    + ", ".join(
        r6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c)
        for c in ("loan_amount", "savings", "credit_limit")
    )
    + " FROM a"
)

GAPS = """
g AS (
  SELECT application_id, outcome, loan_amount,
         CASE WHEN application_id % 7 <> 0 THEN is_urgent END AS is_urgent,
         CASE WHEN application_id % 7 <> 0 THEN risk_grade END AS risk_grade,
         CASE WHEN application_id % 7 <> 0 THEN product_type END AS product_type
  FROM a)"""


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM g WHERE {column} IS NOT NULL GROUP BY 1"
        " ORDER BY count(*) DESC, 1 LIMIT 1)"
    )


ORACLES["e4_most_frequent"] = on_applicants(
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_mode(c)} AS value,"
        f" (SELECT count(DISTINCT {c}) FROM g) AS categories"
        for c in ("is_urgent", "risk_grade", "product_type", "outcome")
    ),
    GAPS,
)
ORACLES["e5_boolean_code"] = on_applicants(
    f"""SELECT application_id,
       CAST(CASE coalesce(is_urgent, {_mode('is_urgent')}) WHEN 'N' THEN 0 WHEN 'Y' THEN 1 ELSE -1 END
         AS INTEGER) AS code
FROM g""",
    GAPS,
)
ORACLES["e6_ordinal_code"] = on_applicants(
    """SELECT application_id,
       CAST(CASE risk_grade WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE -1 END AS INTEGER) AS code
FROM a"""
)
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEEN = f"coalesce(CASE WHEN application_id % 11 = 0 THEN 'NEW' ELSE product_type END, {_mode('product_type')})"
ORACLES["e7_one_hot"] = on_applicants(
    "SELECT application_id, "
    + ", ".join(
        f'CAST(seen = \'{s}\' AS INTEGER) AS "product_type_{s}"' for s in _SEGMENTS
    )
    + f" FROM (SELECT application_id, {_SEEN} AS seen FROM g)",
    GAPS,
)
ORACLES["e7_category_codes"] = """
SELECT 'c_name' AS column_name, c_name AS value,
       CAST(row_number() OVER (ORDER BY c_name) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT c_name FROM customer)"""
ORACLES["e8_assembled_vector"] = on_applicants(
    "SELECT application_id, CAST(slot AS INTEGER) AS slot, round(CAST(value AS DOUBLE), 6) AS value FROM ("
    + "\nUNION ALL ".join(
        [
            "SELECT application_id, 0 AS slot, (loan_amount - avg(loan_amount) OVER ())"
            " / stddev_pop(loan_amount) OVER () AS value FROM g",
            f"SELECT application_id, 1, CAST(coalesce(is_urgent, {_mode('is_urgent')}) = 'Y' AS INTEGER) FROM g",
            f"SELECT application_id, 2, CASE coalesce(risk_grade, {_mode('risk_grade')})"
            " WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END FROM g",
        ]
        + [
            f"SELECT application_id, {3 + i}, CAST(coalesce(product_type, {_mode('product_type')}) = '{s}'"
            " AS INTEGER) FROM g"
            for i, s in enumerate(_SEGMENTS)
        ]
    )
    + ")",
    GAPS,
)

# Roles of all columns after feature building, from the data.
_ALL = [(c, c) for c in _INPUTS] + [(n, e) for n, e in _FEATURES.values()]
_KINDS = {"risk_grade": "text", "product_type": "text", "is_urgent": "text", "application_date": "date"}
REPORT = (
    "f AS (SELECT "
    + ", ".join(f"{e} AS {n}" if n != e else n for n, e in _ALL)
    + " FROM a)",
    "facts AS ("
    + "\nUNION ALL ".join(
        f"SELECT {i} AS spot, '{n}' AS column_name, '{_KINDS.get(n, 'number')}' AS kind,"
        f" avg(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS missing_rate,"
        f" count(DISTINCT {n}) AS unique_values, {_flag(n, _KINDS.get(n, 'number'))} AS flag,"
        f" {_ordinal(n, _KINDS.get(n, 'number'))} AS ordered FROM f"
        for i, (n, _) in enumerate(_ALL)
    )
    + ")",
    PROFILED[2],
    f"""placed AS (
  SELECT CASE WHEN spot < {len(_INPUTS)} THEN 'original' ELSE 'derived' END AS section, spot, column_name
  FROM facts
  UNION ALL
  SELECT 'dropped', spot + CASE WHEN role = 'date' THEN 1000 ELSE 0 END, column_name
  FROM typed WHERE role IN ('dropped', 'date')
  UNION ALL
  SELECT CASE role WHEN 'numeric' THEN 'scaled_numeric' WHEN 'ordinal' THEN 'ordinal'
                   WHEN 'categorical' THEN 'one_hot' WHEN 'boolean' THEN 'boolean_ordinal'
                   ELSE 'date_derived_then_dropped' END, spot, column_name
  FROM typed WHERE role <> 'dropped')""",
    """report AS (
  SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY spot) - 1 AS INTEGER) AS position,
         column_name
  FROM placed)""",
)
ORACLES["e9_engineering_report"] = on_applicants("SELECT * FROM report", *REPORT)
ENCODING_COUNTS = """
kinds AS (
  SELECT kind, count(column_name) AS columns
  FROM (VALUES ('numeric', 'scaled_numeric'), ('boolean', 'boolean_ordinal'), ('ordinal', 'ordinal'),
               ('one_hot', 'one_hot'), ('date', 'date_derived_then_dropped')) k(kind, section)
  LEFT JOIN report USING (section) GROUP BY 1)"""
ORACLES["e11_encoding_counts"] = on_applicants("SELECT * FROM kinds", *REPORT, ENCODING_COUNTS)

ORACLES["e10_woe_table"] = on_applicants(
    f"""SELECT column_name, value, row_count, CAST(bad AS BIGINT) AS bad,
       {r6('ln(((row_count - bad + 0.5) / (n - b + 0.5)) / ((bad + 0.5) / (b + 0.5)))', 'woe')}
FROM (SELECT 'product_type' AS column_name, coalesce(product_type, 'nan') AS value,
             count(*) AS row_count, sum(CAST(outcome = 'F' AS INTEGER))::DOUBLE AS bad
      FROM g GROUP BY 2
      UNION ALL
      SELECT 'risk_grade', coalesce(risk_grade, 'nan'), count(*),
             sum(CAST(outcome = 'F' AS INTEGER))::DOUBLE
      FROM g GROUP BY 2),
     (SELECT count(*)::DOUBLE AS n, sum(CAST(outcome = 'F' AS INTEGER))::DOUBLE AS b FROM g)""",
    GAPS,
)


def _weights(column: str) -> str:
    return f"""w_{column} AS (
  SELECT {column} AS v, ln(((count(*) - sum(quality) + 0.5::DOUBLE) / (max(n) - max(b) + 0.5::DOUBLE))
         / ((sum(quality) + 0.5::DOUBLE) / (max(b) + 0.5::DOUBLE))) AS w
  FROM tr, tot GROUP BY 1)"""


ORACLES["e10_woe_encoded"] = f"""
WITH tr AS (SELECT lang, source, quality FROM documents JOIN labels USING (doc_id)),
tot AS (SELECT count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS b FROM tr),
{_weights('lang')}, {_weights('source')}
SELECT d.doc_id, {r6('coalesce(w1.w, 0)', 'lang')}, {r6('coalesce(w2.w, 0)', 'source')}
FROM documents d
LEFT JOIN w_lang w1 ON w1.v = CASE WHEN d.doc_id % 10 = 0 THEN 'xx' ELSE d.lang END
LEFT JOIN w_source w2 ON w2.v = d.source"""

# --- splits -------------------------------------------------------------------------

KEY = "((application_id % 2147483648) * 2654435761 + 42) % 4294967296"
SPLIT = (
    """sizes AS (
  SELECT y, count(*) AS c, sum(count(*)) OVER () AS n,
         sum(count(*)) OVER () - ceil(0.2::DOUBLE * sum(count(*)) OVER ()) AS n_train
  FROM a GROUP BY y)""",
    "shares AS (SELECT *, floor(c * n_train / n) AS q, c * n_train / n - floor(c * n_train / n) AS rest FROM sizes)",
    """quota AS (
  SELECT y, c - (q + CASE WHEN row_number() OVER (ORDER BY rest DESC, y)
                            <= n_train - sum(q) OVER () THEN 1 ELSE 0 END) AS test_n
  FROM shares)""",
    f"""parts AS (
  SELECT keyed.*, CASE WHEN rn <= test_n THEN 'test' ELSE 'train' END AS split
  FROM (SELECT application_id, y, pd_score, age,
               row_number() OVER (PARTITION BY y ORDER BY {KEY}, application_id) AS rn FROM a) keyed
  JOIN quota USING (y))""",
)
ORACLES["t1_stratified_split"] = on_applicants(
    "SELECT application_id, y, split FROM parts", *SPLIT
)


def folds(y: str, k: int) -> tuple[str, ...]:
    """Exact fold of every row of ``src(application_id, y)`` as table ``folded``."""
    return (
        f"""fold_sizes AS (
  SELECT y, c, CAST(sum(c) OVER (ORDER BY y) - c AS BIGINT) AS start
  FROM (SELECT {y} AS y, count(*) AS c FROM src GROUP BY 1))""",
        f"""fold_ends AS (
  SELECT y, f, sum((SELECT count(*) FROM range(start, start + c) t(p) WHERE p % {k} = f))
                 OVER (PARTITION BY y ORDER BY f) AS fold_end
  FROM fold_sizes, range(0, {k}) r(f))""",
        f"""folded AS (
  SELECT application_id, y,
         (SELECT count(*) FROM fold_ends e WHERE e.y = s.y AND e.fold_end < s.rn) AS fold
  FROM (SELECT application_id, {y} AS y,
               row_number() OVER (PARTITION BY {y} ORDER BY {KEY}, application_id) AS rn FROM src) s)""",
    )


CODE = "CAST(CASE outcome WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS INTEGER)"
ORACLES["t2_stratified_folds"] = on_applicants(
    "SELECT application_id, y, CAST(fold AS INTEGER) AS fold FROM folded",
    f"src AS (SELECT application_id, {CODE} AS y FROM a)",
    *folds("y", 5),
)

ORACLES["t4_fixed_sample"] = on_applicants(
    f"SELECT application_id, loan_amount FROM a ORDER BY {KEY}, application_id LIMIT 50"
)

# --- ranking metrics ----------------------------------------------------------------


def curve(source: str, y: str, score: str, keys: str = "") -> tuple[str, ...]:
    """Tables ``pts`` (cumulative counts per score) and ``rank_metrics`` (one row per key)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    prec = "CASE WHEN {t} + {f} = 0 THEN 1 ELSE ({t})::DOUBLE / ({t} + {f}) END"
    here, earlier = prec.format(t="tp", f="fp"), prec.format(t="(tp - pos)", f="(fp - neg)")
    return (
        f"""counts AS (
  SELECT {k}{score} AS score, sum(CAST({y} = 1 AS BIGINT)) AS pos, sum(CAST({y} <> 1 AS BIGINT)) AS neg
  FROM {source} GROUP BY {k}{score})""",
        f"""pts AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY score DESC) AS tp,
         sum(neg) OVER ({part}ORDER BY score DESC) AS fp,
         sum(pos) OVER ({part.strip()}) AS p, sum(neg) OVER ({part.strip()}) AS q
  FROM counts)""",
        f"""rank_metrics AS (
  SELECT {k}sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(q)) AS roc_auc,
         sum(pos::DOUBLE / p * ({here})) AS pr_auc,
         greatest(0, max(tp::DOUBLE / p - fp::DOUBLE / q)) AS ks_statistic,
         2 * sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(q)) - 1 AS gini,
         sum(pos::DOUBLE / p * (({here}) + ({earlier})) / 2) AS pr_curve_auc,
         max(p) AS positives
  FROM pts {by})""",
    )


SCORED = curve("a", "y", "pd_score")
for _name, _column in (
    ("g1_roc_auc", "roc_auc"),
    ("g2_pr_auc", "pr_auc"),
    ("g3_ks_statistic", "ks_statistic"),
    ("g4_gini", "gini"),
    ("g6_pr_curve_auc", "pr_curve_auc"),
):
    ORACLES[_name] = on_applicants(f"SELECT {r6(_column, _column)} FROM rank_metrics", *SCORED)


def cut(source: str, y: str, score: str, threshold: str, keys: str = "") -> tuple[str, ...]:
    k = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    return (
        f"""cut_counts AS (
  SELECT {k}count(*) FILTER (WHERE {y} = 1 AND {score} >= {threshold}) AS tp,
         count(*) FILTER (WHERE {y} <> 1 AND {score} >= {threshold}) AS fp,
         count(*) FILTER (WHERE {y} = 1 AND {score} < {threshold}) AS fn,
         count(*) FILTER (WHERE {y} <> 1 AND {score} < {threshold}) AS tn
  FROM {source} {by})""",
        """cut_metrics AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
         coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
  FROM cut_counts)""",
    )


_RATES = ", ".join(r6(c, c) for c in ("precision", "recall", "f1"))
ORACLES["g5_threshold_metrics"] = on_applicants(
    f"SELECT product_type, tp, fp, fn, tn, {_RATES} FROM cut_metrics",
    *cut("a", "y", "pd_score", "0.5::DOUBLE", "product_type"),
)

_RANKED = ("roc_auc", "pr_auc", "ks_statistic", "gini", "pr_curve_auc")
_HALF = cut("a", "y", "pd_score", "0.5::DOUBLE")
_NINE = (*_RANKED, "precision", "recall", "f1", "threshold", "tn", "fp", "fn", "tp")
ORACLES["s5_metrics_sink"] = on_applicants(
    "\nUNION ALL ".join(
        f"SELECT 'rule' AS model, '{c}' AS metric, {r6(c, 'value')} FROM both_metrics" for c in _NINE
    ),
    *SCORED,
    *_HALF,
    "both_metrics AS (SELECT *, 0.5 AS threshold FROM rank_metrics, cut_metrics)",
)


def grid(source: str, keys: str = "") -> tuple[str, ...]:
    k = f"{keys}, " if keys else ""
    return (
        """steps AS (
  SELECT i, CASE WHEN i = 180 THEN 0.95::DOUBLE
                 ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) END AS threshold
  FROM range(0, 181) r(i))""",
        f"""f1s AS (
  SELECT {k}CAST(i AS INTEGER) AS step, threshold,
         coalesce(2 * tp / nullif(2 * tp + fp + p - tp, 0), 0) AS f1
  FROM (SELECT {k}i, threshold, count(*) FILTER (WHERE y = 1 AND pd_score >= threshold) AS tp,
               count(*) FILTER (WHERE y <> 1 AND pd_score >= threshold) AS fp,
               count(*) FILTER (WHERE y = 1) AS p
        FROM {source}, steps GROUP BY ALL))""",
        "best AS (SELECT threshold, f1 FROM f1s ORDER BY f1 DESC, step LIMIT 1)",
    )


ORACLES["g8_best_threshold"] = on_applicants(
    f"SELECT {r6('threshold', 'threshold')}, {r6('f1', 'f1')} FROM best", *grid("a")
)
ORACLES["g8_f1_by_threshold"] = on_applicants(
    f"SELECT risk_grade, step, {r6('threshold', 'threshold')}, {r6('f1', 'f1')} FROM f1s",
    *grid("a", "risk_grade")[:2],
)
ORACLES["g9_binary_metrics"] = on_applicants(
    "SELECT "
    + ", ".join(r6(c, c) for c in (*_RANKED, "precision", "recall"))
    + f", {r6('cut_metrics.f1', 'f1')}, {r6('best.threshold', 'threshold')}, tn, fp, fn, tp"
    + " FROM rank_metrics, cut_metrics, best",
    *SCORED,
    *grid("a"),
    *cut("a", "y", "pd_score", "(SELECT threshold FROM best)"),
)

HELD = "(SELECT application_id, y, pd_score * age / 80 AS pd_score FROM parts WHERE split = '{part}')"
ORACLES["g18_rule_threshold"] = on_applicants(
    f"""SELECT tp, fp, fn, tn, {r6('precision', 'precision')}, {r6('recall', 'recall')},
       {r6('cut_metrics.f1', 'f1')}, {r6('best.threshold', 'threshold')} FROM cut_metrics, best""",
    *SPLIT,
    *grid(HELD.format(part="train")),
    *cut(HELD.format(part="test"), "y", "pd_score", "(SELECT threshold FROM best)"),
)

MULTI = f"""m AS (
  SELECT application_id, {CODE} AS code,
         list_transform([1 + application_id % 7, 1 + application_id % 5, 1 + application_id % 3],
           lambda w: w::DOUBLE / (3 + application_id % 7 + application_id % 5 + application_id % 3))
           AS probs
  FROM a)"""
TOP = "CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER)"
CELLS = (
    MULTI,
    f"pred AS (SELECT code AS actual, {TOP} AS predicted FROM m)",
    "labels_seen AS (SELECT actual AS label FROM pred UNION SELECT predicted FROM pred)",
    """cells AS (
  SELECT x.label AS actual, z.label AS predicted, count(pred.actual) AS row_count
  FROM labels_seen x CROSS JOIN labels_seen z
  LEFT JOIN pred ON pred.actual = x.label AND pred.predicted = z.label GROUP BY 1, 2)""",
)
ORACLES["g7_confusion_matrix"] = on_applicants("SELECT * FROM cells", *CELLS)
ORACLES["g10_macro_metrics"] = on_applicants(
    f"""SELECT {r6('sum(tp) / sum(support)', 'accuracy')},
       {r6('avg(coalesce(tp / nullif(flagged, 0), 0))', 'precision')},
       {r6('avg(coalesce(tp / nullif(support, 0), 0))', 'recall')},
       {r6('avg(coalesce(2 * tp / nullif(flagged + support, 0), 0))', 'f1')}
FROM (SELECT label, sum(row_count) FILTER (WHERE actual = label) AS support,
             sum(row_count) FILTER (WHERE predicted = label) AS flagged,
             sum(row_count) FILTER (WHERE actual = label AND predicted = label) AS tp
      FROM labels_seen, cells GROUP BY label)""",
    *CELLS,
)
ORACLES["g11_weighted_ovr_auc"] = on_applicants(
    f"SELECT {r6('sum(roc_auc * positives) / sum(positives)', 'roc_auc')} FROM rank_metrics",
    MULTI,
    """long AS (
  SELECT k, CAST(code = k AS INTEGER) AS hit, probs[k + 1] AS score FROM m, range(0, 3) r(k))""",
    *curve("long", "hit", "score", "k"),
)
ORACLES["g13_calibration_curve"] = on_applicants(
    f"""SELECT CAST(len(list_filter(edges, lambda e: e < pd_score)) AS INTEGER) AS bin,
       count(*) AS row_count, {r6('avg(pd_score)', 'mean_score')}, {r6('avg(y)', 'default_rate')}
FROM a, (SELECT quantile_cont(pd_score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM a)
GROUP BY 1"""
)
ORACLES["g14_roc_points"] = on_applicants(
    f"""SELECT {r6('score', 'threshold')}, {r6('fp::DOUBLE / q', 'fpr')}, {r6('tp::DOUBLE / p', 'tpr')} FROM pts
UNION ALL SELECT NULL, 0, 0""",
    *SCORED[:2],
)
ORACLES["g15_pr_points"] = on_applicants(
    f"""SELECT {r6('score', 'threshold')}, {r6('tp::DOUBLE / (tp + fp)', 'precision')},
       {r6('tp::DOUBLE / p', 'recall')} FROM pts
UNION ALL SELECT NULL, 1, 0""",
    *SCORED[:2],
)
ORACLES["g16_prediction_distribution"] = on_applicants(
    f"""SELECT CAST(e.y AS INTEGER) AS y, CAST(bin AS INTEGER) AS bin, {r6('max(low)', 'low')},
       {r6('max(high)', 'high')}, count(a.y) AS row_count
FROM edges e LEFT JOIN a ON a.y = e.y AND pd_score >= low
     AND (pd_score < high OR (bin = 19 AND pd_score <= high))
GROUP BY 1, 2""",
    """edges AS (
  SELECT y, bin, lo + bin * ((hi - lo) / 20) AS low,
         CASE WHEN bin = 19 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 20) END AS high
  FROM (SELECT y, min(pd_score) AS lo, max(pd_score) AS hi FROM a GROUP BY y), range(0, 20) r(bin))""",
)
ORACLES["g17_residuals"] = on_applicants(
    f"SELECT application_id, {r6('pd_score', 'score')}, {r6('y - pd_score', 'residual')} FROM a"
)

# --- model comparison over rule scores ----------------------------------------------

RULES = (
    "src AS (SELECT application_id, y FROM a)",
    *folds("y", 5),
    """rules AS (
  SELECT application_id, folded.y, CAST(fold AS INTEGER) AS fold, model,
         CASE model WHEN 'base' THEN pd_score WHEN 'squared' THEN pd_score * pd_score
                    WHEN 'income' THEN 1 - age / 100.0::DOUBLE ELSE 0.5::DOUBLE END AS score
  FROM a JOIN folded USING (application_id),
       (VALUES ('base'), ('squared'), ('income'), ('flat')) v(model))""",
)


def _as(tables: tuple[str, ...], prefix: str) -> tuple[str, ...]:
    """The curve tables under other names, so that two levels fit in one statement."""
    out = []
    for text in tables:
        for name in ("counts", "pts", "rank_metrics"):
            text = text.replace(f"{name} AS (", f"{prefix}_{name} AS (").replace(
                f"FROM {name}", f"FROM {prefix}_{name}"
            )
        out.append(text)
    return tuple(out)


CV = (
    *RULES,
    *_as(curve("rules", "y", "score", "model, fold"), "fold"),
    """cv AS (
  SELECT model, avg(roc_auc) AS cv_roc_auc_mean, stddev_pop(roc_auc) AS cv_roc_auc_std,
         avg(pr_auc) AS cv_pr_auc_mean
  FROM fold_rank_metrics GROUP BY model)""",
)
ORACLES["m7_fold_metrics"] = on_applicants(
    "SELECT model, "
    + ", ".join(r6(c, c) for c in ("cv_roc_auc_mean", "cv_roc_auc_std", "cv_pr_auc_mean"))
    + " FROM cv",
    *CV,
)
MSE = "mse AS (SELECT model, avg((y - score) * (y - score)) AS cv_test_mse FROM rules GROUP BY model)"
ORACLES["m8_brier"] = on_applicants(
    f"SELECT model, {r6('cv_test_mse', 'cv_test_mse')} FROM mse", *RULES, MSE
)
ORACLES["m8_brier_multi"] = on_applicants(
    r"""SELECT round(avg(list_sum(list_transform(range(0, 3),
       lambda k: pow(CAST(code = k AS INTEGER) - probs[k + 1], 2)))), 6) AS cv_test_mse FROM m""",
    MULTI,
)
_ORDER = "list_position(['base', 'squared', 'income', 'flat'], model)"
ORACLES["m9_champion_by_auc"] = on_applicants(
    f"""SELECT model, {r6('v', 'value')} FROM (SELECT model, round(cv_roc_auc_mean, 9) AS v FROM cv)
ORDER BY v DESC, {_ORDER} LIMIT 1""",
    *CV,
)
ORACLES["m9_champion_by_mse"] = on_applicants(
    f"""SELECT model, {r6('v', 'value')} FROM (SELECT model, round(cv_test_mse, 9) AS v FROM mse)
ORDER BY v, {_ORDER} LIMIT 1""",
    *RULES,
    MSE,
)
WHOLE = _as(curve("rules", "y", "score", "model"), "whole")
ORACLES["m12_leaderboard"] = on_applicants(
    "SELECT model, "
    + ", ".join(r6(c, c) for c in ("cv_test_mse", "roc_auc", "pr_auc"))
    + " FROM mse JOIN whole_rank_metrics USING (model)",
    *RULES,
    MSE,
    *WHOLE,
)
ORACLES["m13_comparison"] = on_applicants(
    "SELECT model, "
    + ", ".join(
        r6(c, c)
        for c in ("roc_auc", "pr_auc", "ks_statistic", "gini", "precision", "recall", "f1")
    )
    + ", 0.5::DOUBLE AS threshold FROM whole_rank_metrics JOIN cut_metrics USING (model)",
    *RULES,
    *WHOLE,
    *cut("rules", "y", "score", "0.5::DOUBLE", "model"),
)
ORACLES["m5_balanced_weights"] = on_applicants(
    f"""SELECT application_id, code,
       {r6('count(*) OVER () / (3.0::DOUBLE * count(*) OVER (PARTITION BY code))', 'weight')}
FROM m""",
    MULTI,
)
ORACLES["m14_target_definition"] = on_applicants(
    """SELECT CAST(count(*) - ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_train,
       CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS n_test,
       'default_flag mapped to default=1 / non-default=0' AS target_definition, 16 AS features
FROM a"""
)

ORACLES["s6_bundle_round_trip"] = on_applicants(
    "SELECT CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS row_count, 0.0::DOUBLE AS largest_gap FROM a"
)

# --- explanations -------------------------------------------------------------------

DEPENDENCE = """
grids AS (
  SELECT 'loan_amount' AS feature,
         lo + i * ((hi - lo) / 99) AS grid_value
  FROM (SELECT quantile_cont(loan_amount, 0.05) AS lo, quantile_cont(loan_amount, 0.95) AS hi FROM a),
       range(0, 100) r(i)
  UNION ALL SELECT DISTINCT 'late_lines', late_lines::DOUBLE FROM a
  UNION ALL SELECT DISTINCT 'age', age::DOUBLE FROM a),
sums AS (
  SELECT avg(loan_amount) AS l, avg(late_lines * age) AS xa, avg(late_lines) AS x, avg(age) AS g FROM a)"""
ORACLES["x2_rule_dependence"] = on_applicants(
    f"""SELECT feature, {r6('grid_value', 'grid_value')},
       {r6("0.1 + CASE feature WHEN 'loan_amount' THEN grid_value ELSE l END / 1000000 + 0.05 * CASE feature WHEN 'loan_amount' THEN xa WHEN 'late_lines' THEN grid_value * g ELSE x * grid_value END / 80", 'average')}
FROM grids, sums""",
    DEPENDENCE,
)

# --- decisions ----------------------------------------------------------------------

ORACLES["d1_risk_band"] = on_applicants(
    f"""SELECT application_id, {BAND.format(p='p')} AS risk_band
FROM (SELECT application_id, CASE application_id % 50 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN -0.1::DOUBLE
             ELSE pd_score END AS p FROM a)"""
)
ORACLES["d2_business_decision"] = on_applicants(
    f"""SELECT application_id, {DECISION.format(p='p')} AS decision
FROM (SELECT application_id, CASE application_id % 50 WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.55::DOUBLE
             ELSE pd_score END AS p FROM a)"""
)
ORACLES["d3_prediction_confidence"] = on_applicants(
    """SELECT application_id, round(CASE WHEN p > 0.35 AND p <= 0.55
         THEN least(p - 0.35::DOUBLE, 0.55::DOUBLE - p) / ((0.55::DOUBLE - 0.35::DOUBLE) / 2)
         ELSE least(abs(p - 0.35::DOUBLE), abs(p - 0.55::DOUBLE)) END, 4) AS confidence
FROM (SELECT application_id, pd_score AS p FROM a)"""
)
ORACLES["d5_score_classes"] = on_applicants(
    f"""SELECT application_id, ['F', 'O', 'P'][{TOP} + 1] AS predicted_label,
       {r6('list_max(probs)', 'confidence')} FROM m""",
    MULTI,
)
ORACLES["d5_label_probabilities"] = on_applicants(
    f"""SELECT application_id, ['F', 'O', 'P'][k + 1] AS label, {r6('probs[k + 1]', 'probability')}
FROM m, range(0, 3) r(k)""",
    MULTI,
)
ORACLES["d6_loose_input"] = on_applicants(
    f"""SELECT application_id, CASE WHEN application_id % 4 <> 0 THEN age ELSE -1 END AS age,
       {r6('pd_score', 'pd_score')}, NULL::DOUBLE AS income FROM a"""
)

# --- training and scoring that SQL can follow ------------------------------------------

MOSTLY = "CASE WHEN {f} = 'Y' THEN CAST(application_id % 4 > 0 AS INTEGER) ELSE CAST(application_id % 5 = 0 AS INTEGER) END"
MARKED = f"b AS (SELECT * REPLACE ({MOSTLY.format(f='is_urgent')} AS y) FROM a)"
MARKED_SPLIT = (MARKED, *[t.replace("FROM a ", "FROM b ").replace("FROM a)", "FROM b)") for t in SPLIT])
RATES = """rates AS (
  SELECT a.{f} AS f, avg(p.y::DOUBLE) AS p, sum(p.y)::DOUBLE AS pos, count(*) - sum(p.y)::DOUBLE AS neg
  FROM parts p JOIN a USING (application_id) WHERE p.split = 'train' GROUP BY 1)"""
TRAINED = "sums AS (SELECT sum(pos) AS pos, sum(neg) AS neg FROM rates)"


def rate_query(feature: str, expression: str, digits: int) -> str:
    return on_applicants(
        f"""SELECT p.application_id, {r6(expression, 'pd', digits)}
FROM parts p JOIN a USING (application_id) JOIN rates ON a.{feature} = rates.f, sums
WHERE p.split = 'test'""",
        *MARKED_SPLIT,
        RATES.format(f=feature),
        TRAINED,
    )


ORACLES["m1_category_rates"] = rate_query("product_type", "rates.p", 3)
ORACLES["m2_balanced_rates"] = rate_query(
    "product_type", "(rates.pos / sums.pos) / (rates.pos / sums.pos + rates.neg / sums.neg)", 3
)
ORACLES["m3_split_rates"] = rate_query("is_urgent", "rates.p", 9)
# One round: the log odds of all rows, and a tenth of the Newton step of each side of the split.
SHARE = "(sums.pos / (sums.pos + sums.neg))"
STEP = f"""(rates.pos - (rates.pos + rates.neg) * {SHARE})
  / ((rates.pos + rates.neg) * {SHARE} * (1 - {SHARE}) + 1)"""
ORACLES["m4_split_odds"] = rate_query(
    "is_urgent", f"1 / (1 + sums.neg / sums.pos * exp(-0.1::DOUBLE * {STEP}))", 9
)
THIRD = f"""b AS (SELECT * REPLACE (CASE WHEN is_urgent = 'Y' AND application_id % 3 = 0 THEN 2
  ELSE {MOSTLY.format(f='is_urgent')} END AS y) FROM a)"""
ORACLES["m4_split_classes"] = on_applicants(
    f"""SELECT application_id, {r6('e0 / (e0 + e1 + e2)', 'p0', 9)}, {r6('e1 / (e0 + e1 + e2)', 'p1', 9)},
       {r6('e2 / (e0 + e1 + e2)', 'p2', 9)}
FROM (SELECT p.application_id, {', '.join(f'max(odds) FILTER (k = {k}) AS e{k}' for k in range(3))}
      FROM parts p JOIN a USING (application_id) JOIN stepped USING (is_urgent)
      WHERE p.split = 'test' GROUP BY 1)""",
    THIRD,
    *MARKED_SPLIT[1:],
    """sides AS (
  SELECT is_urgent, k, count(*)::DOUBLE AS n, sum((p.y = k)::INTEGER)::DOUBLE AS hits
  FROM parts p JOIN a USING (application_id), range(3) classes(k) WHERE p.split = 'train' GROUP BY 1, 2)""",
    "priors AS (SELECT k, sum(hits) / sum(n) AS share FROM sides GROUP BY k)",
    """stepped AS (
  SELECT is_urgent, k, share * exp(0.1::DOUBLE * (hits - n * share) / (2 * n * share * (1 - share) + 1)) AS odds
  FROM sides JOIN priors USING (k))""",
)

OUT_OF_FOLD = (
    *MARKED_SPLIT,
    "src AS (SELECT application_id, y FROM parts WHERE split = 'train')",
    *folds("y", 5),
    """flagged AS (SELECT f.*, a.is_urgent FROM folded f JOIN a USING (application_id))""",
    """cells AS (SELECT fold, is_urgent, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM flagged GROUP BY 1, 2)""",
    """others AS (
  SELECT c.fold, c.is_urgent, sum(o.pos) AS pos, sum(o.n) AS n, (sum(o.pos)) / sum(o.n) AS p
  FROM cells c JOIN cells o ON o.is_urgent = c.is_urgent AND o.fold <> c.fold GROUP BY 1, 2)""",
    "priors AS (SELECT fold, sum(pos) / sum(n) AS share FROM others GROUP BY fold)",
    """oof AS (
  SELECT application_id, fold, y, p,
         1 / (1 + (1 - share) / share * exp(-0.1::DOUBLE * (pos - n * share) / (n * share * (1 - share) + 1))) AS q
  FROM flagged JOIN others USING (fold, is_urgent) JOIN priors USING (fold))""",
)
ORACLES["t3_rates_out_of_fold"] = on_applicants(
    f"SELECT application_id, CAST(fold AS INTEGER) AS fold, y AS \"default\", {r6('p', 'pd', 9)} FROM oof",
    *OUT_OF_FOLD,
)
ORACLES["m6_rates_search"] = on_applicants(
    f"""SELECT 0 AS param_set, {r6('avg(roc_auc)', 'mean_score', 9)} FROM rank_metrics
UNION ALL SELECT 1, 0.5::DOUBLE""",
    *OUT_OF_FOLD,
    *curve("oof", "y", "p", "fold"),
)
ORACLES["m10_rates_experiment"] = on_applicants(
    f"""SELECT 'random_forest' AS model, {r6('avg(roc_auc)', 'cv_roc_auc_mean', 9)},
       {r6('(SELECT avg((y - p) * (y - p)) FROM oof)', 'cv_test_mse', 9)}, true AS champion FROM rank_metrics
UNION ALL SELECT 'xgboost', {r6('avg(roc_auc)', 'x', 9)},
       {r6('(SELECT avg((y - q) * (y - q)) FROM oof)', 'm', 9)}, false
FROM rank_metrics""",
    *OUT_OF_FOLD,
    *curve("oof", "y", "p", "fold"),
)
ORACLES["m10_analyzed"] = on_applicants(
    f"""SELECT 'random_forest' AS model, {r6('(SELECT avg((y - p) * (y - p)) FROM oof)', 'cv_test_mse', 9)}
UNION ALL SELECT 'xgboost', {r6('(SELECT avg((y - q) * (y - q)) FROM oof)', 'm', 9)}""",
    *OUT_OF_FOLD,
)
ORACLES["m11_rates_progress"] = (
    "SELECT CAST(done AS INTEGER) AS done, CAST(2 AS INTEGER) AS total, done < 2 AS time_left"
    " FROM range(1, 3) t(done)"
)
ORACLES["m14_run_report"] = on_applicants(
    """SELECT 'applicants' AS dataset, 'random_forest' AS champion, 'cv_roc_auc_mean' AS selection_metric,
       CAST(5 AS INTEGER) AS cv_folds, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test, 'is_urgent' AS top_features, 'is_urgent' AS original
FROM parts""",
    *MARKED_SPLIT,
)
CONFIDENCE = """round(CASE WHEN {p} > 0.35 AND {p} <= 0.55
         THEN least({p} - 0.35::DOUBLE, 0.55::DOUBLE - {p}) / ((0.55::DOUBLE - 0.35::DOUBLE) / 2)
         ELSE least(abs({p} - 0.35::DOUBLE), abs({p} - 0.55::DOUBLE)) END, 4)"""
ORACLES["d4_rates_scored"] = on_applicants(
    f"""SELECT application_id, {r6('p', 'probability_default', 9)}, {DECISION.format(p='p')} AS decision,
       {BAND.format(p='p')} AS risk_band, {CONFIDENCE.format(p='p')} AS prediction_confidence,
       'random_forest' AS model_name
FROM (SELECT application_id, CASE WHEN application_id % 10 > 0 THEN is_urgent ELSE mode END AS f
      FROM a, (SELECT f AS mode FROM rates ORDER BY pos + neg DESC, f LIMIT 1))
JOIN rates USING (f)""",
    *MARKED_SPLIT,
    RATES.format(f="is_urgent"),
)
ORACLES["d4_rates_streamed"] = (
    "WITH e AS (SELECT event_id AS application_id, 0 AS pd_score, 0 AS age,"
    " CASE WHEN event_id % 3 = 0 THEN 'Y' ELSE 'N' END AS flag FROM events),\n"
    f"a AS (SELECT *, {MOSTLY.format(f='flag')} AS y FROM e),\n"
    + ",\n".join([*SPLIT, RATES.format(f="flag")])
    + f"""
SELECT application_id, {r6('p', 'probability_default', 9)}, {DECISION.format(p='p')} AS decision
FROM a JOIN rates ON a.flag = rates.f"""
)

_MAPS = ", ".join(
    f"({i}, {step}::BIGINT, {shift}::BIGINT)"
    for i, (step, shift) in enumerate(islice(candidate_maps(42), 60))
)
# Permutation importance of the closed-form model.
PERMUTED = (
    f"""numbered AS (SELECT a.*, row_number() OVER (ORDER BY {KEY}, application_id) - 1 AS i, count(*) OVER () AS n FROM a)""",
    f"""maps AS (
  SELECT row_number() OVER (ORDER BY pos) AS r, step, shift FROM (VALUES {_MAPS}) m(pos, step, shift)
  WHERE gcd(step, (SELECT count(*) FROM a)) = 1 ORDER BY pos LIMIT 10)""",
    """paired AS (
  SELECT m.r, x.y, x.loan_amount AS xl, x.late_lines AS xt, x.age AS xa,
         z.loan_amount AS zl, z.late_lines AS zt, z.age AS za
  FROM numbered x, maps m JOIN numbered z ON z.i = (m.step * x.i + m.shift) % x.n)""",
    """scored AS (
  SELECT 'loan_amount' AS feature, r, y, 0.1::DOUBLE + zl / 1000000 + 0.05::DOUBLE * xt * xa / 80 AS p FROM paired
  UNION ALL SELECT 'late_lines', r, y, 0.1::DOUBLE + xl / 1000000 + 0.05::DOUBLE * zt * xa / 80 FROM paired
  UNION ALL SELECT 'age', r, y, 0.1::DOUBLE + xl / 1000000 + 0.05::DOUBLE * xt * za / 80 FROM paired
  UNION ALL SELECT '', 0, y, 0.1::DOUBLE + loan_amount / 1000000 + 0.05::DOUBLE * late_lines * age / 80 FROM a)""",
    *curve("scored", "y", "p", "feature, r"),
    """importance AS (
  SELECT feature, avg(base - roc_auc) AS importance_mean, stddev_pop(base - roc_auc) AS importance_std
  FROM rank_metrics, (SELECT roc_auc AS base FROM rank_metrics WHERE feature = '') WHERE feature <> '' GROUP BY feature)""",
)
ORACLES["x1_rule_importance"] = on_applicants(
    f"SELECT feature, {r6('importance_mean', 'importance_mean')}, {r6('importance_std', 'importance_std')} FROM importance",
    *PERMUTED,
)
ORACLES["x4_top_importance"] = on_applicants(
    f"""SELECT feature, {r6('importance_mean', 'importance_mean')}
FROM importance ORDER BY importance.importance_mean DESC, feature LIMIT 2""",
    *PERMUTED,
)
ORACLES["x5_feature_report"] = on_applicants(
    f"""SELECT section, position, column_name AS name, NULL::DOUBLE AS value FROM report
WHERE section IN ('original', 'derived', 'dropped')
UNION ALL
SELECT 'missing', CAST(row_number() OVER (ORDER BY missing_rate DESC, column_name) - 1 AS INTEGER),
       column_name, round(missing_rate, 6)
FROM facts WHERE spot < {len(_INPUTS)} AND missing_rate > 0
UNION ALL
SELECT 'encoding', CAST(row_number() OVER (ORDER BY kind) - 1 AS INTEGER), kind, columns::DOUBLE FROM kinds
UNION ALL
SELECT 'importance', CAST(row_number() OVER (ORDER BY importance_mean DESC, feature) - 1 AS INTEGER),
       feature, round(importance_mean, 6) FROM importance""",
    *REPORT,
    ENCODING_COUNTS,
    *PERMUTED,
)
ORACLES["x3_rule_total"] = on_applicants(
    f"SELECT application_id, {r6('p - avg(p) OVER ()', 'total')} FROM picked",
    f"""picked AS (
  SELECT application_id, 0.1::DOUBLE + loan_amount / 1000000 + 0.05::DOUBLE * late_lines * age / 80 AS p
  FROM a ORDER BY {KEY}, application_id LIMIT 50)""",
)
ORACLES["s6_saved_codes"] = on_applicants(
    """SELECT application_id, CASE WHEN application_id % 5 = 0 THEN n ELSE place END AS code
FROM (SELECT application_id, row_number() OVER (ORDER BY application_id::VARCHAR) - 1 AS place, count(*) OVER () AS n FROM a)"""
)

# --- NaN is a missing value ----------------------------------------------------------

ORACLES["p7_nan_profile"] = on_applicants(
    f"""SELECT 'income' AS "column", {r6('avg(CAST(income IS NULL AS INTEGER))', 'missing_rate')} FROM a
UNION ALL SELECT 'late_lines', {r6('avg(CAST(application_id % 7 = 0 AS INTEGER))', 'm')} FROM a
UNION ALL SELECT 'application_id', 0.0::DOUBLE"""
)
ORACLES["e1_nan_median"] = on_applicants(
    f"""SELECT 'income' AS feature, {r6('median(income)', 'median')} FROM a
UNION ALL SELECT 'late_lines', {r6('median(late_lines)', 'm')} FROM a WHERE application_id % 7 <> 0"""
)
ORACLES["f9_nan_delinquency"] = on_applicants(
    """SELECT application_id, CAST(CASE WHEN application_id % 7 <> 0 AND late_lines > 0 THEN 1 ELSE 0 END
       + CASE WHEN income > 0 THEN 1 ELSE 0 END AS BIGINT) AS delinquency_count FROM a"""
)
ORACLES["d6_nan_text"] = on_applicants(
    "SELECT application_id, CASE WHEN application_id % 4 < 2 THEN -1.0::DOUBLE ELSE 2.5::DOUBLE END AS x FROM a"
)
ORACLES["p4_date_layouts"] = on_applicants(
    "SELECT application_id, strftime(application_date, '%Y-%m-%d') AS day FROM a"
)
