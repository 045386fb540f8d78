"""Derived credit features.

Sources are found by column name among numeric columns, once, when the plan is made;
applying a plan is a single projection.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.functions.dates import parse_mixed, whole_days_between
from obligor.functions.names import find_column, find_columns, matches_any, normalize_name
from obligor.functions.numeric import (
    finite,
    floored_ratio,
    known,
    nan_to_null,
    numeric_columns,
    sum_of,
)
from obligor.operators.profile import date_columns, is_text
from obligor.session import col

# Fixed values: (include, exclude) name patterns of every source.
SOURCES = {
    "loan_amount": (
        ("loan.*amount", "credit.*amount", "amt.*credit", "amount"),
        ("income", "annuity", "limit", "balance"),
    ),
    "duration": (("duration", "term", "tenor", "months"), ("employment", "since")),
    "income": (("income", "salary", "earnings"), ()),
    "savings": (("saving", "asset", "deposit"), ()),
    "age": (("age", "days_birth"), ()),
    "employment": (
        ("employment.*duration", "employed", "employment", "years.*job", "days_employed"),
        (),
    ),
    "existing_loans": (
        ("existing.*credit", "existing.*loan", "num.*loan", "cnt.*credit", "open.*credit"),
        (),
    ),
    "revolving_balance": (
        ("revolving.*balance", "revol.*bal", "balance"),
        ("limit", "income"),
    ),
    "credit_limit": (("credit.*limit", "limit"), ("amount",)),
}
DELINQUENCY = ("delinq", "dpd", "past_due", "late", "missed", "times.*worse")
PAYMENT = ("payment", "installment")
AGE_IN_DAYS = ("days_birth",)
EMPLOYED_IN_DAYS = ("days",)
DAYS_PER_YEAR = 365.25
# Upper ends of the right-closed age bands, the first one opening at 0.
AGE_BANDS = (25, 35, 45, 55, 65, 120)


@dataclass(frozen=True)
class FeaturePlan:
    """Which columns feed which features."""

    sources: dict[str, str] = field(default_factory=dict)
    delinquency: list[str] = field(default_factory=list)
    payment: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    text_dates: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> FeaturePlan:
        return FeaturePlan(**json.loads(text))


def plan_features(df: DataFrame, id_col: str, dates: Sequence[str] | None = None) -> FeaturePlan:
    """Detect sources by name and date columns by value (or take ``dates`` as given)."""
    columns = [c for c in df.columns if c != id_col]
    numbers = [c for c in numeric_columns(df) if c != id_col]
    found = {role: find_column(numbers, *rules) for role, rules in SOURCES.items()}
    dates = list(dates) if dates is not None else date_columns(df, columns, id_col)
    return FeaturePlan(
        sources={role: name for role, name in found.items() if name},
        delinquency=find_columns(numbers, DELINQUENCY),
        payment=find_columns(numbers, PAYMENT),
        dates=dates,
        text_dates=[c for c in dates if is_text(df.schema[c].dataType)],
    )


def loan_per_duration(loan: Column, duration: Column) -> Column:
    return floored_ratio(loan, duration)


def years(value: Column, in_days: bool) -> Column:
    return F.abs(value) / DAYS_PER_YEAR if in_days else value


def age_band(age: Column) -> Column:
    """Band number, NULL outside (0, 120]."""
    chain = F.when(age <= 0, F.lit(None).cast("int"))
    for number, upper in enumerate(AGE_BANDS):
        chain = chain.when(age <= upper, F.lit(number))
    return chain


def employment_stability(duration: Column, in_days: bool) -> Column:
    size = F.abs(duration)
    return F.log1p(size / DAYS_PER_YEAR if in_days else size)


def delinquency_count(flags: Sequence[Column]) -> Column:
    """How many columns are above zero; a missing value counts as not delinquent."""
    positive = [known(c.cast("double")) > 0 for c in flags]
    return sum_of([F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for c in positive])


def present_count(values: Sequence[Column]) -> Column:
    return sum_of([c.isNotNull().cast("bigint") for c in values])


def missed_payment_ratio(flags: Sequence[Column], payments: Sequence[Column]) -> Column:
    return delinquency_count(flags) / F.greatest(present_count(payments), F.lit(1).cast("bigint"))


def date_parts(name: str, moment: Column, as_of: Column) -> list[tuple[str, Column]]:
    prefix = normalize_name(name)
    return [
        (f"{prefix}_month", F.month(moment)),
        (f"{prefix}_quarter", F.quarter(moment)),
        (f"{prefix}_age_days", whole_days_between(as_of, moment)),
    ]


def feature_columns(plan: FeaturePlan, as_of: str | None = None) -> list[tuple[str, Column]]:
    """(name, expression) of every feature the plan supports, in a fixed order."""
    have = plan.sources

    def source(role: str) -> Column:
        return col(have[role]).cast("double")

    out: list[tuple[str, Column]] = []
    if "loan_amount" in have and "duration" in have:
        name = f"{normalize_name(have['loan_amount'])}_per_{normalize_name(have['duration'])}"
        out.append((name, loan_per_duration(source("loan_amount"), source("duration"))))
    if "income" in have and "loan_amount" in have:
        out.append(("debt_to_income_ratio", floored_ratio(source("loan_amount"), source("income"))))
    if "savings" in have and "loan_amount" in have:
        out.append(
            ("savings_to_loan_ratio", floored_ratio(source("savings"), source("loan_amount")))
        )
    if "age" in have:
        age = years(source("age"), matches_any(have["age"], AGE_IN_DAYS))
        out.append(("age_squared", finite(age * age)))
        out.append(("age_band", age_band(age)))
    if "employment" in have:
        in_days = matches_any(have["employment"], EMPLOYED_IN_DAYS)
        score = employment_stability(source("employment"), in_days)
        out.append(("employment_stability_score", finite(score)))
    if "existing_loans" in have and "loan_amount" in have:
        exposure = source("existing_loans") * source("loan_amount")
        out.append(("credit_exposure_score", finite(exposure)))
    if "revolving_balance" in have and "credit_limit" in have:
        out.append(
            (
                "credit_utilization_ratio",
                floored_ratio(source("revolving_balance"), source("credit_limit")),
            )
        )
    if plan.delinquency:
        flags = [col(c) for c in plan.delinquency]
        out.append(("delinquency_count", delinquency_count(flags)))
        if plan.payment:
            payments = [col(c) for c in plan.payment]
            out.append(("missed_payment_ratio", missed_payment_ratio(flags, payments)))
    now = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    for name in plan.dates:
        moment = parse_mixed(col(name)) if name in plan.text_dates else col(name).cast("timestamp")
        out.extend(date_parts(name, moment, now))
    return out


def add_features(df: DataFrame, plan: FeaturePlan, as_of: str | None = None) -> DataFrame:
    """All supported features next to the input columns, in one projection."""
    return df.withColumns(dict(feature_columns(plan, as_of)))


def feature_names(plan: FeaturePlan) -> list[str]:
    return [name for name, _ in feature_columns(plan)]


class CreditFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The frozen feature plan as a persistable stage."""

    plan = Param(Params._dummy(), "plan", "feature plan as JSON", TypeConverters.toString)
    asOf = Param(Params._dummy(), "asOf", "timestamp for ages, empty for now", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, plan: str = "{}", asOf: str = "") -> None:
        super().__init__()
        self._setDefault(plan="{}", asOf="")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        plan = FeaturePlan.from_json(self.getOrDefault(self.plan))
        dataset = nan_to_null(dataset)
        return add_features(dataset, plan, self.getOrDefault(self.asOf) or None)

    def names_out(self, inputs: Sequence[str]) -> list[str]:
        return [*inputs, *feature_names(FeaturePlan.from_json(self.getOrDefault(self.plan)))]
