"""Risk band, business decision and confidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.functions.numeric import known
from obligor.session import col
from obligor.sources.policy import DecisionPolicy, default_policy


def risk_band(pd: Column, policy: DecisionPolicy | None = None) -> Column:
    """Half-open bands; any value outside all of them belongs to the last one."""
    bands = (policy or default_policy()).bands
    chain = None
    for band in bands:
        # Spark sorts NaN above every number, so NaN fails the upper bound as it should.
        inside = (pd >= band.min_pd) & (pd < band.max_pd)
        chain = F.when(inside, band.name) if chain is None else chain.when(inside, band.name)
    return chain.otherwise(bands[-1].name)


def business_decision(pd: Column, policy: DecisionPolicy | None = None) -> Column:
    rule = policy or default_policy()
    return (
        F.when(pd <= rule.approve_max_pd, "Approve")
        .when(pd <= rule.manual_review_max_pd, "Manual Review")
        .otherwise("Reject")
    )


def decision_confidence(pd: Column, policy: DecisionPolicy | None = None) -> Column:
    """Relative depth inside the review corridor, or distance to it from outside."""
    rule = policy or default_policy()
    low, high = F.lit(rule.approve_max_pd), F.lit(rule.manual_review_max_pd)
    half_width = (rule.manual_review_max_pd - rule.approve_max_pd) / 2
    inside = F.least(pd - low, high - pd) / F.lit(half_width)
    outside = F.least(F.abs(pd - low), F.abs(pd - high))
    return F.round(F.when((pd > low) & (pd <= high), inside).otherwise(outside), 4)


def with_decision(df: DataFrame, pd: Column, policy: DecisionPolicy | None = None) -> DataFrame:
    return df.withColumns(
        {
            "decision": business_decision(pd, policy),
            "risk_band": risk_band(pd, policy),
            "prediction_confidence": decision_confidence(pd, policy),
        }
    )


def _cast(value: Column, kind: str) -> Column:
    typed = value.try_cast(kind)
    return known(typed) if kind in ("float", "double") else typed


def loose_cast(df: DataFrame, fitted: dict[str, str]) -> DataFrame:
    """Bring loosely typed input to fitted types; what cannot be read becomes NULL."""
    present = {
        name: _cast(col(name), kind) for name, kind in fitted.items() if name in df.columns
    }
    absent = {name: F.lit(None).cast(kind) for name, kind in fitted.items() if name not in present}
    return df.withColumns({**present, **absent})
