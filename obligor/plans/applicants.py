"""Loan applications derived from the order tables: one row per order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ID = "application_id"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with every kind of column the profiler knows.

    Line items are summed per order before the join, so the join sees one row per
    order on both sides; customer sizes decide the join strategy at run time. The two
    aggregates are joined from the left on their own keys, so the optimizer drops each
    join whose columns a query does not use.
    """
    orders = table(spark, sf_dir, "orders")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("payment_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("late_lines"),
        )
    )
    loans = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("ck"))
        .agg(F.count(F.lit(1)).alias("existing_loans"))
    )
    price, key, cust = F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey")
    balance = F.col("c_acctbal")
    raw_score = 0.5 * ((key * 37) % 101) / 100 + 0.5 * F.least(price / 500000, F.lit(1.0))
    return (
        orders.join(table(spark, sf_dir, "customer"), cust == F.col("c_custkey"))
        .join(loans, F.col("ck") == cust, "left")
        .join(lines, F.col("l_orderkey") == key, "left")
        .select(
            key.alias(ID),
            price.alias("loan_amount"),
            (1 + key % 60).alias("duration_months"),
            F.when(balance >= 0, balance).alias("income"),
            (F.abs(balance) / 2).alias("savings"),
            (18 + cust % 60).alias("age"),
            ((cust % 400).cast("double") / 10).alias("employment_years"),
            "existing_loans",
            F.abs(balance).alias("revolving_balance"),
            (5000 + 100 * (cust % 50)).alias("credit_limit"),
            F.coalesce("late_lines", F.lit(0)).alias("late_lines"),
            "payment_lines",
            F.when(price < 150000, "low").when(price < 350000, "medium").otherwise("high").alias(
                "risk_grade"
            ),
            F.col("c_mktsegment").alias("product_type"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Y").otherwise("N").alias("is_urgent"),
            F.col("o_orderdate").alias("application_date"),
            F.lit(1).alias("constant"),
            F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"),
            F.col("o_orderstatus").alias("outcome"),
            # Four digits by plain arithmetic, the same in any engine.
            (F.floor(raw_score * 10000 + 0.5) / 10000).alias("pd_score"),
        )
    )


FEATURES = (
    "loan_amount",
    "duration_months",
    "income",
    "savings",
    "age",
    "employment_years",
    "existing_loans",
    "revolving_balance",
    "credit_limit",
    "late_lines",
    "payment_lines",
    "risk_grade",
    "product_type",
    "is_urgent",
    "application_date",
    "constant",
)


def features_only(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(ID, *FEATURES, *extra)


def class_weights_by_id(df: DataFrame, id_col: str = ID, classes: Sequence[int] = (7, 5, 3)):
    """Deterministic three-class probabilities from the id."""
    parts = [(1 + F.col(id_col) % m).cast("double") for m in classes]
    total = parts[0] + parts[1] + parts[2]
    code = F.when(F.col("outcome") == "F", 0).when(F.col("outcome") == "O", 1).otherwise(2)
    return df.select(
        id_col, code.alias("code"), F.array(*[p / total for p in parts]).alias("probs")
    )
