"""Regression corpora and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """J7. A case passes when decision and ordered rules are as expected; no result fails it.

    ``results`` has ``id, actual_decision, actual_rules``.
    """
    joined = cases.join(results.select("id", "actual_decision", "actual_rules"), "id", "left")
    passed = F.coalesce(
        (F.col("actual_decision") == F.col("expected_decision")) & (F.col("actual_rules") == F.col("expected_rules")),
        F.lit(False),
    )
    return joined.withColumns(
        {
            "negative_control": (F.col("expected_decision") == "ALLOW") & (F.size("expected_rules") == 0),
            "passed": passed,
        }
    )


def score_batch(batch: DataFrame, results: DataFrame) -> DataFrame:
    """J8. Pass without an expectation or with the expected decision; no result is an ERROR."""
    joined = batch.join(results.select("name", "decision"), "name", "left")
    return joined.withColumns(
        {
            "decision": F.coalesce("decision", F.lit("ERROR")),
            "passed": F.col("decision").isNotNull()
            & F.coalesce(F.col("expected").isNull() | (F.col("decision") == F.col("expected")), F.lit(False)),
        }
    )


def category_summary(scored: DataFrame) -> DataFrame:
    """A11. Per category: all passed, negative controls, number of cases."""
    return scored.groupBy("category").agg(
        F.bool_and("passed").alias("category_passed"),
        F.count_if("negative_control").alias("negative_controls"),
        F.count("*").alias("case_count"),
    )


def group_cases(scored: DataFrame) -> DataFrame:
    """A11. Cases in category and id order, each with its category's result.

    The grouping stays flat so that a category of any size is never gathered into one row.
    """
    return category_summary(scored).join(scored, "category").orderBy("category", "id")


def overall_passed(scored: DataFrame) -> DataFrame:
    """A12. True when nothing failed, also when there was nothing."""
    return scored.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"))


def order_cases(cases: DataFrame) -> DataFrame:
    """K5."""
    return cases.orderBy("id")
