"""Five-signal quality score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_RULES, RuleSet
from broadsheet.functions.text import word_count
from broadsheet.operators.columns import computed_once


def source_tier(source: Column, rules: RuleSet) -> Column:
    """1 or 2 for listed outlets, 3 for all others."""
    return (
        F.when(source.isin(*rules.tier_1), F.lit(1))
        .when(source.isin(*rules.tier_2), F.lit(2))
        .otherwise(F.lit(3))
    )


def _ladder(value: Column, steps: list[tuple[float, float]]) -> Column:
    """Points of the first step whose lower bound is reached, else 0."""
    branch = None
    for bound, points in steps:
        reached = value >= bound
        branch = (
            F.when(reached, F.lit(points)) if branch is None else branch.when(reached, F.lit(points))
        )
    return branch.otherwise(F.lit(0.0))


def _present(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.lit(0.05)).otherwise(F.lit(0.0))


def quality_score(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``quality_score`` in 0..1.

    The terms are doubles and are added in a fixed order: a decimal total of exactly
    0.40 may come out just below the list gate, and has to do so everywhere.
    """
    df = df.withColumns(
        {
            "_words": word_count(F.col("content")),
            "_title_words": word_count(F.col("title")),
            "_tier": source_tier(F.col("source"), rules),
        }
    )
    depth = _ladder(F.col("_words"), [(800, 0.30), (400, 0.20), (200, 0.10)])
    relevance = _ladder(F.col("eu_relevance"), [(7.0, 0.25), (5.0, 0.18), (3.0, 0.10)])
    title = (
        F.when(F.col("_title_words").between(5, 20), F.lit(0.15))
        .when(F.col("_title_words").between(3, 25), F.lit(0.08))
        .otherwise(F.lit(0.0))
    )
    outlet = (
        F.when(F.col("_tier") == 1, F.lit(0.15))
        .when(F.col("_tier") == 2, F.lit(0.10))
        .otherwise(F.lit(0.05))
    )
    metadata = (
        _present(F.col("category")) + _present(F.col("country")) + _present(F.col("summary"))
    )
    total = depth + relevance + title + outlet + metadata
    scored = computed_once(df, {"quality_score": F.least(total, F.lit(1.0))})
    return scored.drop("_words", "_title_words", "_tier")


def quality_gate(df: DataFrame, gate: float) -> DataFrame:
    return df.filter(F.col("quality_score") >= F.lit(gate))
