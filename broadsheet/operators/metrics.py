"""Per-source run metrics and model-call telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fetched_by_source(articles: DataFrame) -> DataFrame:
    """Articles per source before deduplication."""
    return articles.groupBy("source").agg(F.count("*").alias("articles_fetched"))


def stored_by_source(stored: DataFrame) -> DataFrame:
    return stored.groupBy("source").agg(F.count("*").alias("articles_stored"))


def passed_relevance(scored: DataFrame, threshold: float) -> DataFrame:
    passed = F.count_if(F.col("eu_relevance") >= F.lit(threshold))
    return scored.groupBy("source").agg(passed.alias("articles_passed_relevance"))


def _exact(value: Column) -> Column:
    """A score as a decimal: sums of doubles would depend on the order of the rows."""
    return value.cast("decimal(18,6)")


def _mean(total: Column, n: Column) -> Column:
    """Mean to two decimals, half up; NULL for no rows."""
    ratio = F.try_divide(total.cast("decimal(20,6)"), n.cast("decimal(13,0)"))
    return F.round(ratio, 2).cast("double")


def avg_nonzero(scored: DataFrame, column: str, out: str) -> DataFrame:
    """Mean of the non-zero values per source, two decimals; NULL if there is none."""
    value = F.nullif(F.col(column), F.lit(0.0))
    sums = scored.groupBy("source").agg(
        F.sum(_exact(value)).alias("_sum"), F.count(value).alias("_n")
    )
    return sums.select("source", _mean(F.col("_sum"), F.col("_n")).alias(out))


def distribution_json(entries: Column) -> Column:
    """JSON object of (category, n) entries with sorted keys; NULL for no entries."""
    table = F.map_from_entries(F.array_sort(entries))
    return F.when(F.size(entries) > 0, F.to_json(table))


def category_distribution(scored: DataFrame) -> DataFrame:
    """Articles per category of each source as JSON text; blank categories are skipped."""
    counts = scored.groupBy("source", "category").agg(F.count("*").alias("n"))
    named = F.coalesce(F.col("category"), F.lit("")) != ""
    entries = F.collect_list(F.when(named, F.struct("category", "n")))
    return counts.groupBy("source").agg(
        distribution_json(entries).alias("category_distribution")
    )


def metric_parts(
    scored: DataFrame, keys: list[str], threshold: float, *more: Column
) -> DataFrame:
    """Sums by ``keys`` and category from which :func:`merged_metrics` makes the means."""
    eu = F.nullif(F.col("eu_relevance"), F.lit(0.0))
    quality = F.nullif(F.col("quality_score"), F.lit(0.0))
    return scored.groupBy(*keys, F.nullif(F.col("category"), F.lit("")).alias("category")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("eu_relevance") >= F.lit(threshold)).alias("passed"),
        F.sum(_exact(eu)).alias("eu_sum"), F.count(eu).alias("eu_n"),
        F.sum(_exact(quality)).alias("q_sum"), F.count(quality).alias("q_n"), *more,
    )


def merged_metrics(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and the distribution of categories by ``keys`` of any number of parts."""
    sums = {c: F.sum(c).alias(c) for c in ("n", "passed", "eu_sum", "eu_n", "q_sum", "q_n")}
    merged = parts.groupBy(*keys, "category").agg(*sums.values())
    labelled = F.when(F.col("category").isNotNull(), F.struct("category", "n"))
    return merged.groupBy(*keys).agg(
        F.sum("n").alias("articles"),
        F.sum("passed").alias("passed_relevance"),
        _mean(F.sum("eu_sum"), F.sum("eu_n")).alias("avg_eu_relevance"),
        _mean(F.sum("q_sum"), F.sum("q_n")).alias("avg_quality_score"),
        distribution_json(F.collect_list(labelled)).alias("category_distribution"),
    )


def source_run_metrics(
    fetched: DataFrame, scored: DataFrame, stored: DataFrame, threshold: float
) -> DataFrame:
    """All metrics of a run per source, 0 or NULL where a source has no rows.

    The three inputs are tagged and stacked instead of joined: the counts are summed up
    on the map side by (source, category), which leaves a handful of rows per source.
    """
    zero = F.lit(None).cast("double")

    def tagged(df: DataFrame, tag: str, category: Column, eu: Column, quality: Column) -> DataFrame:
        return df.select(
            "source", F.lit(tag).alias("tag"), category.alias("category"), eu.alias("eu"),
            quality.alias("quality"),
        )

    none = F.lit(None).cast("string")
    rows = (
        tagged(fetched, "fetched", none, zero, zero)
        .unionByName(tagged(stored, "stored", none, zero, zero))
        .unionByName(
            tagged(
                scored, "scored", F.nullif(F.col("category"), F.lit("")),
                F.nullif(F.col("eu_relevance"), F.lit(0.0)),
                F.nullif(F.col("quality_score"), F.lit(0.0)),
            )
        )
    )
    parts = rows.groupBy("source", "category").agg(
        F.count_if(F.col("tag") == "fetched").alias("fetched"),
        F.count_if(F.col("tag") == "stored").alias("stored"),
        F.count_if(F.col("tag") == "scored").alias("n"),
        F.count_if(F.col("eu") >= F.lit(threshold)).alias("passed"),
        F.sum(_exact(F.col("eu"))).alias("eu_sum"),
        F.count("eu").alias("eu_n"),
        F.sum(_exact(F.col("quality"))).alias("q_sum"),
        F.count("quality").alias("q_n"),
    )
    labelled = F.when(F.col("category").isNotNull(), F.struct("category", "n"))
    return parts.groupBy("source").agg(
        F.sum("fetched").alias("articles_fetched"),
        F.sum("stored").alias("articles_stored"),
        F.sum("passed").alias("articles_passed_relevance"),
        _mean(F.sum("eu_sum"), F.sum("eu_n")).alias("avg_eu_relevance"),
        _mean(F.sum("q_sum"), F.sum("q_n")).alias("avg_quality_score"),
        distribution_json(F.collect_list(labelled)).alias("category_distribution"),
    )


def source_counts(fetched: DataFrame, scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Fetched, scored and stored articles of every source that has any of them."""
    rows = (
        fetched.select("source", F.lit("fetched").alias("tag"))
        .unionByName(scored.select("source", F.lit("scored").alias("tag")))
        .unionByName(stored.select("source", F.lit("stored").alias("tag")))
    )
    return rows.groupBy("source").agg(
        *[F.count_if(F.col("tag") == t).alias(t) for t in ("fetched", "scored", "stored")]
    )


def metric_rows(metrics: DataFrame, run_id: str | Column, at: Column) -> DataFrame:
    """Metrics in the form of the metrics table."""
    run = run_id if isinstance(run_id, Column) else F.lit(run_id)
    return metrics.select(
        run.alias("run_id"),
        F.col("source").alias("source_name"),
        "articles_fetched",
        "articles_stored",
        "articles_passed_relevance",
        "avg_eu_relevance",
        "avg_quality_score",
        "category_distribution",
        at.alias("timestamp"),
    )


def call_outcomes(telemetry: DataFrame, group: list[str], stage: str = "classification") -> DataFrame:
    """Answered and failed calls of one stage."""
    in_stage = F.col("prompt_version").startswith(stage)
    ok = F.col("status") == "ok"
    return telemetry.groupBy(*group).agg(
        F.count_if(in_stage & ok).alias("calls_ok"),
        F.count_if(in_stage & ~ok).alias("calls_failed"),
    )


def classification_summary(classified: DataFrame) -> DataFrame:
    """One row: articles, ok and failed calls, budget-skipped and keyword-only articles.

    Expects ``called``, ``budget_skipped`` and the outcome's ``call_status``.
    """
    ok = F.col("called") & (F.col("call_status") == "ok")
    failed = F.col("called") & (F.col("call_status") != "ok")
    return classified.agg(
        F.count("*").alias("classified"),
        F.count_if(ok).alias("calls_ok"),
        F.count_if(failed).alias("calls_failed"),
        F.count_if(F.col("budget_skipped")).alias("budget_skipped"),
        F.count_if(~F.col("called") & ~F.col("budget_skipped")).alias("keyword_only"),
    )


def token_total(telemetry: DataFrame, group: list[str]) -> DataFrame:
    tokens = F.coalesce(F.col("tokens_in"), F.lit(0)) + F.coalesce(F.col("tokens_out"), F.lit(0))
    return telemetry.groupBy(*group).agg(
        F.count("*").alias("calls"), F.sum(tokens).alias("tokens")
    )


def summarized_count(articles: DataFrame) -> DataFrame:
    present = F.coalesce(F.col("summary"), F.lit("")) != ""
    return articles.agg(F.count_if(present).alias("summarized"), F.count("*").alias("articles"))
