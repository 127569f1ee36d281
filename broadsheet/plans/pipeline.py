"""The article pipeline: collect, deduplicate, classify, summarise, score, store."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_CONFIG, DEFAULT_RULES, EngineConfig, RuleSet
from broadsheet.functions.text import article_hash
from broadsheet.operators import metrics as M
from broadsheet.operators.budget import budget_gate, usage_total
from broadsheet.operators.classify import classify, join_response, mode_of
from broadsheet.operators.dedup import ordered_dedup
from broadsheet.operators.ingest import entry_articles, timestamp, union_channels, web_articles
from broadsheet.operators.quality import quality_gate, quality_score
from broadsheet.operators.runs import completed_count, run_event
from broadsheet.operators.store import assign_ids, next_id, store_upsert
from broadsheet.operators.summarize import choose_summary, summarizable
from broadsheet.schemas import RUN_EVENT, RUN_STORE
from broadsheet.session import materialize, scratch_scope
from broadsheet.sources.tables import (
    append_table, read_if_exists, write_run, write_run_metrics, write_run_telemetry,
)

CLASSIFICATION, SUMMARY = "classification", "summary"


def deduplicated(articles: DataFrame, config: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    hashed = articles.withColumn(
        "article_hash", article_hash(F.col("title"), F.col("url"), F.col("source"))
    )
    return ordered_dedup(hashed, config=config).drop("article_hash")


def _tokens(response: str) -> Column:
    return usage_total(F.col(response)["tokens_in"], F.col(response)["tokens_out"])


def budget_flags(articles: DataFrame, config: EngineConfig) -> DataFrame:
    """Per article whether the token budget allows its two calls.

    All classification calls come first in article order, then all summary calls, with
    one running total over both.
    """
    calls = []
    if config.classification_enabled:
        calls.append(articles.select("seq", F.lit(0).alias("stage"), _tokens("response").alias("tokens")))
    if config.summary_enabled:
        eligible = articles.filter(summarizable(F.col("content"), config.min_summary_chars))
        calls.append(
            eligible.select("seq", F.lit(1).alias("stage"), _tokens("summary_response").alias("tokens"))
        )
    stacked = calls[0] if len(calls) == 1 else calls[0].unionByName(calls[1])
    # three numbers per call
    gated = budget_gate(
        stacked.withColumn("run", F.lit(0)), config.token_cap, F.col("tokens"), ["run"],
        ["stage", "seq"],
    )
    return gated.groupBy("seq").agg(
        F.max(F.when(F.col("stage") == 0, F.col("allowed"))).alias("call_allowed"),
        F.max(F.when(F.col("stage") == 1, F.col("allowed"))).alias("summary_allowed"),
    )


def score_articles(
    articles: DataFrame,
    responses: DataFrame | None,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Classified, summarised and scored articles of a deduplicated batch.

    Responses and budget decisions are joined on ``seq``, the key the batch is already
    partitioned by after deduplication, so the texts are shuffled once.
    """
    summaries = mode_of(config) if config.summary_enabled else "disabled"
    if config.summary_enabled and not config.classification_enabled:
        summaries = "shadow" if config.shadow_mode else "live"
    allowed = summary_allowed = None
    if config.classification_enabled:
        articles = join_response(articles, responses, CLASSIFICATION)
    if config.summary_enabled:
        articles = join_response(articles, responses, SUMMARY, out="summary_response")
    if config.token_cap and (config.classification_enabled or config.summary_enabled):
        articles = articles.join(budget_flags(articles, config), "seq", "left")
        allowed, summary_allowed = F.col("call_allowed"), F.col("summary_allowed")
    labelled = classify(articles, mode_of(config), rules, allowed)
    summarised = choose_summary(labelled, summaries, config.min_summary_chars, summary_allowed)
    return quality_score(summarised, rules)


def telemetry_rows(scored: DataFrame, run_id: str, at: Column, config: EngineConfig) -> DataFrame | None:
    """One row per call really made; None if both stages are off."""

    def stage(called: str, response: str, outcome: str, version: str) -> DataFrame:
        answer = F.col(response)
        return scored.filter(F.col(called)).select(
            F.lit(run_id).alias("run_id"),
            F.col("url").alias("article_url"),
            F.coalesce(answer["model"], F.lit("")).alias("model"),
            F.lit(version).alias("prompt_version"),
            F.coalesce(answer["latency_ms"], F.lit(0)).alias("latency_ms"),
            F.coalesce(answer["tokens_in"], F.lit(0)).alias("tokens_in"),
            F.coalesce(answer["tokens_out"], F.lit(0)).alias("tokens_out"),
            F.col(outcome)["status"].alias("status"),
            F.col(outcome)["fallback_reason"].alias("fallback_reason"),
            at.alias("timestamp"),
        )

    parts = []
    if config.classification_enabled:
        parts.append(stage("called", "response", "outcome", config.classification_version))
    if config.summary_enabled:
        parts.append(stage("summary_called", "summary_response", "summary_outcome", config.summary_version))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def article_pipeline(
    articles: DataFrame,
    responses: DataFrame | None,
    store: DataFrame | None,
    as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Rows a run adds to the store.

    The articles that pass the quality gate are written to the shared folder once; the
    comparison with the store works on their keys.
    """
    scored = score_articles(deduplicated(articles, config), responses, config, rules)
    gated = materialize(quality_gate(scored, config.store_gate), "gated")
    return store_upsert(gated, store, as_of)


@dataclass(frozen=True)
class Tables:
    """Locations of the engine's tables."""

    store: str
    metrics: str
    telemetry: str
    runs: str


def run_pipeline(
    spark: SparkSession,
    run_id: str,
    articles: DataFrame,
    responses: DataFrame | None,
    tables: Tables,
    as_of: datetime,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> int:
    """Run the pipeline: store, metrics, telemetry and run log. Returns the stored articles.

    Each of the first three tables has a partition per run, which the run overwrites, and the
    store is compared with the other runs' partitions only. They are written in a fixed order;
    the "completed" event comes last and says that all are there. So a run that failed
    anywhere is repeated under its id with the same result as one that never failed, and a
    completed one is not run again. The scored batch feeds all sinks and is written once to
    the shared folder. A failure is logged and raised.
    """
    log = read_if_exists(spark, tables.runs, RUN_EVENT)
    if log is not None and (done := completed_count(log, run_id)) is not None:
        return done
    append_table(run_event(spark, run_id, "running", as_of), tables.runs)
    try:
        with scratch_scope(spark):
            count = _run(spark, run_id, articles, responses, tables, as_of, config, rules)
        done = run_event(spark, run_id, "completed", as_of, result_count=count)
        append_table(done, tables.runs)
        return count
    except Exception as problem:
        failed = run_event(spark, run_id, "failed", as_of, error_message=str(problem))
        append_table(failed, tables.runs)
        raise


def _run(
    spark: SparkSession, run_id: str, articles: DataFrame, responses: DataFrame | None,
    tables: Tables, as_of: datetime, config: EngineConfig, rules: RuleSet,
) -> int:
    scored = materialize(
        score_articles(deduplicated(articles, config), responses, config, rules), "scored"
    )
    calls = telemetry_rows(scored, run_id, timestamp(as_of), config)
    if calls is not None:
        write_run_telemetry(calls, tables.telemetry, run_id)

    store = read_if_exists(spark, tables.store, RUN_STORE)
    if store is not None:  # of this run's own rows, if it failed before, none counts
        store = store.filter(F.col("run_id") != run_id)
    gated = quality_gate(scored, config.store_gate)
    first_id = 1 if store is None else next_id(store)
    # written before the store, which changes the table this plan reads
    new = materialize(
        assign_ids(store_upsert(gated, store, as_of, config), first_id), "stored"
    )
    write_run(new, tables.store, run_id)

    per_source = M.source_run_metrics(
        articles.select("source"),
        scored.select("source", "category", "eu_relevance", "quality_score"),
        new.select("source"),
        config.relevance_threshold,
    )
    write_run_metrics(M.metric_rows(per_source, run_id, timestamp(as_of)), tables.metrics, run_id)
    return new.count()


def collected(
    entries: DataFrame,
    entry_pages: DataFrame,
    list_pages: DataFrame,
    fetched_pages: DataFrame,
    as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Articles of both channels: feed entries with their pages, and the links of list pages."""
    feed = entry_articles(entries, entry_pages, as_of, config, rules)
    web = web_articles(list_pages, fetched_pages, config, rules)
    return union_channels(feed, web)
