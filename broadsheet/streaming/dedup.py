"""Unique urls of an unbounded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from broadsheet.config import DEFAULT_CONFIG, EngineConfig


def unique_urls(
    articles: DataFrame, time: str, config: EngineConfig = DEFAULT_CONFIG
) -> DataFrame:
    """The first article per url within the age limit.

    State is kept as long as an article may still be fresh; uniqueness for all time is
    the store's job.
    """
    delay = f"{config.max_age_days} days"
    return articles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
