"""Landed feed files as a stream: parsed, cut, scored and stored a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.config import DEFAULT_CONFIG, DEFAULT_RULES, EngineConfig, RuleSet
from broadsheet.operators.ingest import entry_articles, feed_entries
from broadsheet.session import materialize, scratch_scope
from broadsheet.sources.feeds import parse_files
from broadsheet.sources.tables import read_if_exists
from broadsheet.streaming.ingest import add_batch

REJECTS = "path STRING, record STRING, batch_id BIGINT"


def read_feed_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder: (path, value), a file per row."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def feed_articles(
    parsed: DataFrame, pages: DataFrame, as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG, rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Articles of parsed feed files (see ``sources.feeds.parse_files``); each file is cut by
    itself, as one fetch of its feed."""
    entries = feed_entries(parsed.filter("record IS NULL").withColumnRenamed("path", "feed_url"))
    return entry_articles(entries, pages, as_of, config, rules)


def start_feed_ingest(
    files: DataFrame,
    pages: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    store_path: str,
    rejects_path: str,
    checkpoint: str,
    as_of: datetime | str | Column,
    kind: str = "rss",
    buckets: int = 256,
    merge_every: int = 16,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> StreamingQuery:
    """Store the unknown articles of a stream of feed files and stop at its end.

    ``score`` turns articles into scored ones. A broken file goes to the rejects table with its
    text and stops nothing. Store and rejects have a partition per micro-batch, which a batch
    that is run again overwrites.
    """

    def feed_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            parsed = materialize(parse_files(batch, kind), "feeds")
            parsed.filter("record IS NOT NULL").select("path", "record").write.mode(
                "overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")
            articles = score(feed_articles(parsed, pages, as_of, config, rules))
            add_batch(articles, batch_id, store_path, as_of, buckets, merge_every, config)

    return (
        files.writeStream.foreachBatch(feed_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_rejects(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_exists(spark, path, REJECTS)
