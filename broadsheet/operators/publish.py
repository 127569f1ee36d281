"""Markdown documents of articles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_CONFIG, EngineConfig
from broadsheet.functions.markdown import body, document_date, filename, frontmatter
from broadsheet.operators.ingest import timestamp


def last_write_wins(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row per key.

    The winners are found on (key, order) with map-side aggregation and joined back on
    the unique order value: a key shared by very many rows is not gathered anywhere.
    """
    winners = df.groupBy(key).agg(F.max(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def markdown_docs(
    articles: DataFrame,
    as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG,
    escape: bool = False,
) -> DataFrame:
    """One document (filename, doc_date, body) per article; later articles overwrite.

    Written with ``partitionBy("doc_date")`` this is the published tree.
    """
    now = timestamp(as_of)
    named = articles.withColumn("filename", filename(F.col("title"), F.col("published_date"), now))
    kept = last_write_wins(named, "filename")
    columns = {c: F.col(c) for c in (
        "title", "published_date", "source", "url", "category", "country", "summary")}
    header = frontmatter(columns, now, config, escape)
    return kept.select(
        "filename",
        document_date(F.col("published_date"), now).alias("doc_date"),
        body(header, F.col("content")).alias("body"),
    )
