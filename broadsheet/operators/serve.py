"""The published list: filters, pages and lookups on the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_CONFIG, EngineConfig
from broadsheet.schemas import CATEGORIES, COUNTRIES, LEGACY_CATEGORIES
from broadsheet.session import materialize
from broadsheet.sources.tables import read_table

PAGE_COLUMNS = (
    "id", "title", "url", "source", "category", "country", "quality_score", "summary",
    "image_url", "created_at", "published_date",
)


_LISTED = (
    "id BIGINT, title STRING, url STRING, source STRING, category STRING, country STRING, "
    "quality_score DOUBLE, summary STRING, image_url STRING, created_at TIMESTAMP_NTZ, "
    "published_date TIMESTAMP_NTZ, shown_at TIMESTAMP_NTZ, place INT"
)


def write_served(store: DataFrame, path: str) -> DataFrame:
    """The store as the table that readers are served from, one folder per category.

    Rows are rebalanced first, so that not every task writes a file into each folder.
    """
    store.hint("rebalance", "category").write.mode("overwrite").partitionBy("category").parquet(path)
    return store.sparkSession.read.schema(store.schema).parquet(path)


def published_view(store: DataFrame, config: EngineConfig = DEFAULT_CONFIG) -> DataFrame:
    """Rows shown to readers: on topic, relevant (or of unknown relevance) and good enough.

    All predicates are on plain columns. On a table of :func:`write_served` they reach the
    scan: the category picks folders, the rest is pushed into the files.
    """
    shown = F.col("category") != "other"
    if config.relevance_threshold > 0:
        relevance = F.col("eu_relevance")
        shown = shown & ((relevance >= F.lit(config.relevance_threshold)) | relevance.isNull())
    return store.filter(shown & (F.col("quality_score") >= F.lit(config.list_gate)))


def facet_filter(
    store: DataFrame,
    category: str | None = None,
    country: str | None = None,
    min_quality: float = 0.0,
) -> DataFrame:
    """Narrow by category, country and quality; unknown names and bounds are refused."""
    if category is not None and category not in CATEGORIES + LEGACY_CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    if country is not None and country not in COUNTRIES:
        raise ValueError(f"unknown country: {country}")
    if not 0.0 <= min_quality <= 1.0:
        raise ValueError("min_quality must be within 0..1")
    if category is not None:
        store = store.filter(F.col("category") == category)
    if country is not None:
        store = store.filter(F.col("country") == country)
    if min_quality > 0.0:
        store = store.filter(F.col("quality_score") >= F.lit(min_quality))
    return store


def _shown_at() -> Column:
    return F.coalesce(F.col("published_date"), F.col("created_at"))


def article_page(store: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the list, newest first, ties by id."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    ordered = store.select(*PAGE_COLUMNS).orderBy(_shown_at().desc(), F.col("id"))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def article_page_after(
    store: DataFrame, last_shown_at: datetime, last_id: int, limit: int = 50
) -> DataFrame:
    """The page after a given row: deep paging without carrying all rows before it."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    last = F.lit(str(last_shown_at)).cast("timestamp_ntz")
    after = (_shown_at() < last) | ((_shown_at() == last) & (F.col("id") > F.lit(last_id)))
    return article_page(store.filter(after), limit)


def write_page_index(view: DataFrame, path: str, rows_per_range: int = 10_000) -> None:
    """Write a list of articles in its order, in ranges, with the number of rows of each.

    For one list (a view and its facets) that is paged through often: the served columns are
    range-partitioned by (shown at, id) into folders ``place=N``, and ``path/counts`` has one
    row per range.
    """
    spark = view.sparkSession
    rows = materialize(view.select(*PAGE_COLUMNS, _shown_at().alias("shown_at")), "listed")
    ranges = max(1, -(-rows.count() // rows_per_range))
    rows = rows.repartitionByRange(ranges, F.desc("shown_at"), F.col("id")).withColumn(
        "place", F.spark_partition_id())
    rows.write.mode("overwrite").partitionBy("place").parquet(f"{path}/rows")
    counted = read_table(spark, f"{path}/rows", _LISTED).groupBy("place").agg(F.count("*").alias("n"))
    counted.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


def indexed_page(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """The page at any offset of a list written by :func:`write_page_index`.

    The counts, one number per range, say which range the offset falls into and how far; only
    that range is read, and the next ones where the page goes on there.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    if offset < 0:
        raise ValueError("offset must not be negative")
    before = F.sum("n").over(W.orderBy("place")) - F.col("n")  # a row per range
    counts = read_table(spark, f"{path}/counts", "place INT, n BIGINT").select("place", "n", before.alias("before"))
    met = counts.filter(
        (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    ).orderBy("place").collect()  # as many ranges as a page can touch
    skipped = offset - met[0].before if met else 0
    rows = read_table(spark, f"{path}/rows", _LISTED).filter(F.col("place").isin([r.place for r in met]))
    ordered = rows.orderBy(F.desc("shown_at"), "id").select(*PAGE_COLUMNS)
    return (ordered.offset(skipped) if skipped else ordered).limit(limit)


def filtered_total(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("total"))


def articles_by_id(store: DataFrame, ids: DataFrame) -> DataFrame:
    """Store rows of a table of ids."""
    return store.select(*PAGE_COLUMNS).join(ids.select("id"), "id", "left_semi")
