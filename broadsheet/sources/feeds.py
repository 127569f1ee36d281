"""Landed feed files (RSS and Atom) as feed rows.

A feed row is (source_rank, feed_url, feed_title, entries); ``operators.ingest`` turns
it into entries. Files are read by Spark's XML source, one row per feed, with explicit
schemas; a file that is no feed gives no row, a broken one lands in ``rejects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize

_RSS_FIELDS = {
    "title": "STRING",
    "link": "STRING",
    "description": "STRING",
    "pubDate": "STRING",
    "date": "STRING",
    "encoded": "STRING",
    "content": "ARRAY<STRUCT<_url: STRING, _VALUE: STRING>>",
    "enclosure": "ARRAY<STRUCT<_url: STRING, _type: STRING, _VALUE: STRING>>",
}
ITEM_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _RSS_FIELDS.items())
RSS_SCHEMA = (
    "title STRING, item ARRAY<STRUCT<"
    + ", ".join(f"{name}: {kind}" for name, kind in _RSS_FIELDS.items())
    + ">>, _corrupt_record STRING"
)
_ATOM_LINK = "ARRAY<STRUCT<_href: STRING, _rel: STRING, _type: STRING, _VALUE: STRING>>"
ATOM_SCHEMA = (
    "title STRING, entry ARRAY<STRUCT<title: STRING, link: " + _ATOM_LINK + ", "
    "summary: STRING, content: STRING, published: STRING, updated: STRING>>, "
    "_corrupt_record STRING"
)
ENTRY_TYPE = (
    "ARRAY<STRUCT<title: STRING, link: STRING, summary: STRING, published: STRING, "
    "content: ARRAY<STRUCT<value: STRING>>, media_content: ARRAY<STRUCT<url: STRING>>, "
    "enclosures: ARRAY<STRUCT<type: STRING, href: STRING>>>>"
)


def _rss_entry(item: Column) -> Column:
    encoded = F.when(item["encoded"].isNotNull(), F.array(F.struct(item["encoded"].alias("value"))))
    return F.struct(
        item["title"].alias("title"),
        item["link"].alias("link"),
        item["description"].alias("summary"),
        F.coalesce(item["pubDate"], item["date"]).alias("published"),
        encoded.alias("content"),
        F.transform(
            F.filter(item["content"], lambda c: c["_url"].isNotNull()),
            lambda c: F.struct(c["_url"].alias("url")),
        ).alias("media_content"),
        F.transform(
            item["enclosure"],
            lambda e: F.struct(e["_type"].alias("type"), e["_url"].alias("href")),
        ).alias("enclosures"),
    )


def _atom_entry(entry: Column) -> Column:
    def with_rel(rel: str) -> Column:
        return F.filter(
            entry["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == F.lit(rel)
        )

    body = F.when(entry["content"].isNotNull(), F.array(F.struct(entry["content"].alias("value"))))
    return F.struct(
        entry["title"].alias("title"),
        F.get(with_rel("alternate"), F.lit(0))["_href"].alias("link"),
        F.coalesce(entry["summary"], entry["content"]).alias("summary"),
        F.coalesce(entry["published"], entry["updated"]).alias("published"),
        body.alias("content"),
        F.array().cast("array<struct<url: string>>").alias("media_content"),
        F.transform(
            with_rel("enclosure"),
            lambda x: F.struct(x["_type"].alias("type"), x["_href"].alias("href")),
        ).alias("enclosures"),
    )


def parse_item(xml: Column) -> Column:
    """Entry struct of the text of one <item> element, for feeds landed entry by entry."""
    item = F.from_xml(xml, ITEM_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return _rss_entry(item).cast(ENTRY_TYPE[len("ARRAY<"):-1])


def rss_entries(items: Column) -> Column:
    return F.transform(items, _rss_entry).cast(ENTRY_TYPE)


_RSS_FILE = "channel STRUCT<title: STRING, item: ARRAY<STRUCT<" + ", ".join(
    f"{name}: {kind}" for name, kind in _RSS_FIELDS.items()) + ">>>, _corrupt_record STRING"


def parse_files(files: DataFrame, kind: str = "rss") -> DataFrame:
    """(path, source_rank, feed_title, entries, record) of whole feed files (path, value).

    Works on a stream as well: a file is one row. A broken file, or one without the elements
    of a feed, has its text in ``record`` and no entries. Feeds are ranked by a hash of the
    path, as :func:`read_feeds` does without a table of feeds.
    """
    if kind not in ("rss", "atom"):
        raise ValueError(f"unknown kind of feed: {kind}")
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = files.withColumn(
        "_feed", F.from_xml("value", _RSS_FILE if kind == "rss" else ATOM_SCHEMA, options))
    if kind == "rss":
        title, items = F.col("_feed.channel.title"), F.col("_feed.channel.item")
        entries, empty = rss_entries(items), F.col("_feed.channel").isNull()
    else:
        title, items = F.col("_feed.title"), F.col("_feed.entry")
        entries = F.transform(items, _atom_entry).cast(ENTRY_TYPE)
        empty = title.isNull() & items.isNull()
    broken = F.col("_feed").isNull() | F.col("_feed._corrupt_record").isNotNull() | empty
    return parsed.select(
        "path",
        F.shiftrightunsigned(F.xxhash64("path"), 20).alias("source_rank"),
        F.trim(title).alias("feed_title"),
        F.when(~broken, F.coalesce(entries, F.array().cast(ENTRY_TYPE))).alias("entries"),
        F.when(broken, F.col("value")).alias("record"),
    )


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    reader = (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", tag)
        .option("ignoreNamespace", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    # saved once: good and broken records are two queries, and Spark refuses a query on raw
    # files that asks for nothing but broken records
    return materialize(reader.load(path).withColumn("_file", F.col("_metadata.file_path")), "feeds")


def read_feeds(
    spark: SparkSession, path: str, feeds: DataFrame | None = None, kind: str = "rss"
) -> tuple[DataFrame, DataFrame]:
    """Feed rows and rejects of landed files.

    ``feeds`` maps a file name to (source_rank, feed_url); without it the file's path is
    the url and feeds are ranked by a hash of it. One bad file never stops the others.
    """
    if kind not in ("rss", "atom"):
        raise ValueError(f"unknown kind of feed: {kind}")
    raw = _read(spark, path, "channel" if kind == "rss" else "feed",
                RSS_SCHEMA if kind == "rss" else ATOM_SCHEMA)
    rejects = raw.filter(F.col("_corrupt_record").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_corrupt_record").alias("record")
    )
    good = raw.filter(F.col("_corrupt_record").isNull())
    entries = rss_entries(F.col("item")) if kind == "rss" else F.transform("entry", _atom_entry).cast(ENTRY_TYPE)
    rows = good.select(
        F.element_at(F.split("_file", "/"), -1).alias("file"),
        F.col("_file").alias("path"),
        F.trim("title").alias("feed_title"),
        entries.alias("entries"),
    )
    if feeds is None:
        ranked = rows.select(
            F.shiftrightunsigned(F.xxhash64("path"), 20).alias("source_rank"),
            F.col("path").alias("feed_url"), "feed_title", "entries",
        )
    else:
        ranked = rows.join(feeds.select("file", "source_rank", "feed_url"), "file").select(
            "source_rank", "feed_url", "feed_title", "entries"
        )
    return ranked, rejects
