"""Feed entries and web pages to articles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_CONFIG, DEFAULT_RULES, EngineConfig, RuleSet
from broadsheet.functions.dates import parse_date
from broadsheet.functions.keywords import any_match, literal_array, sql_text
from broadsheet.functions.text import clean_text, decode_entities, let, strip, valid_image_url
from broadsheet.functions.urls import resolve_url
from broadsheet.operators.columns import computed_once


def timestamp(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


# --- sources ------------------------------------------------------------------------


def normalize_source(source: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Canonical source name; an unknown name passes through.

    The rule set's alias list is a literal map; alias tables go through
    :func:`join_source_alias`.
    """
    if not rules.aliases:
        return source
    pairs = ", ".join(f"{sql_text(a)}, {sql_text(c)}" for a, c in rules.aliases.items())
    table = F.expr(f"map({pairs})")
    return F.coalesce(F.try_element_at(table, source), source)


def join_source_alias(df: DataFrame, aliases: DataFrame, column: str = "source") -> DataFrame:
    """Rename sources through an alias table (``alias``, ``canonical``) of any size.

    Adaptive execution splits the rows of a hot source.
    """
    table = aliases.select(F.col("alias").alias(column), "canonical").dropDuplicates([column])
    joined = df.join(table, column, "left")
    renamed = joined.withColumn(column, F.coalesce(F.col("canonical"), F.col(column)))
    return renamed.select(*df.columns)


# --- cuts ---------------------------------------------------------------------------


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int,
            place: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group; ``place`` names a column for their 1-based place.

    ``row_number() <= n`` is limited on both sides of the shuffle, so a group of any
    size sends at most ``n`` rows per input partition.
    """
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    cut = df.withColumn(place or "_rank", rank).filter(F.col(place or "_rank") <= n)
    return cut if place else cut.drop("_rank")


def fresh(df: DataFrame, as_of: datetime | str | Column, max_age_days: int,
          column: str = "published_date") -> DataFrame:
    """Rows not older than ``max_age_days``; undated rows stay."""
    oldest = timestamp(as_of) - F.make_dt_interval(days=F.lit(max_age_days))
    return df.filter(F.col(column).isNull() | (F.col(column) >= oldest))


# --- feed entries -------------------------------------------------------------------


def feed_entries(feeds: DataFrame) -> DataFrame:
    """One row per entry of feed rows (source_rank, feed_url, feed_title, entries)."""
    return entry_rows(
        feeds.select(
            "source_rank", "feed_url", "feed_title", F.posexplode("entries").alias("idx", "entry")
        )
    )


def entry_rows(rows: DataFrame) -> DataFrame:
    """Entry columns of rows with a single ``entry``, missing fields filled in.

    A feed without title is named by its url, an entry without title is "No title", one
    without link has the link ''.
    """
    entry = F.col("entry")
    return rows.select(
        "source_rank",
        "feed_url",
        F.coalesce(F.col("feed_title"), F.col("feed_url")).alias("feed_title"),
        F.col("idx").cast("bigint").alias("idx"),
        F.coalesce(entry["title"], F.lit("No title")).alias("title"),
        F.coalesce(entry["link"], F.lit("")).alias("link"),
        F.coalesce(entry["summary"], F.lit("")).alias("summary"),
        F.coalesce(entry["published"], F.lit("")).alias("published"),
        entry["content"].alias("content"),
        entry["media_content"].alias("media_content"),
        entry["enclosures"].alias("enclosures"),
    )


def feed_text(content: Column, summary: Column) -> Column:
    """Cleaned text of the first content element, else of the summary, else NULL."""
    full = F.nullif(clean_text(F.get(content, F.lit(0))["value"]), F.lit(""))
    short = F.nullif(clean_text(summary), F.lit(""))
    return F.coalesce(full, short)


def feed_image(page_image: Column, media: Column, enclosures: Column) -> Column:
    """Page image, else the first media element's url, else the first image enclosure."""
    usable = F.filter(
        F.transform(
            F.filter(enclosures, lambda e: F.startswith(F.coalesce(e["type"], F.lit("")), F.lit("image/"))),
            lambda e: valid_image_url(e["href"]),
        ),
        lambda url: url.isNotNull(),
    )
    return F.coalesce(
        valid_image_url(page_image),
        valid_image_url(F.get(media, F.lit(0))["url"]),
        F.get(usable, F.lit(0)),
    )


def content_fallback(page_text: Column, from_feed: Column, min_chars: int = 200) -> Column:
    """Page text, or the feed's text where the page gave little and the feed has more."""
    page_text = F.coalesce(page_text, F.lit(""))
    better = (F.length(page_text) < min_chars) & (F.length(from_feed) > F.length(page_text))
    return F.when(better, from_feed).otherwise(page_text)


def join_entry_page(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Attach the fetched page (url, page_text, page_image) of each entry's link."""
    fetched = pages.select(F.col("url").alias("_link"), "page_text", "page_image")
    keyed = entries.withColumn("_link", F.nullif(F.col("link"), F.lit("")))
    return keyed.join(fetched, "_link", "left").drop("_link")


def entry_articles(
    entries: DataFrame,
    pages: DataFrame,
    as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Articles of the feed channel: cut per feed, drop stale entries, join pages.

    Stale entries count towards the per-feed limit.
    """
    cut = first_n(entries, ["source_rank"], ["idx"], config.per_source_limit, "_place")
    # at most per_source_limit places per source are left, so this is unique
    seq = F.col("source_rank") * F.lit(config.per_source_limit) + F.col("_place") - 1
    dated = cut.withColumn("published_date", parse_date(F.col("published")))
    joined = join_entry_page(fresh(dated, as_of, config.max_age_days), pages)
    return joined.select(
        seq.alias("seq"),
        "title",
        F.col("link").alias("url"),
        normalize_source(F.col("feed_title"), rules).alias("source"),
        content_fallback(
            F.col("page_text"), feed_text(F.col("content"), F.col("summary")), config.min_summary_chars
        ).alias("content"),
        "summary",
        "published_date",
        feed_image(F.col("page_image"), F.col("media_content"), F.col("enclosures")).alias("image_url"),
    )


# --- web pages ----------------------------------------------------------------------


def _meta(html: Column, name: str) -> Column:
    """Content of a <meta> element, whichever attribute comes first."""
    named = rf"(?is)<meta\b[^>]*?(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"']"
    reverse = rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*?(?:name|property)\s*=\s*[\"']{name}[\"']"
    first = F.nullif(F.regexp_extract(html, named, 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(html, reverse, 1), F.lit("")))


# Elements that hold no text of the page's own, and those that begin or end a block of text.
_ASIDE = (
    r"(?s)<!--.*?-->|(?is)<(script|style|template|noscript|head|nav|header|footer|aside|form|"
    r"select|button|iframe|svg)\b[^>]*>.*?</\1\s*>"
)
_BLOCK_TAG = (
    r"(?i)</?(?:address|article|blockquote|body|center|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|html|"
    r"li|main|ol|p|pre|section|table|tbody|td|th|tr|ul)\b[^>]*>"
)
_LINK_TEXT = r"(?is)<a\b[^>]*>(.*?)</a\s*>"


def main_text(html: Column, link_weight: int = 3, block_cost: int = 40) -> Column:
    """The cleaned main text of a page without an <article>: its best run of blocks.

    The page is cut at block tags, after menus, headers, footers, forms and scripts are gone.
    A block scores its characters, less ``link_weight`` times those inside links, less
    ``block_cost`` if there are any; so lists of links and short notices lower a run, and short paragraphs
    between long ones don't end it. The run of blocks with the highest sum is taken, the first
    to reach it, without blocks in front that add nothing. If no block scores, all are taken.
    One pass over the blocks, all in the row.
    """

    def scored(block: Column, k: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(block, "<[^>]*>", " "), "[ \\t\\n\\r\\f]+", " ")
        links = F.transform(
            F.regexp_extract_all(block, F.lit(_LINK_TEXT), F.lit(1)),
            lambda inner: F.regexp_replace(inner, "<[^>]*>", ""),
        )
        return F.struct(
            k.alias("k"),
            let(F.length(F.trim(plain)), lambda n: F.when(
                n > 0, n - link_weight * F.length(F.array_join(links, "")) - block_cost
            ).otherwise(0)).alias("score"),
        )

    def state(best: Column, low: Column, high: Column, here: Column, start: Column) -> Column:
        return F.struct(best.alias("best"), low.alias("low"), high.alias("high"),
                        here.alias("here"), start.alias("start"))

    def step(acc: Column, block: Column) -> Column:
        go_on = acc["here"] > 0
        here = F.when(go_on, acc["here"]).otherwise(0) + block["score"]
        start = F.when(go_on, acc["start"]).otherwise(block["k"])
        better = here > acc["best"]
        return state(
            F.when(better, here).otherwise(acc["best"]),
            F.when(better, start).otherwise(acc["low"]),
            F.when(better, block["k"]).otherwise(acc["high"]), here, start,
        )

    def chosen(blocks: Column) -> Column:
        nothing = state(F.lit(0), F.lit(0), F.size(blocks) - 1, F.lit(0), F.lit(0))
        return let(
            F.aggregate(F.transform(blocks, scored), nothing, step),
            lambda run: F.array_join(
                F.slice(blocks, run["low"] + 1, run["high"] - run["low"] + 1), " "),
        )

    return clean_text(let(F.split(F.regexp_replace(html, _ASIDE, " "), _BLOCK_TAG, -1), chosen))


def page_extract(pages: DataFrame) -> DataFrame:
    """Add title, text, summary, published_date and image of raw pages.

    The text is the <article> element, or the main text of a page where there is none.
    """
    html = F.col("html")
    article = F.nullif(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1), F.lit(""))
    when = F.coalesce(
        _meta(html, "article:published_time"),
        F.nullif(F.regexp_extract(html, r"(?is)<time\b[^>]*?\bdatetime\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")),
    )
    return computed_once(
        pages,
        {
            "page_title": clean_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)),
            "page_text": F.when(article.isNotNull(), clean_text(article)).otherwise(main_text(html)),
            "page_summary": clean_text(F.coalesce(_meta(html, "og:description"), _meta(html, "description"))),
            "page_published": parse_date(when),
            "page_image": valid_image_url(decode_entities(_meta(html, "og:image"))),
        },
    )


def link_matches(href: Column, words: Sequence[str]) -> Column:
    return any_match(F.lower(href), words)


def page_links(
    pages: DataFrame, rules: RuleSet = DEFAULT_RULES, limit: int | None = None
) -> DataFrame:
    """Distinct article links (page_id, url, place, link) of each page, in page order.

    All links of a page sit in its own row, so they are filtered, resolved, made
    distinct and cut without a shuffle.
    """
    hrefs = F.regexp_extract_all(
        F.col("html"), F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1)
    )
    words = literal_array(rules.link_keywords)
    chosen = F.filter(
        hrefs, lambda h: F.exists(words, lambda w: F.contains(F.lower(h), w))
    )
    links = F.array_distinct(
        F.transform(chosen, lambda h: resolve_url(F.col("url"), F.replace(strip(h), F.lit("&amp;"), F.lit("&"))))
    )
    if limit is not None:
        links = F.slice(links, 1, limit)
    return pages.select("page_id", "url", F.posexplode(links).alias("place", "link"))


def web_articles(
    list_pages: DataFrame,
    pages: DataFrame,
    config: EngineConfig = DEFAULT_CONFIG,
    rules: RuleSet = DEFAULT_RULES,
) -> DataFrame:
    """Articles of the web channel: links of list pages joined to the pages fetched.

    ``pages`` carries url and the columns of :func:`page_extract`. A link whose page was
    not fetched gives no article.
    """
    links = page_links(list_pages, rules, config.per_source_limit)
    source = F.col("list_url")
    if config.normalize_web_sources:
        source = normalize_source(source, rules)
    fetched = pages.select(
        F.col("url").alias("link"), "page_title", "page_text", "page_summary", "page_published", "page_image"
    )
    joined = links.select("page_id", F.col("url").alias("list_url"), "place", "link").join(
        fetched, "link"
    )
    return joined.select(
        (F.col("page_id") * F.lit(config.per_source_limit) + F.col("place")).alias("seq"),
        F.col("page_title").alias("title"),
        F.col("link").alias("url"),
        source.alias("source"),
        F.col("page_text").alias("content"),
        F.col("page_summary").alias("summary"),
        F.col("page_published").alias("published_date"),
        F.col("page_image").alias("image_url"),
    )


def union_channels(feed: DataFrame, web: DataFrame) -> DataFrame:
    """Feed articles followed by web articles in one order of ``seq``."""
    web = web.withColumn("seq", F.col("seq") + F.lit(1 << 62))
    return feed.unionByName(web, allowMissingColumns=True)
