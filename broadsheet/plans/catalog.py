"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.config import EngineConfig
from broadsheet.functions import keywords as K
from broadsheet.functions import responses as R
from broadsheet.functions import text as T
from broadsheet.functions.dates import parse_date
from broadsheet.functions.markdown import frontmatter
from broadsheet.functions.urls import resolve_url
from broadsheet.operators import budget, classify, dedup, evaluate, ingest, metrics, publish
from broadsheet.operators.columns import computed_once
from broadsheet.operators import quality, runs, serve, store, summarize
from broadsheet.plans import pipeline
from broadsheet.schemas import RUN_STORE, SOURCE_METRIC, TELEMETRY
from broadsheet.session import materialize, scratch_path
from broadsheet.sources import benchtables as B
from broadsheet.sources import completer, feeds, tables
from broadsheet.streaming import dedup as stream_dedup
from broadsheet.streaming import feeds as stream_feeds
from broadsheet.streaming import files, ingest as stream_ingest
from broadsheet.streaming import metrics as stream_metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEMPLATE = "Outlet: {source}\nHeadline: {title}\n---\n{content}\n---\nAnswer in JSON."
DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _long(column: Column) -> Column:
    return column.cast("bigint")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    items = B.feed_items(spark, folder)
    return ingest.entry_rows(items.withColumn("entry", feeds.parse_item(F.col("xml"))).drop("xml"))


# the served table of a folder, by application: writing it is the store's job, not a reader's
_SERVED: dict[tuple[str, str], DataFrame] = {}


def _served(spark: SparkSession, folder: str) -> DataFrame:
    place = (spark.sparkContext.applicationId, folder)
    if place not in _SERVED:
        _SERVED[place] = serve.write_served(B.store(spark, folder), scratch_path(spark, "served"))
    return _SERVED[place]


def _batch_and_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scored documents: a fifth of them as the existing store, all others as the batch."""
    rows = materialize(B.scored(spark, folder), "scored")
    known = store.to_store_rows(rows.filter(F.col("seq") % 5 == 0), B.AS_OF)
    return rows.filter(F.col("seq") % 5 != 0), known.select("url", "content_hash")


def _with_response(spark: SparkSession, folder: str) -> DataFrame:
    return classify.join_response(
        B.articles(spark, folder), B.responses(spark, folder), "classification"
    )


def _labelled_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Two predictions and the human label of every labelled document."""
    score = F.col("quality_score")
    predicted = B.scored(spark, folder).select(
        F.col("seq").alias("doc_id"),
        "title",
        F.when(score >= F.lit(0.4), "keep").otherwise("drop").alias("strict"),
        F.when(score >= F.lit(0.2), "keep").otherwise("drop").alias("lenient"),
    )
    labels = B.table(spark, folder, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("human")
    )
    return evaluate.join_labels(predicted, labels, "doc_id")


CLASSES = ("keep", "drop", "defer")


# --- sources and sinks --------------------------------------------------------------


@query
def feed_entries(spark, folder):
    entries = _entries(spark, folder)
    return entries.select(
        "source_rank", "feed_url", "feed_title", "idx", "title", "link", "summary", "published",
        F.get("content", F.lit(0))["value"].alias("full_text"),
        F.get("media_content", F.lit(0))["url"].alias("media_url"),
        _long(F.greatest(F.size("enclosures"), F.lit(0))).alias("n_enclosures"),
    )


@query
def feed_channel(spark, folder):
    """The feed entries as articles, with the pages that were fetched for them."""
    return ingest.entry_articles(
        _entries(spark, folder), B.entry_pages(spark, folder), B.AS_OF, B.CONFIG, B.RULES
    )


def _landed(spark: SparkSession, folder: str) -> str:
    """A folder of feed files: a source's items of each thousand ids together."""
    path = scratch_path(spark, "landed")
    items = F.array_sort(F.collect_list(F.struct("idx", "xml")))
    B.feed_items(spark, folder).groupBy("feed_title", F.floor(F.col("idx") / 1_000)).agg(
        F.array_join(F.transform(items, lambda i: i["xml"]), "").alias("items")
    ).select(F.concat(
        F.lit("<rss><channel><title>"), "feed_title", F.lit("</title>"), "items",
        F.lit("</channel></rss>"),
    ).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query
def landed_feeds(spark, folder):
    """The same items as files of feeds, written and read back."""
    rows, _ = feeds.read_feeds(spark, _landed(spark, folder))
    return ingest.feed_entries(rows).select(
        "feed_title", "title", "link", "published", F.get("media_content", F.lit(0))["url"].alias("media_url"),
        _long(F.greatest(F.size("enclosures"), F.lit(0))).alias("n_enclosures"),
    )


def _fetched(spark: SparkSession, folder: str) -> DataFrame:
    """The pages that the links of a page lead to: those that follow it in the table."""
    pages = B.table(spark, folder, "pages")
    links = ingest.page_links(pages, B.RULES).select(
        (F.col("page_id") + F.col("place") + 1).alias("page_id"), "link")
    html = pages.select("page_id", "html")
    fetched = ingest.page_extract(links.join(html, "page_id").select(F.col("link").alias("url"), "html"))
    return fetched.groupBy("url").agg(
        F.max(F.struct("page_title", "page_text", "page_summary", "page_published", "page_image")).alias("p")
    ).select("url", "p.*")


@query
def page_scan(spark, folder):
    articles = ingest.web_articles(
        B.table(spark, folder, "pages"), _fetched(spark, folder), B.CONFIG, B.RULES
    )
    return articles.select("seq", "title", "url", "source", "content", "summary", "published_date", "image_url")


@query
def articles_csv(spark, folder):
    path = scratch_path(spark, "articles-csv")
    rows = B.articles(spark, folder).select(
        F.col("seq").cast("string").alias("id"), "url", "title", "source",
        F.lit("").alias("category"), F.lit("").alias("country"), "content", "summary",
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("published_date"),
    )
    tables.write_csv(rows, path)
    return tables.read_articles_csv(spark, path)


@query
def store_recent(spark, folder):
    recent = store.store_recent(B.store(spark, folder), 25)
    return recent.select("id", "title", "url", "source", "category", "country", "eu_relevance", "created_at")


@query
def model_responses(spark, folder):
    return B.responses(spark, folder)


def _variant(rows: DataFrame, number: int, url: str, title: str = "") -> DataFrame:
    """The same articles under other urls and titles, later in order."""
    return rows.withColumns({
        "seq": F.col("seq") + F.lit(number << 40), "url": F.concat("url", F.lit(url)),
        "title": F.concat(F.lit(title), "title"),
    })


@query
def store_upsert(spark, folder):
    """Some articles clash by their hash only, with each other and with the store."""
    batch, _ = _batch_and_store(spark, folder)
    old = B.scored(spark, folder).filter(F.col("seq") % 5 == 0)
    few, others = batch.filter(F.col("seq") % 9 == 2), batch.filter(F.col("seq") % 9 == 4)
    for rows in (_variant(few, 1, "/2|x"), _variant(few, 2, "/2", "x|"), _variant(few, 3, "/2"),
                 _variant(others, 4, "/3|y")):
        batch = batch.unionByName(rows)
    known = store.to_store_rows(
        old.unionByName(_variant(others, 5, "/3", "y|")), B.AS_OF).select("url", "content_hash")
    return store.store_upsert(materialize(batch, "batch"), known, B.AS_OF).drop("image_url")


@query
def source_metrics_append(spark, folder):
    path = scratch_path(spark, "metrics")
    at = ingest.timestamp(B.AS_OF)
    tables.append_metrics(metrics.metric_rows(source_run_metrics(spark, folder), "run-1", at), path)
    return spark.read.parquet(path)


@query
def telemetry_append(spark, folder):
    path = scratch_path(spark, "telemetry")
    calls = B.telemetry(spark, folder).withColumn("latency_ms", F.col("tokens_in") * 3)
    rows = calls.withColumn(
        "fallback_reason", F.when(F.col("status") != "ok", F.concat(F.col("status"), F.lit(": ")))
    )
    tables.append_telemetry(rows, path)
    return spark.read.parquet(path)


@query
def change_log_csv(spark, folder):
    path = scratch_path(spark, "changes")
    tables.write_csv(reclassify_diff(spark, folder), path)
    columns = (
        "id BIGINT, title STRING, old_category STRING, new_category STRING, old_country STRING, "
        "new_country STRING, old_eu_relevance DOUBLE, new_eu_relevance DOUBLE, confidence DOUBLE"
    )
    return tables.read_articles_csv(spark, path, columns)


@query
def eval_set_csv(spark, folder):
    path = scratch_path(spark, "evalset")
    articles = B.articles(spark, folder)
    compared = classify.compare_labelers(_with_response(spark, folder), B.RULES)
    wide = compared.drop("title", "source").join(
        articles.select("seq", "url", "title", "source", "content"), "seq"
    )
    tables.write_csv(evaluate.eval_rows(wide), path)
    return tables.read_eval_set(spark, path)


@query
def markdown_docs(spark, folder):
    """A quarter of the titles are in Greek letters, a quarter in Cyrillic ones."""
    title, quarter = F.col("title"), F.col("seq") % 4
    rows = B.scored(spark, folder).withColumn(
        "title", F.when(quarter == 1, B.other_script(title, "greek"))
        .when(quarter == 2, B.other_script(title, "cyrillic")).otherwise(title))
    return publish.markdown_docs(rows, B.AS_OF, B.CONFIG)


@query
def run_log(spark, folder):
    return runs.run_log(B.run_events(spark, folder)).select(
        "id", "event_time", "status", "job_type", "result_count", "error_message", "completed_at"
    )


@query
def schema_align(spark, folder):
    old = B.articles(spark, folder).select("seq", "url", "source")
    new = store.to_store_rows(B.scored(spark, folder), B.AS_OF)
    wanted = "confidence DOUBLE, eu_relevance DOUBLE, image_url STRING, source STRING"
    aligned = store.schema_align(old, wanted)
    return aligned.unionByName(new.select(*aligned.columns))


# --- scalar functions ---------------------------------------------------------------


@query
def clean_text(spark, folder):
    pages = B.table(spark, folder, "pages")
    return pages.select("page_id", T.clean_text(F.col("html")).alias("text"))


@query
def article_hash(spark, folder):
    return B.articles(spark, folder).select(
        "seq", T.article_hash(F.col("title"), F.col("url"), F.col("source")).alias("article_hash")
    )


@query
def content_hash(spark, folder):
    return B.articles(spark, folder).select(
        "seq", T.content_hash(F.col("url"), F.col("title")).alias("content_hash")
    )


@query
def normalize_source(spark, folder):
    docs = B.table(spark, folder, "documents")
    return docs.select("doc_id", ingest.normalize_source(F.col("source"), B.RULES).alias("source"))


_DATE_LAYOUTS = (
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "EEE, dd MMM yyyy HH:mm:ss '+0000'",
    "yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+00:00'",
)


@query
def parse_date_formats(spark, folder):
    rows = B.articles(spark, folder).select("seq", "created_at")
    raw = F.lit("not a date")
    for i, layout in enumerate(_DATE_LAYOUTS):
        raw = F.when(F.col("seq") % 8 == i, F.date_format("created_at", layout)).otherwise(raw)
    return rows.select("seq", parse_date(raw).alias("published_date"))


@query
def valid_image_url(spark, folder):
    docs = B.table(spark, folder, "documents")
    start = F.get(F.array(*[F.lit(s) for s in ("https://i.example/", " http://i.example/", "ftp://i.example/", "//i.example/", "")]), (F.col("doc_id") % 5).cast("int"))
    raw = F.concat(start, F.regexp_replace("text", r"\s+", "-"), F.lit(" "))
    return docs.select("doc_id", T.valid_image_url(raw).alias("image_url"))


@query
def feed_image(spark, folder):
    page = F.when(F.col("idx") % 6 == 0, F.lit("https://img.example/page.webp"))
    return _entries(spark, folder).select(
        "idx", ingest.feed_image(page, F.col("media_content"), F.col("enclosures")).alias("image_url")
    )


@query
def feed_text(spark, folder):
    return _entries(spark, folder).select(
        "idx", ingest.feed_text(F.col("content"), F.col("summary")).alias("text")
    )


@query
def content_fallback(spark, folder):
    rows = B.articles(spark, folder)
    page = F.when(F.col("seq") % 2 == 0, F.lit("a page in short")).when(F.col("seq") % 3 == 0, F.col("content"))
    feed = F.when(F.col("seq") % 5 != 0, F.col("content"))
    return rows.select("seq", ingest.content_fallback(page, feed).alias("content"))


@query
def page_extract(spark, folder):
    number = F.col("page_id").cast("string")
    # every third page has the elements that the given pages lack
    head = F.when(F.col("page_id") % 3 == 0, F.concat(
        F.lit('<meta name="description" content="About &amp; page '), number,
        F.lit('"><meta content="https://img.example/'), number,
        F.lit('.png" property="og:image"><time datetime="2024-01-05T10:00:00Z"></time>'),
    )).otherwise(F.lit(""))
    # every second page is one without <article>, but with a notice and a list of links instead
    html = F.col("html")
    for tag, other in (("<article>", "<div>"), ("</article>", "</div><ul>" + B.RELATED + "</ul><p>" + B.NOTICE)):
        html = F.replace(html, F.lit(tag), F.lit(other))
    html = F.when(F.col("page_id") % 2 == 1, html).otherwise(F.col("html"))
    pages = B.table(spark, folder, "pages").withColumn("html", F.concat(head, html))
    return ingest.page_extract(pages).select(
        "page_id", "page_title", "page_text", "page_summary", "page_published", "page_image"
    )


@query
def resolve_urls(spark, folder):
    pages = B.table(spark, folder, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(hrefs).alias("place", "href"))
    return rows.select(
        "page_id", _long(F.col("place")).alias("place"), resolve_url(F.col("url"), F.col("href")).alias("link")
    )


@query
def slug(spark, folder):
    title = F.col("title")
    return B.articles(spark, folder).select(
        "seq", T.slug(title).alias("slug"), T.slug(B.other_script(title, "greek")).alias("greek"),
        T.slug(B.other_script(title, "cyrillic")).alias("cyrillic"),
    )


@query
def front_matter(spark, folder):
    rows = B.scored(spark, folder)
    columns = {c: F.col(c) for c in rows.columns}
    header = frontmatter(columns, ingest.timestamp(B.AS_OF), B.CONFIG)
    return rows.select("seq", header.alias("header"))


@query
def render_prompt(spark, folder):
    rows = B.articles(spark, folder)
    prompt = T.render_prompt(TEMPLATE, B.CONFIG.prompt_chars, F.col("title"), F.col("source"), F.col("content"))
    return rows.select("seq", prompt.alias("prompt"))


@query
def strip_code_fence(spark, folder):
    answers = B.responses(spark, folder).filter("stage = 'classification'")
    return answers.select("seq", R.strip_code_fence(F.col("text")).alias("body"))


@query
def parse_classification(spark, folder):
    answers = B.responses(spark, folder).filter("stage = 'classification'")
    parsed = computed_once(answers, {"p": R.parse_classification(F.col("text"))})
    return parsed.select("seq", "p.*")


@query
def parse_summary(spark, folder):
    turns = B.table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return computed_once(turns, {"p": R.parse_summary(F.col("text"))}).select("conv_id", "turn", "p.*")


@query
def word_count(spark, folder):
    docs = B.table(spark, folder, "documents")
    return docs.select("doc_id", _long(T.word_count(F.col("text"))).alias("words"))


# --- filters ------------------------------------------------------------------------


@query
def fresh_articles(spark, folder):
    rows = B.articles(spark, folder).select("seq", "published_date")
    return ingest.fresh(rows, B.AS_OF, B.CONFIG.max_age_days)


@query
def tech_relevant(spark, folder):
    rows = B.articles(spark, folder)
    text = K.search_text(F.col("title"), F.col("content"))
    return rows.withColumn("_text", text).filter(K.tech_relevant(F.col("_text"), B.RULES)).select("seq", "url")


@query
def quality_gate(spark, folder):
    return quality.quality_gate(B.scored(spark, folder), B.CONFIG.store_gate).select("seq", "quality_score")


@query
def published_view(spark, folder):
    shown = serve.published_view(_served(spark, folder), B.CONFIG)
    return shown.select("id", "category", "eu_relevance", "quality_score")


@query
def facet_filter(spark, folder):
    shown = serve.published_view(_served(spark, folder), B.CONFIG)
    narrowed = serve.facet_filter(shown, category="startups", country="France", min_quality=0.5)
    return narrowed.select("id", "category", "country", "quality_score")


@query
def filtered_total(spark, folder):
    shown = serve.published_view(_served(spark, folder), B.CONFIG)
    return serve.filtered_total(serve.facet_filter(shown, category="startups"))


@query
def link_keywords(spark, folder):
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    links = B.table(spark, folder, "pages").select("page_id", F.posexplode(hrefs).alias("place", "href"))
    return links.filter(ingest.link_matches(F.col("href"), B.RULES.link_keywords)).select(
        "page_id", _long(F.col("place")).alias("place"), "href"
    )


@query
def articles_by_id(spark, folder):
    ids = B.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    found = serve.articles_by_id(_served(spark, folder), ids)
    return found.drop("image_url")


@query
def run_state(spark, folder):
    return runs.run_state(B.run_events(spark, folder), ["event_id"])


@query
def stuck_runs(spark, folder):
    states = runs.run_state(B.run_events(spark, folder), ["event_id"])
    return runs.stuck_runs(states, B.AS_OF, B.CONFIG.stuck_minutes).select("id", "status", "started_at")


@query
def summarizable(spark, folder):
    rows = B.articles(spark, folder)
    return rows.filter(summarize.summarizable(F.col("content"), B.CONFIG.min_summary_chars)).select("seq")


@query
def labeled_only(spark, folder):
    docs = B.table(spark, folder, "documents").select("doc_id")
    label = F.when(F.col("quality") == 1, " keep ").when(F.col("toxic") == 1, "drop").otherwise("  ")
    labels = B.table(spark, folder, "labels").select("doc_id", label.alias("human_category"))
    rows = docs.join(labels, "doc_id", "left")
    return evaluate.labeled_only(rows)


@query
def short_content(spark, folder):
    rows = B.articles(spark, folder)
    return rows.filter(F.length("content") < B.CONFIG.short_chars).select("seq", _long(F.length("content")).alias("chars"))


# --- joins --------------------------------------------------------------------------


@query
def join_source_alias(spark, folder):
    docs = B.table(spark, folder, "documents").select("doc_id", "source")
    # an alias table the size of the source list: every third source is renamed
    aliases = docs.select("source").distinct().filter("substr(source, -1) in ('0', '3', '6', '9')").select(
        F.col("source").alias("alias"), F.upper("source").alias("canonical")
    )
    return ingest.join_source_alias(docs, aliases)


@query
def join_source_tier(spark, folder):
    return B.articles(spark, folder).select(
        "seq", "source", _long(quality.source_tier(F.col("source"), B.RULES)).alias("tier")
    )


@query
def semi_eu_source(spark, folder):
    rows = B.articles(spark, folder)
    return rows.filter(F.col("source").isin(*B.RULES.eu_sources)).select("seq", "source")


@query
def anti_store(spark, folder):
    rows = B.articles(spark, folder).select(
        "seq", "url", T.content_hash(F.col("url"), F.col("title")).alias("content_hash")
    )
    batch, known = rows.filter(F.col("seq") % 5 != 0), rows.filter(F.col("seq") % 5 == 0)
    return dedup.not_in_store(batch, known, config=B.CONFIG)


@query
def join_response(spark, folder):
    joined = _with_response(spark, folder)
    return joined.select("seq", "url", "response.status", "response.text", "response.tokens_in")


@query
def outer_source_counts(spark, folder):
    rows = B.scored(spark, folder).select("seq", "source", "quality_score")
    fetched = rows.filter(F.col("source") != "Sifted")
    kept = quality.quality_gate(rows, B.CONFIG.store_gate)
    return metrics.source_counts(fetched, rows.filter(F.col("source") != "TNW"), kept)


def _new_labels(spark: SparkSession, folder: str) -> DataFrame:
    outcome = classify.model_outcome(_with_response(spark, folder))
    return outcome.filter("outcome.valid").select(
        F.col("seq").alias("id"),
        F.col("outcome.category").alias("new_category"),
        F.col("outcome.country").alias("new_country"),
        F.col("outcome.eu_relevance").alias("new_eu_relevance"),
        F.col("outcome.confidence").alias("new_confidence"),
    )


@query
def join_reclassified(spark, folder):
    joined = store.join_reclassified(B.store(spark, folder), _new_labels(spark, folder))
    return joined.select("id", "category", "new_category", "country", "new_country")


@query
def join_labels(spark, folder):
    return _labelled_predictions(spark, folder)


@query
def entry_page(spark, folder):
    joined = ingest.join_entry_page(_entries(spark, folder), B.entry_pages(spark, folder))
    return joined.select("idx", "link", "page_text")


# --- aggregations -------------------------------------------------------------------


@query
def fetched_by_source(spark, folder):
    return metrics.fetched_by_source(B.articles(spark, folder))


@query
def stored_by_source(spark, folder):
    batch, known = _batch_and_store(spark, folder)
    return metrics.stored_by_source(store.store_upsert(batch, known, B.AS_OF))


@query
def passed_relevance(spark, folder):
    return metrics.passed_relevance(B.scored(spark, folder), B.CONFIG.relevance_threshold)


@query
def avg_relevance(spark, folder):
    return metrics.avg_nonzero(B.scored(spark, folder), "eu_relevance", "avg_eu_relevance")


@query
def avg_quality(spark, folder):
    return metrics.avg_nonzero(B.scored(spark, folder), "quality_score", "avg_quality_score")


@query
def category_distribution(spark, folder):
    return metrics.category_distribution(B.scored(spark, folder))


@query
def call_outcomes(spark, folder):
    return metrics.call_outcomes(B.telemetry(spark, folder), ["run_id"])


@query
def token_total(spark, folder):
    return metrics.token_total(B.telemetry(spark, folder), ["run_id"])


@query
def sources_ranked(spark, folder):
    return store.sources_ranked(B.articles(spark, folder))


@query
def class_metrics(spark, folder):
    return evaluate.class_metrics(_labelled_predictions(spark, folder), "strict", "human", CLASSES)


@query
def macro_f1(spark, folder):
    table = evaluate.class_metrics(_labelled_predictions(spark, folder), "strict", "human", CLASSES)
    return evaluate.macro_f1(table, B.CONFIG.macro_f1_target)


@query
def confusion_matrix(spark, folder):
    rows = _labelled_predictions(spark, folder)
    return evaluate.confusion_matrix(rows, "strict", "human", CLASSES)


@query
def agreement(spark, folder):
    return evaluate.agreement(_labelled_predictions(spark, folder), "strict", "lenient")


@query
def label_distribution(spark, folder):
    rows = _labelled_predictions(spark, folder)
    return evaluate.label_distribution(rows, {"strict": "strict", "human": "human"})


@query
def summarized_count(spark, folder):
    return metrics.summarized_count(B.articles(spark, folder))


def _legacy_store(spark: SparkSession, folder: str) -> DataFrame:
    """The store with every third article under the retired category."""
    rows = B.store(spark, folder).select("id", "title", "category")
    return rows.withColumn("category", F.when(F.col("id") % 3 == 0, "country").otherwise(F.col("category")))


@query
def legacy_category_count(spark, folder):
    before = _legacy_store(spark, folder)
    return store.legacy_category_count(before, store.fix_country_categories(before, B.RULES))


# --- windows ------------------------------------------------------------------------


@query
def first_n_per_source(spark, folder):
    rows = B.articles(spark, folder).select("seq", "source", "published_date")
    cut = ingest.first_n(rows, ["source"], ["seq"], B.CONFIG.per_source_limit)
    return ingest.fresh(cut, B.AS_OF, B.CONFIG.max_age_days)


@query
def ordered_dedup(spark, folder):
    rows = B.articles(spark, folder)
    hashed = rows.withColumn("article_hash", T.article_hash(F.col("title"), F.col("url"), F.col("source")))
    return dedup.ordered_dedup(hashed, config=B.CONFIG).select("seq", "url", "article_hash")


@query
def ordered_dedup_two_keys(spark, folder):
    rows = B.articles(spark, folder).select("seq", "url", "title")
    return dedup.ordered_dedup(rows, "url", "title", config=B.CONFIG).select("seq", "url", "title")


@query
def budget_gate(spark, folder):
    calls = B.telemetry(spark, folder)
    gated = budget.budget_gate(
        calls, 2_000, budget.usage_total(F.col("tokens_in"), F.col("tokens_out")), ["run_id"],
        ["timestamp", "event_id"],
    )
    return gated.select("run_id", "event_id", "tokens_before", "allowed", "tokens_left")


@query
def stratified_sample(spark, folder):
    sample = evaluate.stratified_sample(B.articles(spark, folder), B.CONFIG.sample_size)
    return sample.select("seq", "url", "source")


@query
def last_write_wins(spark, folder):
    rows = B.articles(spark, folder).select("seq", "title", "source")
    return publish.last_write_wins(rows, "title")


# --- paging and set operations ------------------------------------------------------


@query
def deep_page(spark, folder):
    """A page far down the list, from its index."""
    path = scratch_path(spark, "page-index")
    serve.write_page_index(serve.published_view(B.store(spark, folder), B.CONFIG), path, rows_per_range=40)
    return serve.indexed_page(spark, path, limit=50, offset=90).drop("image_url")


@query
def article_page(spark, folder):
    shown = serve.published_view(_served(spark, folder), B.CONFIG)
    return serve.article_page(shown, limit=50, offset=20).drop("image_url")


@query
def disagreements(spark, folder):
    rows = _labelled_predictions(spark, folder)
    return evaluate.disagreements(rows, "strict", "human", order="doc_id")


@query
def union_channels(spark, folder):
    feed = B.articles(spark, folder).select("seq", "title", "url", "source")
    pages = ingest.page_extract(B.table(spark, folder, "pages"))
    web = pages.select(F.col("page_id").alias("seq"), F.col("page_title").alias("title"), "url", F.lit("web").alias("source"))
    return ingest.union_channels(feed, web)


@query
def distinct_links(spark, folder):
    links = ingest.page_links(B.table(spark, folder, "pages"), B.RULES)
    return links.select("page_id", _long(F.col("place")).alias("place"), "link")


@query
def sample_remainder(spark, folder):
    rows = B.articles(spark, folder)
    sample = evaluate.stratified_sample(rows, B.CONFIG.sample_size)
    return evaluate.sample_remainder(rows.select("seq", "source"), sample)


# --- classification, scoring, selection ---------------------------------------------


@query
def keyword_category(spark, folder):
    return classify.keyword_labels(B.articles(spark, folder), B.RULES).select("seq", "category")


@query
def detect_country(spark, folder):
    rows = B.articles(spark, folder)
    found = K.matched(K.search_text(F.col("title"), F.col("content")), K.region_keywords(B.RULES))
    return rows.withColumn("_found", found).select("seq", K.country_of(F.col("_found"), B.RULES).alias("country"))


@query
def eu_relevance(spark, folder):
    return classify.keyword_labels(B.articles(spark, folder), B.RULES).select("seq", "eu_relevance")


@query
def keyword_classify(spark, folder):
    return classify.keyword_labels(B.articles(spark, folder), B.RULES).select(
        "seq", "category", "country", "eu_relevance", "confidence"
    )


@query
def classify_modes(spark, folder):
    rows = _with_response(spark, folder)
    labelled = classify.classify_under_modes(
        rows, ("disabled", "shadow", "live"), B.RULES, F.col("seq") % 4 != 3)
    return labelled.select(
        "seq", "mode", "category", "country", "eu_relevance", "confidence", "label_origin")


@query
def validate_classification(spark, folder):
    answers = B.responses(spark, folder).filter("stage = 'classification'")
    checked = R.validate_classification(R.parse_classification(F.col("text")))
    return computed_once(answers, {"v": checked}).select("seq", "v.category", "v.country", "v.eu_relevance", "v.confidence", "v.valid")


@query
def model_outcome(spark, folder):
    return classify.model_outcome(_with_response(spark, folder)).select("seq", "outcome.*")


@query
def quality_score(spark, folder):
    return B.scored(spark, folder).select("seq", "quality_score")


@query
def choose_summary(spark, folder):
    rows = classify.join_response(
        B.articles(spark, folder), B.responses(spark, folder), "summary", out="summary_response"
    )
    chosen = summarize.choose_summary(rows, "live", B.CONFIG.min_summary_chars, F.col("seq") % 4 != 3)
    return chosen.select("seq", "summary", "summary_called", F.col("summary_outcome.status").alias("status"))


@query
def country_category_fix(spark, folder):
    return store.fix_country_categories(_legacy_store(spark, folder), B.RULES)


@query
def reclassify_diff(spark, folder):
    return store.reclassify_diff(B.store(spark, folder), _new_labels(spark, folder))


@query
def apply_reclassification(spark, folder):
    rows = B.store(spark, folder).select("id", "title", "category", "country", "eu_relevance", "confidence")
    return store.apply_reclassification(rows, _new_labels(spark, folder), apply=True)


@query
def store_update(spark, folder):
    """A reclassification of a written store in place, partition by partition."""
    path = scratch_path(spark, "updated-store")
    rows = B.store(spark, folder).withColumn("run_id", F.concat(F.lit("run-"), F.col("id") % 7))
    rows.write.partitionBy("run_id").parquet(path)
    labels = materialize(_new_labels(spark, folder), "new-labels")
    store.update_store(spark, path, lambda s: store.apply_reclassification(s, labels, apply=True))
    return tables.read_table(spark, path, RUN_STORE).select(
        "id", "title", "category", "country", "eu_relevance", "confidence", "run_id")


@query
def normalize_store_sources(spark, folder):
    rows = B.articles(spark, folder, alias=False).select("seq", "url", "source")
    return store.normalize_store_sources(rows, B.RULES)


@query
def sweep_stuck_runs(spark, folder):
    states = runs.run_state(B.run_events(spark, folder), ["event_id"])
    swept = runs.sweep_stuck_runs(states, B.AS_OF, B.CONFIG.stuck_minutes, apply=True)
    return swept.select("id", "status", "completed_at", "error_message")


@query
def sweep_events(spark, folder):
    states = runs.run_state(B.run_events(spark, folder), ["event_id"])
    return runs.sweep_events(states, B.AS_OF, B.CONFIG.stuck_minutes)


@query
def compare_labelers(spark, folder):
    return classify.compare_labelers(_with_response(spark, folder), B.RULES)


@query
def source_run_metrics(spark, folder):
    rows = B.scored(spark, folder).select("seq", "source", "category", "eu_relevance", "quality_score")
    rows = materialize(rows, "scored")
    kept = quality.quality_gate(rows, B.CONFIG.store_gate)
    return metrics.source_run_metrics(rows, rows, kept, B.CONFIG.relevance_threshold)


@query
def classification_summary(spark, folder):
    rows = _with_response(spark, folder).withColumn("call_allowed", F.col("seq") % 4 != 3)
    labelled = classify.classify(rows, "live", B.RULES, F.col("call_allowed"))
    return metrics.classification_summary(
        labelled.select("called", F.col("outcome.status").alias("call_status"), (~F.col("call_allowed")).alias("budget_skipped"))
    )


def pipeline_config() -> EngineConfig:
    return replace(B.CONFIG, store_gate=0.5)


@query
def article_pipeline(spark, folder):
    articles = B.articles(spark, folder)
    known = articles.filter(F.col("seq") % 10 == 0).select(
        "url", T.content_hash(F.col("url"), F.col("title")).alias("content_hash")
    )
    rows = pipeline.article_pipeline(
        articles, B.responses(spark, folder), known, B.AS_OF, pipeline_config(), B.RULES
    )
    return rows.select(
        "seq", "url", "title", "source", "category", "country", "quality_score", "eu_relevance",
        "confidence", "content_hash", "summary", "published_date", "created_at",
    )


def _whole_run(spark: SparkSession, folder: str) -> pipeline.Tables:
    """A run from feed items and pages, after an earlier one that has stored a tenth of them."""
    articles = materialize(pipeline.collected(
        _entries(spark, folder), B.entry_pages(spark, folder), B.table(spark, folder, "pages"),
        _fetched(spark, folder), B.AS_OF, B.CONFIG, B.RULES,
    ), "collected")
    path, at = scratch_path(spark, "run"), datetime.fromisoformat(B.AS_OF)
    places = pipeline.Tables(*[f"{path}/{name}" for name in ("store", "metrics", "telemetry", "runs")])
    pipeline.run_pipeline(
        spark, "run-0", articles.filter(F.col("seq") % 10 == 0), None, places, at,
        EngineConfig(classification_enabled=False, store_gate=0.0), B.RULES,
    )
    answers = B.responses(spark, folder)
    pipeline.run_pipeline(spark, "run-1", articles, answers, places, at, pipeline_config(), B.RULES)
    return places


@query
def full_run(spark, folder):
    """What a whole run has stored."""
    rows = tables.read_table(spark, _whole_run(spark, folder).store, RUN_STORE)
    return rows.filter("run_id = 'run-1'").select(
        "id", "url", "title", "source", "category", "country", "quality_score", "eu_relevance",
        "confidence", "content_hash", "summary", "published_date", "image_url",
    )


@query
def full_run_metrics(spark, folder):
    rows = tables.read_table(spark, _whole_run(spark, folder).metrics, SOURCE_METRIC)
    return rows.filter("run_id = 'run-1'").drop("timestamp")


@query
def full_run_telemetry(spark, folder):
    rows = tables.read_table(spark, _whole_run(spark, folder).telemetry, TELEMETRY)
    return rows.filter("run_id = 'run-1'").drop("timestamp", "fallback_reason")


@query
def complete_prompts(spark, folder):
    """A stand-in for a model: answers with the size of its prompt, refuses every fifth size."""

    def size(prompt: str) -> dict:
        if len(prompt) % 5 == 0:
            raise ValueError("no such size")
        return {"text": str(len(prompt)), "tokens_in": len(prompt.split()), "model": "size"}

    rows = B.articles(spark, folder)
    prompt = T.render_prompt(TEMPLATE, B.CONFIG.prompt_chars, F.col("title"), F.col("source"), F.col("content"))
    prompts = rows.select("seq", F.lit("classification").alias("stage"), prompt.alias("prompt"))
    answers = completer.complete(prompts, size)
    return answers.select("seq", "stage", "text", "status", "error", "model", "tokens_in", "tokens_out")


# --- streaming ----------------------------------------------------------------------


@query
def stream_ingest_store(spark, folder):
    docs = files.read_file_stream(spark, f"{folder}/documents.parquet", DOCUMENTS)
    rows = quality.quality_score(classify.keyword_labels(B.articles_of(docs), B.RULES), B.RULES)
    path = scratch_path(spark, "stream-store")
    state = scratch_path(spark, "stream-store-state")
    stream_ingest.start_ingest(rows, path, state, B.AS_OF).awaitTermination()
    stored = stream_ingest.read_stream_store(spark, path)
    return stored.select("seq", "url", "source", "category", "quality_score", "content_hash")


@query
def stream_feed_ingest(spark, folder):
    """Landed feed files, some of them broken, into the store; entries without a link are all
    one article, whichever comes first."""
    path, store_path = _landed(spark, folder), scratch_path(spark, "feed-store")
    spark.range(1).select(F.lit("<rss><channel><title>cut off").alias("value")).write.mode("append").text(path)
    stream_feeds.start_feed_ingest(
        stream_feeds.read_feed_files(spark, path), B.entry_pages(spark, folder),
        lambda rows: quality.quality_score(classify.keyword_labels(rows, B.RULES), B.RULES),
        store_path, scratch_path(spark, "feed-rejects"), scratch_path(spark, "feed-state"), B.AS_OF,
        config=B.CONFIG, rules=B.RULES,
    ).awaitTermination()
    stored = stream_ingest.read_stream_store(spark, store_path)
    return stored.filter("url <> ''").select("url", "title", "source", "content_hash", "published_date", "image_url")


@query
def stream_source_metrics(spark, folder):
    docs = files.read_file_stream(spark, f"{folder}/documents.parquet", DOCUMENTS)
    rows = quality.quality_score(classify.keyword_labels(B.articles_of(docs), B.RULES), B.RULES)
    timed = rows.withColumn("ts", F.col("created_at").cast("timestamp"))
    path, state = scratch_path(spark, "stream-metrics"), scratch_path(spark, "stream-metrics-state")
    stream_metrics.start_windowed_metrics(
        timed, "ts", B.CONFIG.relevance_threshold, path, state
    ).awaitTermination()
    return stream_metrics.windowed_metrics(spark, path)


@query
def stream_dedup_url(spark, folder):
    docs = files.read_file_stream(spark, f"{folder}/documents.parquet", DOCUMENTS)
    timed = B.articles_of(docs).withColumn("ts", F.col("created_at").cast("timestamp"))
    unique = stream_dedup.unique_urls(timed, "ts", B.CONFIG)
    # copies agree in url and title; which of them comes first is not determined
    return files.drain(unique.select("url", "title"), "stream-dedup")
