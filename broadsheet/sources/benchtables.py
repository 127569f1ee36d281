"""The benchmark's parquet tables seen as feeds, articles, answers, telemetry and runs.

The texts are invented, so rules that should hit something are given here as well.
Everything is derived row by row from the tables given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.config import EngineConfig, RuleSet
from broadsheet.functions.text import content_hash, falsy_to_null
from broadsheet.operators.classify import keyword_labels
from broadsheet.operators.ingest import normalize_source, page_extract
from broadsheet.operators.quality import quality_score
from broadsheet.session import spread

# --- Fixed values: rules that fit the invented texts -------------------------------
RULES = RuleSet(
    strong=(" ai ", " llm", " tech ", " thes ", " avec ", " nicht ", " para "),
    weak=(" with ", " this ", " from ", " und ", " des ", " que "),
    categories=(
        ("startups", (" thble ", " pour ", " das ")),
        ("policy", (" thed ", " sich ", " los ")),
        ("research", (" attion ", " dans ", " con ")),
    ),
    eu_keywords=(
        " avec ", " dans ", " pour ", " nicht ", " sich ", " para ", " con ", " thes ",
        " erin ", " thou ",
    ),
    countries=(
        ("France", (" avec ", " dans ")),
        ("Germany", (" nicht ", " sich ")),
        ("Spain", (" para ", " con ")),
        ("Ireland", (" thes ",)),
    ),
    eu_sources=("Sifted", "Tech.eu", "EURACTIV", "EuroNews", "AlgorithmWatch", "TNW"),
    tier_1=("Sifted", "Tech.eu", "EURACTIV", "AlgorithmWatch"),
    tier_2=("EuroNews", "TNW"),
    aliases={
        "src0": "Sifted", "src1": "Tech.eu", "src2": "EURACTIV", "src3": "AlgorithmWatch",
        "src4": "TNW", "src5": "EuroNews", "src6": "Sifted",
    },
    link_keywords=("/th", "/re", "/on"),
    legacy_titles=(
        ("startups", ("the", "der", "les")),
        ("policy", ("and", "und", "que")),
    ),
)
# letters and what stands for them in titles of another script
SCRIPTS = {
    "greek": ("abgdeziklmnoprstufhxqwyc", "αβγδεζικλμνοπρστυφηξθωψχ"),
    "cyrillic": ("abvgdeziklmnoprstufhcyjqwx", "абвгдезиклмнопрстуфхцыйюящ"),
}
# what surrounds the text of a page without <article>
RELATED = "".join(f'<li><a href="/r/{k}">Another article to read, number {k}</a></li>' for k in range(5))
NOTICE = "We use cookies."
AS_OF = "2024-03-01 00:00:00"
CONFIG = EngineConfig(
    classification_enabled=True, summary_enabled=True, token_cap=100_000,
)
# --- end of fixed values -----------------------------------------------------------


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def _add_days(base: str, days: Column) -> Column:
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(days=days.cast("int"))


def articles_of(documents: DataFrame, alias: bool = True) -> DataFrame:
    """Documents as articles; works on a stream as well."""
    seq, text = F.col("doc_id"), F.col("text")
    source = normalize_source(F.col("source"), RULES) if alias else F.col("source")
    return documents.select(
        seq.alias("seq"),
        F.substring(F.substring_index(text, "\n", 1), 1, 80).alias("title"),
        F.concat(F.lit("https://doc.example/"), F.substring(F.sha2(text, 256), 1, 16)).alias("url"),
        source.alias("source"),
        text.alias("content"),
        F.when(seq % 3 == 0, F.substring(text, 1, 60)).otherwise(F.lit("")).alias("summary"),
        F.when(seq % 7 != 0, _add_days("2024-01-01 00:00:00", seq % 60)).alias("published_date"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=seq.cast("int"))).alias(
            "created_at"
        ),
    )


def articles(spark: SparkSession, folder: str, alias: bool = True) -> DataFrame:
    return articles_of(table(spark, folder, "documents"), alias)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with keyword labels and quality."""
    return quality_score(keyword_labels(articles(spark, folder), RULES), RULES)


def other_script(title: Column, script: str) -> Column:
    """A title with plain Latin letters in Greek or Cyrillic ones."""
    latin, letters = SCRIPTS[script]
    return F.translate(F.lower(title), latin, letters)


def store(spark: SparkSession, folder: str) -> DataFrame:
    """Scored articles in store form, with the document id as id."""
    rows = scored(spark, folder)
    return rows.select(
        F.col("seq").alias("id"), "url", "title", "source", "category",
        falsy_to_null(F.col("country"), "").alias("country"),
        "quality_score",
        falsy_to_null(F.col("eu_relevance"), 0.0).alias("eu_relevance"),
        falsy_to_null(F.col("confidence"), 0.0).alias("confidence"),
        content_hash(F.col("url"), F.col("title")).alias("content_hash"),
        falsy_to_null(F.col("content"), "").alias("content"),
        falsy_to_null(F.col("summary"), "").alias("summary"),
        F.lit(None).cast("string").alias("image_url"),
        "published_date", "created_at", F.col("created_at").alias("updated_at"),
    )


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def classification_text(seq: Column) -> Column:
    """A model answer in one of eight shapes, most of them wrong in some way."""
    category = _pick(F.floor(seq / 8) % 5, "startups", "policy", "research", "industry", "other")
    country = _pick(F.floor(seq / 40) % 3, "France", "Germany", "")
    eu = (seq % 11).cast("string")
    confidence = F.concat(F.lit("0."), (seq % 10).cast("string"))

    def answer(cat: Column, cty: Column, rel: Column, conf: Column) -> Column:
        return F.concat(
            F.lit('{"category": "'), cat, F.lit('", "country": '), cty, F.lit(', "eu_relevance": '),
            rel, F.lit(', "confidence": '), conf, F.lit("}"),
        )

    quoted = F.concat(F.lit('"'), country, F.lit('"'))
    plain = answer(category, quoted, eu, confidence)
    shape = seq % 8
    return (
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(shape == 2, answer(F.concat(F.lit("  "), F.upper(category), F.lit(" ")), quoted, eu, confidence))
        .when(shape == 3, answer(category, quoted, F.concat(F.lit("1"), eu), F.lit("1.5")))
        .when(
            shape == 4,
            answer(category, F.lit("42"), F.when(seq % 16 == 4, F.lit('"high"')).otherwise(F.lit('"7"')),
                   F.lit('"0.9"')),
        )
        .when(shape == 5, F.concat(F.lit("["), plain, F.lit("]")))
        .when(shape == 6, F.when(seq % 16 == 6, F.concat(plain, F.lit(" thanks"))).otherwise(F.lit('{"category": ')))
        .otherwise(F.when(seq % 16 == 7, F.lit("   ")).otherwise(F.lit("")))
    )


def summary_text(seq: Column, title: Column) -> Column:
    shape = seq % 8
    return (
        F.when(shape == 0, F.concat(F.lit('"'), title, F.lit('. It matters. Read on."')))
        .when(shape == 1, F.lit("Not relevant"))
        .when(shape == 2, F.concat(F.lit("# "), title))
        .when(shape == 3, F.concat(F.lit("**"), title, F.lit("**")))
        .when(shape == 4, F.concat(F.lit("<b>"), title, F.lit("</b> text")))
        .when(shape == 5, F.lit("A. B. C. D. E. F. G."))
        .when(shape == 6, F.concat(title, F.lit(" was announced. More follows.")))
        .otherwise(F.lit("   "))
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded answers of both stages; some calls failed, some have no record."""
    docs = table(spark, folder, "documents").filter(F.col("doc_id") % 17 != 5)
    seq = F.col("doc_id")
    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    failed = seq % 13 == 0
    stages = F.array(
        F.struct(F.lit("classification").alias("stage"), classification_text(seq).alias("text")),
        F.struct(F.lit("summary").alias("stage"), summary_text(seq, title).alias("text")),
    )
    return docs.select(seq.alias("seq"), F.inline(stages)).select(
        "seq",
        "stage",
        F.when(F.col("seq") % 13 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("seq") % 13 == 0, F.lit("api_error")).otherwise(F.lit("ok")).alias("status"),
        F.when(F.col("seq") % 13 == 0, F.lit("rate limited")).otherwise(F.lit("")).alias("error"),
        F.lit("recorded").alias("provider"),
        F.lit("small").alias("model"),
        (F.col("seq") % 900 + 100).alias("latency_ms"),
        (F.col("seq") % 97 + 200).alias("tokens_in"),
        (F.col("seq") % 13 + 20).alias("tokens_out"),
    )


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events as model calls of one run per user."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id"),
        F.concat(F.lit("https://doc.example/"), F.col("event_id").cast("string")).alias("article_url"),
        F.lit("small").alias("model"),
        F.when(F.col("event_id") % 3 == 0, F.lit("summary")).otherwise(F.lit("classification")).alias(
            "prompt_version"
        ),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens_in"),
        F.floor("value").cast("bigint").alias("tokens_out"),
        F.when(F.col("event_type") == "error", F.lit("api_error")).otherwise(F.lit("ok")).alias("status"),
        F.col("ts").alias("timestamp"),
    )


def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the run log of one run per user."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "signup", "queued")
        .when(kind.isin("view", "click"), "running")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("id"),
        F.col("ts").alias("event_time"),
        status.alias("status"),
        F.lit("scrape").alias("job_type"),
        F.when(kind == "purchase", F.floor("value").cast("bigint")).alias("result_count"),
        F.when(kind == "error", F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias(
            "error_message"
        ),
        "event_id",
    )


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as RSS items (source_rank, feed_url, feed_title, idx, xml), one feed per source.

    Items look as feeds write them: escaped html in the description, dates with a weekday
    and an offset, images as media elements or enclosures, and missing parts.
    """
    seq = F.col("doc_id")

    def escaped(value: Column) -> Column:
        value = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = F.replace(value, F.lit(plain), F.lit(entity))
        return value

    def element(name: str, value: Column, present: Column | None = None) -> Column:
        text = F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
        return text if present is None else F.when(present, text).otherwise(F.lit(""))

    def image(name: str, kind: str, url: Column, present: Column) -> Column:
        text = F.concat(F.lit(f"<{name}{kind} url=\""), url, F.lit('"/>'))
        return F.when(present, text).otherwise(F.lit(""))

    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    day = F.date_format(_add_days("2024-01-01 08:30:00", seq % 60), "EEE, dd MMM yyyy HH:mm:ss")
    number = seq.cast("string")
    item = F.concat(
        F.lit("<item>"),
        element("title", escaped(title), seq % 11 != 0),
        element("link", F.concat(F.lit("https://feed.example/"), number), seq % 9 != 0),
        element("description", escaped(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))),
        element("pubDate", F.concat(day, F.lit(" +0200")), seq % 7 != 0),
        element("encoded", escaped(F.concat(F.lit("<div>"), F.col("text"), F.lit("</div>"))), seq % 4 == 0),
        image("content", "", F.concat(F.lit("https://img.example/m"), number, F.lit(".jpg")), seq % 5 == 0),
        image("enclosure", ' type="audio/mpeg"', F.lit("https://img.example/a.mp3"), seq % 3 == 0),
        image("enclosure", ' type="image/png"', F.concat(F.lit("https://img.example/e"), number, F.lit(".png")), seq % 3 == 0),
        F.lit("</item>"),
    )
    return table(spark, folder, "documents").select(
        F.regexp_extract("source", r"(\d+)$", 1).try_cast("bigint").alias("source_rank"),
        F.concat(F.lit("https://feed.example/"), F.col("source"), F.lit(".xml")).alias("feed_url"),
        F.col("source").alias("feed_title"),
        seq.alias("idx"),
        item.alias("xml"),
    )


def entry_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as the fetched pages of feed entries: page n belongs to entry 3n."""
    link = F.concat(F.lit("https://feed.example/"), (F.col("page_id") * 3).cast("string"))
    return page_extract(table(spark, folder, "pages").withColumn("url", link))
