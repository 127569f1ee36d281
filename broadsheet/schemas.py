"""Table schemas and enumerations.

Event times are TIMESTAMP_NTZ in UTC throughout: parquet files written without a zone
load that way, and no operator depends on the session time zone.
"""

from __future__ import annotations

CATEGORIES = ("startups", "policy", "research", "industry", "other")
LEGACY_CATEGORIES = ("country", "stories")
EVAL_CLASSES = ("startups", "policy", "research", "industry")
COUNTRIES = (
    "Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czech Republic",
    "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary",
    "Ireland", "Italy", "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands",
    "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden",
    "Europe",
)
RUN_STATES = ("queued", "running", "completed", "failed")


# Schemas are DDL text, which readers and ``createDataFrame`` take as it is.
ARTICLE = (
    "seq BIGINT, title STRING, url STRING, source STRING, content STRING, "
    "summary STRING, published_date TIMESTAMP_NTZ, scraped_date TIMESTAMP_NTZ, "
    "category STRING, country STRING, quality_score DOUBLE, eu_relevance DOUBLE, "
    "confidence DOUBLE, image_url STRING"
)

STORE = (
    "id BIGINT, url STRING, title STRING, source STRING, category STRING, "
    "country STRING, quality_score DOUBLE, eu_relevance DOUBLE, confidence DOUBLE, "
    "content_hash STRING, content STRING, summary STRING, image_url STRING, "
    "published_date TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)

# the store as runs write it, a partition each
RUN_STORE = STORE + ", run_id STRING"

FEED_ENTRY = (
    "source_rank BIGINT, feed_url STRING, feed_title STRING, idx BIGINT, title STRING, "
    "link STRING, summary STRING, published STRING, "
    "content ARRAY<STRUCT<value: STRING>>, media_content ARRAY<STRUCT<url: STRING>>, "
    "enclosures ARRAY<STRUCT<type: STRING, href: STRING>>"
)

RESPONSE = (
    "seq BIGINT, stage STRING, text STRING, status STRING, error STRING, "
    "provider STRING, model STRING, latency_ms BIGINT, tokens_in BIGINT, "
    "tokens_out BIGINT"
)

TELEMETRY = (
    "run_id STRING, article_url STRING, model STRING, prompt_version STRING, "
    "latency_ms BIGINT, tokens_in BIGINT, tokens_out BIGINT, status STRING, "
    "fallback_reason STRING, timestamp TIMESTAMP_NTZ"
)

SOURCE_METRIC = (
    "run_id STRING, source_name STRING, articles_fetched BIGINT, "
    "articles_stored BIGINT, articles_passed_relevance BIGINT, "
    "avg_eu_relevance DOUBLE, avg_quality_score DOUBLE, "
    "category_distribution STRING, timestamp TIMESTAMP_NTZ"
)

RUN_EVENT = (
    "id STRING, event_time TIMESTAMP_NTZ, status STRING, job_type STRING, "
    "result_count BIGINT, error_message STRING"
)

EVAL_ROW = (
    "url STRING, title STRING, source STRING, content_preview STRING, "
    "keyword_category STRING, llm_category STRING, llm_country STRING, "
    "llm_eu_relevance STRING, human_category STRING, human_country STRING, "
    "human_eu_relevance STRING, notes STRING"
)
