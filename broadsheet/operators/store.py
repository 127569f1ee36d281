"""The article store: upsert, schema alignment and clean-up jobs.

Stores are plain parquet tables; clean-up jobs are projections, which :func:`update_store`
applies in place to the partitions they change.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.config import DEFAULT_CONFIG, DEFAULT_RULES, EngineConfig, RuleSet
from broadsheet.functions.text import content_hash, falsy_to_null, preview
from broadsheet.operators.budget import total_before
from broadsheet.operators.dedup import new_rows
from broadsheet.operators.ingest import normalize_source, timestamp
from broadsheet.schemas import RUN_STORE
from broadsheet.session import materialize
from broadsheet.sources.tables import read_table


def store_recent(store: DataFrame, limit: int = 0) -> DataFrame:
    """Store rows, newest first; 0 takes all."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    ordered = store.orderBy(F.desc("created_at"), "id")
    return ordered.limit(limit) if limit else ordered


def to_store_rows(articles: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Article columns in store form: missing values become NULL, hash and times added."""
    now = timestamp(as_of)
    image = F.col("image_url") if "image_url" in articles.columns else F.lit(None).cast("string")
    return articles.select(
        "seq",
        "url",
        "title",
        "source",
        "category",
        falsy_to_null(F.col("country"), "").alias("country"),
        "quality_score",
        falsy_to_null(F.col("eu_relevance"), 0.0).alias("eu_relevance"),
        falsy_to_null(F.col("confidence"), 0.0).alias("confidence"),
        content_hash(F.col("url"), F.col("title")).alias("content_hash"),
        falsy_to_null(F.col("content"), "").alias("content"),
        falsy_to_null(F.col("summary"), "").alias("summary"),
        image.alias("image_url"),
        "published_date",
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def store_upsert(
    articles: DataFrame,
    store: DataFrame | None,
    as_of: datetime | str | Column,
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Rows to append to the store, still carrying ``seq``.

    An article is new if the store knows neither its url nor its content hash, and no article
    taken before it has either. A hash is no function of the url: ("u|a", "b") and ("u", "a|b")
    have one hash and two urls. All of that is decided on (seq, url, content_hash); whole rows
    are joined to the decision once.
    """
    return new_rows(to_store_rows(articles, as_of), store, config=config)


def assign_ids(rows: DataFrame, first_id: int) -> DataFrame:
    """Replace ``seq`` by consecutive ids in ``seq`` order, starting at ``first_id``."""
    narrow = rows.select("seq").withColumn("_all", F.lit(0))
    numbered = total_before(narrow, F.lit(1), ["_all"], ["seq"], "_before")
    ids = numbered.select("seq", (F.lit(first_id) + F.col("_before")).alias("id"))
    columns = [c for c in rows.columns if c != "seq"]
    return rows.join(ids, "seq").select("id", *columns)


def next_id(store: DataFrame) -> int:
    last = store.agg(F.max("id")).first()[0]
    return 1 if last is None else last + 1


def schema_align(df: DataFrame, columns: str) -> DataFrame:
    """Add the missing ones of ``columns`` (DDL text) as NULLs; present ones stay."""
    have = {c.lower() for c in df.columns}
    wanted = T.StructType.fromDDL(columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name.lower() not in have}
    return df.withColumns(missing) if missing else df


def fix_country_categories(store: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Give rows of the retired category "country" a category by words in the title."""
    title = F.lower(F.col("title"))
    branch = None
    for name, words in rules.legacy_titles:
        hit = F.lit(False)
        for word in words:
            hit = hit | title.contains(word)
        branch = F.when(hit, name) if branch is None else branch.when(hit, name)
    fixed = branch.otherwise(F.lit("industry"))
    return store.withColumn(
        "category", F.when(F.col("category") == "country", fixed).otherwise(F.col("category"))
    )


def legacy_category_count(store: DataFrame, fixed: DataFrame, legacy: str = "country") -> DataFrame:
    """Rows of the retired category before and after the fix, one row per state."""

    def counted(state: str, df: DataFrame) -> DataFrame:
        n = F.count_if(F.col("category") == legacy)
        return df.agg(n.alias("articles")).select(F.lit(state).alias("state"), "articles")

    return counted("before", store).unionByName(counted("after", fixed))


def normalize_store_sources(store: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    return store.withColumn("source", normalize_source(F.col("source"), rules))


def sources_ranked(store: DataFrame) -> DataFrame:
    """Sources with their number of articles, largest first."""
    counts = store.groupBy("source").agg(F.count("*").alias("articles"))
    return counts.orderBy(F.desc("articles"), "source")


def join_reclassified(store: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored rows with their new labels (id, new_category, new_country, ...)."""
    return store.join(labels, "id")


def _changed() -> Column:
    eu_moved = F.abs(F.col("new_eu_relevance") - F.coalesce(F.col("eu_relevance"), F.lit(0.0))) > 0.5
    return (
        ~F.col("category").eqNullSafe(F.col("new_category"))
        | ~F.col("country").eqNullSafe(F.col("new_country"))
        | eu_moved
    )


def reclassify_diff(store: DataFrame, labels: DataFrame) -> DataFrame:
    """Change log: rows whose category, country or relevance really moved.

    NULL and '' countries differ; a relevance has to move by more than 0.5.
    """
    return (
        join_reclassified(store, labels)
        .filter(_changed())
        .select(
            "id",
            preview(F.col("title"), 80).alias("title"),
            F.col("category").alias("old_category"),
            "new_category",
            F.col("country").alias("old_country"),
            "new_country",
            F.col("eu_relevance").alias("old_eu_relevance"),
            "new_eu_relevance",
            F.col("new_confidence").alias("confidence"),
        )
    )


def apply_reclassification(store: DataFrame, labels: DataFrame, apply: bool = False) -> DataFrame:
    """The store after a reclassification; unchanged unless ``apply`` is set.

    Changed rows take all new labels, other relabelled rows only the new confidence.
    """
    if not apply:
        return store
    joined = store.join(labels, "id", "left")
    # the id is not NULL, so a NULL category marks a row without new labels
    relabelled = F.col("new_category").isNotNull()
    changed = relabelled & _changed()

    def pick(name: str, when: Column) -> Column:
        return F.when(when, F.col("new_" + name)).otherwise(F.col(name)).alias(name)

    replaced = {
        "category": pick("category", changed),
        "country": pick("country", changed),
        "eu_relevance": pick("eu_relevance", changed),
        "confidence": pick("confidence", relabelled),
    }
    return joined.select(*[replaced.get(c, F.col(c)) for c in store.columns])


def update_store(
    spark: SparkSession,
    path: str,
    update: Callable[[DataFrame], DataFrame],
    schema: str = RUN_STORE,
    partition: str = "run_id",
) -> list[str]:
    """Update a partitioned store in place; returns the partitions that were written anew.

    ``update`` maps store rows to store rows, one to one, and keeps columns it doesn't know, as
    all clean-up jobs of this module do. A first pass finds the partitions with a row that it
    changes; only these are read again, updated, written to the shared folder and then put in
    place of the old ones. All other files stay as they are. The update should give the same
    rows when it is run again, so that a job that failed half-way can be repeated.
    """
    store = read_table(spark, path, schema)
    content = F.xxhash64(*[F.col(c) for c in store.columns])
    marked = update(store.withColumn("_before", content))
    changed = marked.filter(content != F.col("_before"))
    touched = sorted(r[0] for r in changed.select(partition).distinct().collect())  # partitions
    if touched:
        rows = read_table(spark, path, schema).filter(F.col(partition).isin(touched))
        new = materialize(update(rows).select(store.columns), "updated")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            partition).parquet(path)
    return touched
