"""Markdown documents with a YAML header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.config import EngineConfig
from broadsheet.functions.text import preview, slug


def document_date(published: Column, as_of: Column) -> Column:
    return F.date_format(F.coalesce(published, as_of), "yyyy-MM-dd")


def filename(title: Column, published: Column, as_of: Column) -> Column:
    """``YYYY-MM-DD-slug.md``; an undated article takes the run's date."""
    return F.concat(document_date(published, as_of), F.lit("-"), slug(title), F.lit(".md"))


def frontmatter(row: dict[str, Column], as_of: Column, config: EngineConfig,
                escape: bool = False) -> Column:
    """YAML header of one article.

    Quotes inside values stay as they are unless ``escape`` is set.
    """

    def line(key: str, value: Column) -> Column:
        value = F.coalesce(value, F.lit(""))
        if escape:
            value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
            value = F.replace(value, F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit(key + ': "'), value, F.lit('"\n'))

    def optional(key: str, value: Column) -> Column:
        present = F.coalesce(value, F.lit("")) != ""
        return F.when(present, line(key, value)).otherwise(F.lit(""))

    return F.concat(
        F.lit("---\n"),
        line("title", row["title"]),
        line("date", document_date(row["published_date"], as_of)),
        line("author", F.lit(config.default_author)),
        line("source", row["source"]),
        line("url", row["url"]),
        line("pillar", row["category"]),
        optional("country", row["country"]),
        optional("description", preview(row["summary"], 160)),
        line("coverImage", F.lit(config.default_cover_image)),
        F.lit("isFeatured: false\nisAiGenerated: true\n---"),
    )


def body(header: Column, content: Column) -> Column:
    return F.concat(header, F.lit("\n\n"), F.coalesce(content, F.lit("")))
