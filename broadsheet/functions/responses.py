"""Validation of recorded model answers: classification JSON and summary text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import blank, let, strip
from broadsheet.schemas import CATEGORIES

FENCE = "```"
NOT_RELEVANT = "NOT_RELEVANT"


def strip_code_fence(text: Column) -> Column:
    """Without its fence lines if the text starts with a code fence."""

    def without_fence(trimmed: Column) -> Column:
        lines = F.filter(
            F.split(trimmed, "\n"), lambda line: ~F.startswith(strip(line), F.lit(FENCE))
        )
        fenced = F.startswith(trimmed, F.lit(FENCE))
        return F.when(fenced, strip(F.array_join(lines, "\n"))).otherwise(trimmed)

    return let(strip(text), without_fence)


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else, or NULL.

    ``try_parse_json`` stops reading after the first value. Parsing the text as the only
    element of an array and as the only field of an object refuses everything that
    follows it.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"w":'), text, F.lit("}")))

    def only_element(in_array: Column) -> Column:
        single = F.try_variant_get(in_array, "$[1]", "variant").isNull()
        return F.when(
            in_object.isNotNull() & single, F.try_variant_get(in_array, "$[0]", "variant")
        )

    return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), only_element)


def clamp_score(number: Column, low: float, high: float) -> Column:
    """A double within bounds; anything that is no number counts as 0."""
    value = F.coalesce(number, F.lit(0.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def parse_classification(text: Column) -> Column:
    """Struct (category, country, eu_relevance, confidence, valid, fallback_reason).

    The checks run in order and the first failure names the reason. Category and
    country are '' and both scores 0 when the answer is not valid.
    """
    return let(
        F.struct(text.alias("text"), strict_json(strip_code_fence(text)).alias("json")),
        lambda answer: let(_answer_fields(answer["text"], answer["json"]), _checked_fields),
    )


def _answer_fields(text: Column, data: Column) -> Column:
    category_kind = _kind(F.try_variant_get(data, "$.category", "variant"))
    country_kind = _kind(F.try_variant_get(data, "$.country", "variant"))
    country = F.when(
        country_kind == "STRING", strip(F.try_variant_get(data, "$.country", "string"))
    )
    return F.struct(
        blank(text).alias("empty"),
        data.isNotNull().alias("is_json"),
        F.coalesce(F.startswith(_kind(data), F.lit("OBJECT")), F.lit(False)).alias("is_object"),
        (F.coalesce(category_kind, F.lit("STRING")) == "STRING").alias("category_is_text"),
        F.coalesce(
            F.lower(strip(F.try_variant_get(data, "$.category", "string"))), F.lit("")
        ).alias("category"),
        F.coalesce(country, F.lit("")).alias("country"),
        clamp_score(F.try_variant_get(data, "$.eu_relevance", "double"), 0.0, 10.0).alias("eu"),
        clamp_score(F.try_variant_get(data, "$.confidence", "double"), 0.0, 1.0).alias("confidence"),
    )


def _checked_fields(f: Column) -> Column:
    reason = (
        F.when(f["empty"], F.lit("empty_response"))
        .when(~f["is_json"], F.lit("json_parse_error"))
        .when(~f["is_object"], F.lit("response_not_dict"))
        .when(~f["category_is_text"], F.lit("category_not_string"))
        .when(~f["category"].isin(*CATEGORIES), F.concat(F.lit("invalid_category: "), f["category"]))
        .otherwise(F.lit(""))
    )

    def result(reason: Column) -> Column:
        valid = reason == ""
        return F.struct(
            F.when(valid, f["category"]).otherwise(F.lit("")).alias("category"),
            F.when(valid, f["country"]).otherwise(F.lit("")).alias("country"),
            F.when(valid, f["eu"]).otherwise(F.lit(0.0)).alias("eu_relevance"),
            F.when(valid, f["confidence"]).otherwise(F.lit(0.0)).alias("confidence"),
            valid.alias("valid"),
            reason.alias("fallback_reason"),
        )

    return let(reason, result)


def validate_classification(parsed: Column) -> Column:
    """Demote doubtful answers to "other" with relevance 0.

    A valid answer is demoted when its confidence is below 0.5 or its relevance below
    2; "other" never keeps a relevance. Country and confidence stay.
    """

    def demote(p: Column) -> Column:
        demoted = p["valid"] & (
            (p["category"] == "other") | (p["confidence"] < 0.5) | (p["eu_relevance"] < 2.0)
        )
        return F.struct(
            F.when(demoted, F.lit("other")).otherwise(p["category"]).alias("category"),
            p["country"].alias("country"),
            F.when(demoted, F.lit(0.0)).otherwise(p["eu_relevance"]).alias("eu_relevance"),
            p["confidence"].alias("confidence"),
            p["valid"].alias("valid"),
            p["fallback_reason"].alias("fallback_reason"),
        )

    return let(parsed, demote)


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between sentence ends."""
    pieces = F.split(text, r"[.!?](?:\s|$)")
    return F.size(F.filter(pieces, lambda piece: strip(piece) != ""))


def parse_summary(text: Column) -> Column:
    """Struct (text, valid, fallback_reason) of a summary answer."""
    return let(strip(text), lambda trimmed: let(_unquoted(trimmed), _checked_summary))


def _unquoted(trimmed: Column) -> Column:
    """Struct (raw, signal, body): body has lost one pair of quotes around it."""
    signal = F.upper(F.replace(F.replace(trimmed, F.lit("_"), F.lit("")), F.lit(" "), F.lit("")))
    quoted = F.lit(False)
    for quote in ('"', "'"):
        quoted = quoted | (F.startswith(trimmed, F.lit(quote)) & F.endswith(trimmed, F.lit(quote)))
    inner = F.when(
        F.length(trimmed) >= 2, F.substring(trimmed, F.lit(2), F.length(trimmed) - 2)
    ).otherwise(F.lit(""))
    return F.struct(
        (F.coalesce(trimmed, F.lit("")) == "").alias("empty"),
        F.startswith(signal, F.lit("NOTRELEVANT")).alias("irrelevant"),
        F.when(quoted, strip(inner)).otherwise(trimmed).alias("body"),
    )


def _checked_summary(s: Column) -> Column:
    body = s["body"]
    marked_up = (
        body.rlike(r"(?md)^#{1,6}\s") | body.contains("**") | body.rlike(r"<[a-zA-Z/][^>]*>")
    )
    length = let(
        sentence_count(body),
        lambda n: F.when(n < 1, F.lit("too_short")).when(n > 5, F.lit("too_long")).otherwise(F.lit("")),
    )
    reason = (
        F.when(s["empty"], F.lit("empty_summary"))
        .when(s["irrelevant"], F.lit(""))
        .when(body == "", F.lit("empty_summary"))
        .when(marked_up, F.lit("contains_formatting"))
        .otherwise(length)
    )

    def result(reason: Column) -> Column:
        valid = reason == ""
        return F.struct(
            F.when(valid & s["irrelevant"], F.lit(NOT_RELEVANT))
            .when(valid, body)
            .otherwise(F.lit(""))
            .alias("text"),
            valid.alias("valid"),
            reason.alias("fallback_reason"),
        )

    return let(reason, result)
