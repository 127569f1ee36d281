"""Rule-based and recorded-model classification of articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_RULES, EngineConfig, RuleSet
from broadsheet.functions import keywords as K
from broadsheet.functions.responses import parse_classification, validate_classification
from broadsheet.functions.text import let
from broadsheet.operators.columns import computed_once

RESPONSE_FIELDS = ("text", "status", "error", "model", "latency_ms", "tokens_in", "tokens_out")


def keyword_labels(
    df: DataFrame,
    rules: RuleSet = DEFAULT_RULES,
    needed: Column | None = None,
    prefix: str = "",
) -> DataFrame:
    """Add category, country, eu_relevance and confidence from keyword rules.

    Texts that fail the relevance gate become "other" without country or relevance, and
    their words are not searched further. Rows where ``needed`` is false get NULLs and
    are not searched at all.
    """
    text = K.search_text(F.col("title"), F.col("content"))
    if needed is not None:
        text = F.when(needed, text)
    names = [prefix + c for c in ("category", "country", "eu_relevance", "confidence")]
    category, country, eu, confidence = names
    gate = F.col("_gate")
    df = df.withColumn("_text", text)
    df = df.withColumn("_gate", K.tech_relevant(F.col("_text"), rules))
    df = df.withColumn(
        "_found",
        F.when(gate, K.matched(F.col("_text"), K.region_keywords(rules), rules.word_boundary)),
    )
    df = df.withColumn("_country", F.when(gate, K.country_of(F.col("_found"), rules)))
    topic = F.when(gate, K.topic(F.col("_text"), rules))
    score = F.when(
        gate,
        K.relevance(F.col("title"), F.col("source"), F.col("_found"), F.col("_country"), rules),
    )
    off_topic = ~gate
    labelled = computed_once(
        df,
        {
            category: F.when(off_topic, F.lit("other")).otherwise(topic),
            country: F.when(off_topic, F.lit("")).otherwise(F.col("_country")),
            eu: F.when(off_topic, F.lit(0.0)).otherwise(score),
            confidence: F.when(off_topic, F.lit(0.7)).when(gate, F.lit(0.6)),
        },
    )
    return labelled.drop("_text", "_gate", "_found", "_country")


def join_response(
    articles: DataFrame, responses: DataFrame, stage: str, key: str = "seq",
    out: str = "response",
) -> DataFrame:
    """Attach the recorded response of one stage as a struct, NULL where there is none."""
    record = F.struct(*[F.col(c) for c in RESPONSE_FIELDS])
    answers = responses.filter(F.col("stage") == stage).select(key, record.alias(out))
    return articles.join(answers, key, "left")


def model_outcome(df: DataFrame, response: str = "response", out: str = "outcome") -> DataFrame:
    """Add the checked classification of a response with its telemetry status.

    A failed call keeps its status and gives ``status: error`` as the reason; an answer
    that does not parse becomes ``parse_error`` with the parser's reason.
    """
    answer = F.col(response)
    status = F.coalesce(answer["status"], F.lit("unknown"))
    ok = status == "ok"
    failed = F.concat(status, F.lit(": "), F.coalesce(answer["error"], F.lit("")))

    def outcome(checked: Column) -> Column:
        return F.struct(
            checked["category"].alias("category"),
            checked["country"].alias("country"),
            checked["eu_relevance"].alias("eu_relevance"),
            checked["confidence"].alias("confidence"),
            (ok & checked["valid"]).alias("valid"),
            F.when(ok & ~checked["valid"], F.lit("parse_error")).otherwise(status).alias("status"),
            F.when(~ok, failed)
            .when(~checked["valid"], checked["fallback_reason"])
            .alias("fallback_reason"),
        )

    # the text of a failed call is not looked at: it parses as an empty, invalid answer
    checked = validate_classification(parse_classification(F.when(ok, answer["text"])))
    return computed_once(df, {out: let(checked, outcome)})


def mode_of(config: EngineConfig) -> str:
    if not config.classification_enabled:
        return "disabled"
    return "shadow" if config.shadow_mode else "live"


def classify(
    df: DataFrame,
    mode: str,
    rules: RuleSet = DEFAULT_RULES,
    allowed: Column | None = None,
    response: str = "response",
    out: str = "outcome",
) -> DataFrame:
    """Final labels under a mode, plus ``called`` and ``label_origin``.

    "disabled" never looks at the answer; "shadow" records its outcome and labels by
    keywords; "live" takes a valid answer. A call the budget does not allow counts as
    not made. Keywords are searched only where they decide.
    """
    if mode not in ("disabled", "shadow", "live"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "disabled":
        return keyword_labels(df, rules).withColumns(
            {"called": F.lit(False), "label_origin": F.lit("keywords")}
        )
    called = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    df = model_outcome(df.withColumn("called", called), response, out)
    use_model = F.lit(mode == "live") & F.col("called") & F.col(out)["valid"]
    df = df.withColumn("_use_model", use_model)
    df = keyword_labels(df, rules, needed=~F.col("_use_model"), prefix="_kw_")
    labels = {
        name: F.when(F.col("_use_model"), F.col(out)[name]).otherwise(F.col("_kw_" + name))
        for name in ("category", "country", "eu_relevance", "confidence")
    }
    labels["label_origin"] = F.when(F.col("_use_model"), "model").otherwise("keywords")
    return df.withColumns(labels).drop("_use_model", *["_kw_" + n for n in (
        "category", "country", "eu_relevance", "confidence")])


def classify_under_modes(
    df: DataFrame,
    modes: Sequence[str],
    rules: RuleSet = DEFAULT_RULES,
    allowed: Column | None = None,
    response: str = "response",
) -> DataFrame:
    """The labels of :func:`classify` under several modes, a row per mode, with ``mode``.

    Keywords are searched and answers checked once per article, however many modes there are.
    """
    called = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    names = ("category", "country", "eu_relevance", "confidence")
    both = keyword_labels(
        model_outcome(df.withColumn("_called", called), response, "_outcome"), rules, prefix="_kw_")
    rows = []
    for mode in modes:
        if mode not in ("disabled", "shadow", "live"):
            raise ValueError(f"unknown mode: {mode}")
        use_model = F.lit(mode == "live") & F.col("_called") & F.col("_outcome")["valid"]
        rows.append(F.struct(
            F.lit(mode).alias("mode"), (F.lit(mode != "disabled") & F.col("_called")).alias("called"),
            *[F.when(use_model, F.col("_outcome")[n]).otherwise(F.col("_kw_" + n)).alias(n) for n in names],
            F.when(use_model, "model").otherwise("keywords").alias("label_origin"),
        ))
    kept = [c for c in df.columns if c not in (*names, "mode", "called", "label_origin")]
    return both.select(*kept, F.inline(F.array(*rows)))


def compare_labelers(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Keyword and model labels side by side with a match flag.

    Expects a ``response`` struct; a call without a valid answer shows as "FAIL".
    """
    both = keyword_labels(model_outcome(df), rules, prefix="keyword_")
    valid = F.col("outcome.valid")
    return both.select(
        "seq",
        "title",
        "source",
        "keyword_category",
        "keyword_country",
        F.when(valid, F.col("outcome.category")).otherwise(F.lit("FAIL")).alias("model_category"),
        F.when(valid, F.col("outcome.country")).otherwise(F.lit("-")).alias("model_country"),
        F.when(valid, F.col("outcome.eu_relevance")).alias("model_eu_relevance"),
        (valid & (F.col("outcome.category") == F.col("keyword_category"))).alias("match"),
    )
