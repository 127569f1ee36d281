"""Choosing between an article's own summary and a recorded model summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions.responses import NOT_RELEVANT, parse_summary
from broadsheet.functions.text import let
from broadsheet.operators.columns import computed_once


def summarizable(content: Column, min_chars: int) -> Column:
    return F.coalesce(F.length(content), F.lit(0)) >= min_chars


def choose_summary(
    df: DataFrame,
    mode: str,
    min_chars: int,
    allowed: Column | None = None,
    response: str = "summary_response",
    out: str = "summary_outcome",
) -> DataFrame:
    """Replace the summary by a valid model summary where one may be used.

    Short articles, exhausted budgets, failed calls, invalid texts and the
    "not relevant" signal keep the old summary, and so do the modes "disabled" and
    "shadow". Adds ``summary_called`` and, unless disabled, the outcome struct.
    """
    if mode not in ("disabled", "shadow", "live"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "disabled":
        return df.withColumn("summary_called", F.lit(False))
    called = summarizable(F.col("content"), min_chars)
    if allowed is not None:
        called = called & F.coalesce(allowed, F.lit(False))
    answer = F.col(response)
    status = F.coalesce(answer["status"], F.lit("unknown"))
    ok = status == "ok"
    failed = F.concat(status, F.lit(": "), F.coalesce(answer["error"], F.lit("")))
    df = df.withColumn("summary_called", called)

    def outcome(parsed: Column) -> Column:
        return F.struct(
            parsed["text"].alias("text"),
            (ok & parsed["valid"]).alias("valid"),
            F.when(ok & ~parsed["valid"], F.lit("parse_error")).otherwise(status).alias("status"),
            F.when(~ok, failed).when(~parsed["valid"], parsed["fallback_reason"]).alias("fallback_reason"),
        )

    parsed = parse_summary(F.when(ok, answer["text"]))
    df = computed_once(df, {out: let(parsed, outcome)})
    if mode == "live":
        usable = (
            F.col("summary_called") & F.col(out)["valid"] & (F.col(out)["text"] != NOT_RELEVANT)
        )
        df = df.withColumn("summary", F.when(usable, F.col(out)["text"]).otherwise(F.col("summary")))
    return df
