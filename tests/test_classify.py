from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_RULES, RuleSet
from broadsheet.operators import classify as C
from broadsheet.operators.classify import classify, compare_labelers, keyword_labels, model_outcome
from broadsheet.operators.quality import quality_score
from broadsheet.operators.summarize import choose_summary

RESPONSE = "struct<text:string,status:string,error:string,model:string,latency_ms:bigint,tokens_in:bigint,tokens_out:bigint>"
ARTICLE = "seq long, title string, content string, source string, summary string"


def _articles(spark, rows):
    full = [(i, r[0], r[1], r[2] if len(r) > 2 else "Unknown", r[3] if len(r) > 3 else "") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ARTICLE)


def _labels(spark, rows, rules=DEFAULT_RULES):
    out = keyword_labels(_articles(spark, rows), rules).orderBy("seq").collect()
    return [(r.category, r.country, r.eu_relevance, r.confidence) for r in out]


def test_topics_and_countries(spark):
    rows = [
        ("New AI startup raises money", "A machine learning company in Paris"),
        ("Rules for tech", "The new AI regulation by the government"),
        ("A neural network study", "Deep learning in Berlin"),
        ("Cloud computing grows", "Servers everywhere"),
        ("Geopolitics of fuel prices", "Oil and gas markets"),
        ("Farming", "A law about farms"),
        ("AI in Europe", "robotics for the continent"),
        ("Impact", "semiconductor impact"),
    ]
    got = _labels(spark, rows)
    assert [g[0] for g in got] == [
        "startups", "policy", "research", "industry", "other", "other", "industry", "policy"
    ]
    assert [g[1] for g in got] == ["France", "", "Germany", "", "", "", "Europe", ""]
    assert [g[3] for g in got] == [0.6, 0.6, 0.6, 0.6, 0.7, 0.7, 0.6, 0.6]
    assert got[4] == ("other", "", 0.0, 0.7)


def test_weak_words_need_company(spark):
    got = _labels(spark, [
        ("A platform", "for politics"), ("software platform", "with automation"), ("technology", "once in business"),
    ])
    assert [g[0] == "other" for g in got] == [True, False, True]


def test_relevance(spark):
    got = _labels(spark, [
        ("OpenAI launches a model", "in the US", "Sifted"),
        ("French AI startup", "from Paris in Europe", "Sifted"),
        ("French German Dutch Irish AI startup", "spanish italian swedish danish finnish polish greek czech", "Tech.eu"),
    ])
    # title 1 word (2.0), text adds "europe" (0.5), outlet 2.0, country 1.0
    assert [g[2] for g in got] == [0.0, 5.5, 10.0]


def test_relevance_matches_a_plain_loop(spark):
    texts = [("The EU's GDPR " + " ".join(DEFAULT_RULES.eu_keywords[i:i + 3]), "ai act machine learning " + " ".join(DEFAULT_RULES.eu_keywords[j::7]))
             for i in range(0, 50, 9) for j in range(0, 7, 3)]
    got = _labels(spark, [(t, c, "Sifted") for t, c in texts])
    for (title, content), label in zip(texts, got):
        whole, head = f" {title.lower()} {content.lower()} ", f" {title.lower()} "
        in_title = sum(k in head for k in DEFAULT_RULES.eu_keywords)
        extra = max(sum(k in whole for k in DEFAULT_RULES.eu_keywords) - in_title, 0)
        country = next((n for n, ks in DEFAULT_RULES.countries if any(k in whole for k in ks)), "")
        score = min(in_title * 2.0, 4.0) + min(extra * 0.5, 3.0)
        score += 2.0 if in_title or extra else 0.0
        score += 1.0 if country else 0.0
        assert label[1:3] == (country, min(score, 10.0))


def test_word_boundary_option(spark):
    rows = [("Impact", "semiconductor impact"), ("An act", "semiconductor")]
    strict = RuleSet(word_boundary=True)
    assert [g[0] for g in _labels(spark, rows)] == ["policy", "policy"]
    assert [g[0] for g in _labels(spark, rows, strict)] == ["industry", "policy"]


def _with_answers(spark, texts, statuses=None):
    rows = []
    for i, text in enumerate(texts):
        status = statuses[i] if statuses else "ok"
        answer = None if text is None else (text, status, "boom" if status != "ok" else "", "m", 5, 10, 2)
        rows.append((i, "AI startup", "x" * 300, "S", "old", answer))
    return spark.createDataFrame(rows, ARTICLE + ", response " + RESPONSE)


GOOD = '{"category": "policy", "country": "Spain", "eu_relevance": 7, "confidence": 0.9}'


@pytest.mark.parametrize(
    "mode, expected",
    [
        ("disabled", ["startups"] * 4),
        ("shadow", ["startups"] * 4),
        ("live", ["policy", "startups", "startups", "startups"]),
    ],
)
def test_modes(spark, mode, expected):
    rows = _with_answers(spark, [GOOD, "broken", None, GOOD])
    out = classify(rows, mode, allowed=F.col("seq") < 3).orderBy("seq").collect()
    assert [r.category for r in out] == expected
    assert [r.called for r in out] == ([False] * 4 if mode == "disabled" else [True, True, True, False])


def test_outcome_status(spark):
    rows = _with_answers(spark, [GOOD, "broken", GOOD, None], ["ok", "ok", "api_error", "ok"])
    out = [r.outcome for r in model_outcome(rows).orderBy("seq").collect()]
    assert [o.status for o in out] == ["ok", "parse_error", "api_error", "unknown"]
    assert [o.fallback_reason for o in out] == [None, "json_parse_error", "api_error: boom", "unknown: "]
    assert [o.valid for o in out] == [True, False, False, False]
    with pytest.raises(ValueError):
        classify(rows, "sometimes")


def test_compare(spark):
    out = compare_labelers(_with_answers(spark, [GOOD.replace("policy", "startups"), "broken"])).orderBy("seq").collect()
    assert [(r.keyword_category, r.model_category, r.match) for r in out] == [
        ("startups", "startups", True), ("startups", "FAIL", False)
    ]


def test_summary_choice(spark):
    texts = ["New text.", "NOT_RELEVANT", "**bad**", None, "New text."]
    rows = _with_answers(spark, texts).withColumnRenamed("response", "summary_response")
    rows = rows.withColumn("content", F.when(F.col("seq") == 4, "short").otherwise(F.col("content")))
    live = choose_summary(rows, "live", 200).orderBy("seq").collect()
    assert [r.summary for r in live] == ["New text.", "old", "old", "old", "old"]
    assert [r.summary_called for r in live] == [True, True, True, True, False]
    assert [r.summary_outcome.status for r in live][:4] == ["ok", "ok", "parse_error", "unknown"]
    shadow = choose_summary(rows, "shadow", 200).orderBy("seq").collect()
    assert {r.summary for r in shadow} == {"old"}
    blocked = choose_summary(rows, "live", 200, allowed=F.lit(False)).collect()
    assert {r.summary for r in blocked} == {"old"}


def _score(spark, words, title, source, eu, category="", country="", summary=""):
    row = [("t " * words, title, source, float(eu), category, country, summary)]
    df = spark.createDataFrame(row, "content string, title string, source string, eu_relevance double, category string, country string, summary string")
    return quality_score(df).first().quality_score


def test_quality(spark):
    title = "one two three four five six"
    low = _score(spark, 3, "short", "unknown", 0)
    high = _score(spark, 900, title, "Sifted", 8, "startups", "France", "text")
    assert low == 0.05 and high == 1.0
    assert _score(spark, 400, title, "TNW", 5) == 0.20 + 0.18 + 0.15 + 0.10 + 0.0
    by_relevance = [_score(spark, 0, "", "x", e) for e in (1, 3, 5, 8)]
    by_source = [_score(spark, 0, "", s, 0) for s in ("x", "TNW", "Sifted")]
    assert by_relevance == sorted(set(by_relevance)) and by_source == sorted(set(by_source))
    # the terms are doubles: a decimal sum of .40 may stay below the gate
    assert _score(spark, 800, "", "x", 0, "policy") == 0.3 + 0.0 + 0.0 + 0.05 + (0.05 + 0.0 + 0.0)
    assert _score(spark, 800, "", "x", 0, "policy") < 0.4


def test_filters_do_not_copy_the_keyword_expressions(spark):
    scored = quality_score(keyword_labels(_articles(spark, [("AI", "startup")])))
    kept = scored.filter("quality_score >= 0.1 and category <> 'other' and eu_relevance >= 0")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("machine learning") == 1
    narrow = scored.select("seq")._jdf.queryExecution().optimizedPlan().toString()
    assert "machine learning" not in narrow


def test_labels_under_several_modes_equal_those_under_each(spark):
    good = '{"category": "research", "country": "France", "eu_relevance": 9, "confidence": 0.9}'
    rows = [(1, "French AI startup raises", "text about machine learning", "Sifted", good, "ok"),
            (2, "Weather", "rain", "Other", good, "ok"), (3, "AI startup", "software", "Other", "{", "ok"),
            (4, "AI startup", "software", "Other", None, "api_error")]
    df = spark.createDataFrame(rows, "seq long, title string, content string, source string, text string, status string")
    df = df.withColumn("response", F.struct(
        "text", "status", F.lit("e").alias("error"), F.lit("m").alias("model"), F.lit(1).alias("latency_ms"),
        F.lit(1).alias("tokens_in"), F.lit(1).alias("tokens_out")))
    allowed = F.col("seq") != 2
    columns = ["seq", "category", "country", "eu_relevance", "confidence", "called", "label_origin"]
    modes = ("disabled", "shadow", "live")
    every = C.classify_under_modes(df, modes, allowed=allowed)
    for mode in modes:
        one = C.classify(df, mode, allowed=allowed).select(*columns)
        same = every.filter(F.col("mode") == mode).select(*columns)
        assert sorted(map(str, one.collect())) == sorted(map(str, same.collect()))
    with pytest.raises(ValueError):
        C.classify_under_modes(df, ["other"])
