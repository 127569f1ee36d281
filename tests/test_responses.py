from __future__ import annotations

import json

import pytest

from broadsheet.functions import responses as R


def _answer(**fields):
    return json.dumps({"category": "startups", "country": "Germany", "eu_relevance": 8, "confidence": 0.9, **fields})


CASES = [
    (_answer(), ("startups", "Germany", 8.0, 0.9, "")),
    (_answer(category="policy"), ("policy", "Germany", 8.0, 0.9, "")),
    (_answer(category="OTHER "), ("other", "Germany", 8.0, 0.9, "")),
    (_answer(category="sports"), "invalid_category: sports"),
    ("", "empty_response"),
    ("  \n ", "empty_response"),
    (None, "empty_response"),
    ("not json", "json_parse_error"),
    (_answer() + " trailing words", "json_parse_error"),
    (_answer() + _answer(), "json_parse_error"),
    (_answer() + "," + _answer(), "json_parse_error"),
    ("1], [2", "json_parse_error"),
    ("{'category': 'policy'}", "json_parse_error"),
    ("```json\n" + _answer() + "\n```", ("startups", "Germany", 8.0, 0.9, "")),
    ("```\n" + _answer() + "\n```\n", ("startups", "Germany", 8.0, 0.9, "")),
    (_answer(eu_relevance=15), ("startups", "Germany", 10.0, 0.9, "")),
    (_answer(eu_relevance=-3), ("startups", "Germany", 0.0, 0.9, "")),
    (_answer(eu_relevance="high"), ("startups", "Germany", 0.0, 0.9, "")),
    (_answer(eu_relevance="8"), ("startups", "Germany", 8.0, 0.9, "")),
    (_answer(eu_relevance=None), ("startups", "Germany", 0.0, 0.9, "")),
    (_answer(eu_relevance=True), ("startups", "Germany", 1.0, 0.9, "")),
    ('{"category": "research"}', ("research", "", 0.0, 0.0, "")),
    (_answer(country=42), ("startups", "", 8.0, 0.9, "")),
    (_answer(country=" France "), ("startups", "France", 8.0, 0.9, "")),
    (_answer(confidence=1.5), ("startups", "Germany", 8.0, 1.0, "")),
    ("[1, 2]", "response_not_dict"),
    ('"text"', "response_not_dict"),
    ("null", "response_not_dict"),
    (_answer(category=3), "category_not_string"),
    (_answer(category=None), "category_not_string"),
    ('{"country": "France"}', "invalid_category: "),
]


def test_classification_answers(apply):
    got = apply(R.parse_classification, [text for text, _ in CASES])
    for (text, expected), row in zip(CASES, got):
        if isinstance(expected, str):
            expected = ("", "", 0.0, 0.0, expected)
        actual = (row.category, row.country, row.eu_relevance, row.confidence, row.fallback_reason)
        assert actual == expected, text
        assert row.valid == (expected[4] == "")


@pytest.mark.parametrize(
    "fields, category, eu",
    [
        ({"confidence": 0.3}, "other", 0.0),
        ({"confidence": 0.7}, "startups", 8.0),
        ({"confidence": 0.5}, "startups", 8.0),
        ({"eu_relevance": 1.0}, "other", 0.0),
        ({"eu_relevance": 2.0}, "startups", 2.0),
        ({"category": "other"}, "other", 0.0),
    ],
)
def test_demotion(apply, fields, category, eu):
    checked = lambda text: R.validate_classification(R.parse_classification(text))
    row = apply(checked, [_answer(**fields)])[0]
    assert (row.category, row.eu_relevance, row.country) == (category, eu, "Germany")


def test_summaries(apply):
    cases = [
        ("Two sentences. Here they are.", "Two sentences. Here they are.", ""),
        ("One. Two. Three.", "One. Two. Three.", ""),
        ("Version 3.5 is out", "Version 3.5 is out", ""),
        ("", "", "empty_summary"),
        (" \n", "", "empty_summary"),
        (None, "", "empty_summary"),
        ('""', "", "empty_summary"),
        ('"', "", "empty_summary"),
        ("# Heading\nText.", "", "contains_formatting"),
        ("Text.\n## Heading", "", "contains_formatting"),
        ("#hashtag is fine.", "#hashtag is fine.", ""),
        ("Some **bold** text.", "", "contains_formatting"),
        ("A <b>tag</b>.", "", "contains_formatting"),
        ("1 < 2 and 3 > 2.", "1 < 2 and 3 > 2.", ""),
        ("A. B. C. D. E. F. G.", "", "too_long"),
        ("? ! .", "", "too_short"),
        ('"Quoted text. Really."', "Quoted text. Really.", ""),
        ("'Quoted.'", "Quoted.", ""),
        ("NOT_RELEVANT", "NOT_RELEVANT", ""),
        ("Not Relevant to us.", "NOT_RELEVANT", ""),
    ]
    got = apply(R.parse_summary, [c[0] for c in cases])
    assert [(r.text, r.fallback_reason, r.valid) for r in got] == [(t, f, f == "") for _, t, f in cases]


def test_fences(apply):
    cases = {"```json\n{}\n```": "{}", "{}": "{}", "a\n```": "a\n```", " ```\nx\n``` \n": "x"}
    assert apply(R.strip_code_fence, list(cases)) == list(cases.values())
