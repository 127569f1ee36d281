from __future__ import annotations

import hashlib
import html as html_lib
from datetime import datetime
from urllib.parse import urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import text as T
from broadsheet.functions.dates import parse_date
from broadsheet.functions.markdown import filename, frontmatter
from broadsheet.functions.urls import resolve_url
from broadsheet.config import EngineConfig

RELAXED = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_clean_text(apply):
    cases = {
        None: "",
        "": "",
        "plain  text\n here": "plain text here",
        "<p>One</p><p>Two &amp; three</p>": "One Two & three",
        "a<!-- hidden <b> -->b": "a b",
        "<script>var t='</p>';</script>x<style>p{}</style>": "x",
        "see https://x.example/a.jpg?w=1 now": "see now",
        "https://x.example/a.JPG": "https://x.example/a.JPG",
        "&lt;b&gt; stays text": "<b> stays text",
        "&amp;lt; once": "&lt; once",
        "caf&eacute; &#233; &#xE9; &hearts; &nosuch; &#55296; AT&T": "café é é ♥ &nosuch; � AT&T",
        "&amp;#38; &#38;amp; &amp;amp;": "&#38; &amp; &amp;",
    }
    assert apply(T.clean_text, list(cases)) == list(cases.values())


@RELAXED
@given(st.lists(st.text(alphabet="a &;#x6l7tgmpnbsq38.", max_size=40), min_size=1, max_size=30))
def test_entities_agree_with_the_standard_library(apply, texts):
    texts = [t for t in texts if "&#" not in t.replace("&#38;", "")] or ["&#38;"]
    # the standard library also takes some names without ';', which is not wanted here
    strict = [t for t in texts if html_lib.unescape(t) == t or ";" in t and not _bare_entity(t)]
    assert apply(T.decode_entities, strict or ["x"]) == [html_lib.unescape(t) for t in strict or ["x"]]


def _bare_entity(text: str) -> bool:
    import re

    return any(
        html_lib.unescape("&" + name) != "&" + name
        for name in re.findall(r"&([A-Za-z0-9#]+)(?![A-Za-z0-9#]*;)", text)
    )


@RELAXED
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85\xa0 　ab.é", max_size=30), min_size=1, max_size=40))
def test_spaces_count_as_in_python(apply, texts):
    assert apply(T.word_count, texts) == [len(t.split()) for t in texts]
    assert apply(T.strip, texts) == [t.strip() for t in texts]
    assert apply(T.collapse_spaces, texts) == [" ".join(t.split()) for t in texts]


def test_hashes(spark):
    row = spark.range(1).select(
        T.article_hash(F.lit("t"), F.lit("u"), F.lit("s")).alias("a"),
        T.content_hash(F.lit("u"), F.lit("t")).alias("c"),
        T.content_hash(F.lit(None).cast("string"), F.lit("t")).alias("n"),
    ).first()
    assert row.a == hashlib.sha256(b"tus").hexdigest()
    assert row.c == hashlib.sha256(b"u|t").hexdigest()
    assert row.n == hashlib.sha256(b"|t").hexdigest()


def test_image_urls(apply):
    long = "https://x.example/" + "a" * 2048
    values = ["https://x.example/a.jpg", "http://x.example/a", None, "", "ftp://x/a", "//x/a", long, "  https://x/a \n"]
    assert apply(T.valid_image_url, values) == [values[0], values[1]] + [None] * 5 + ["https://x/a"]


def test_slug_and_filename(spark, apply):
    titles = ["Crème Brûlée: 1,000 Straßen!", "  --  ", "Łódź & Ærø", "don't"]
    assert apply(T.slug, titles) == ["creme-brulee-1000-strassen", "", "lodz-aero", "don-t"]
    now = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    undated = F.lit(None).cast("timestamp_ntz")
    row = spark.range(1).select(
        filename(F.lit("A b"), undated, now).alias("x"),
        filename(F.lit("A b"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), now).alias("y"),
    ).first()
    assert (row.x, row.y) == ("2024-05-06-a-b.md", "2024-01-15-a-b.md")


def test_slugs_of_other_scripts(apply):
    titles = ["Ελληνικά νέα: Ψηφιακή εποχή", "Новини от България", "Щит и ёж, объём", "Ὀδυσσεύς",
              "Київ — Ґанок", "中文 news", "Việt Nam", "日本", "𝐀 b", "été\u0301"]
    found = apply(T.slug, titles)
    assert found[:5] == ["ellenika-nea-psephiake-epokhe", "novini-ot-blgariia",
                         "shchit-i-ezh-obem", "odusseus", "kiiv-ganok"]
    assert found[5] == "u4e2du6587-news" and found[6] == "viet-nam" and found[7] == "u65e5u672c"
    assert found[9] == "ete" and len(set(found)) == len(found)


def test_frontmatter(spark):
    values = dict(title='Say "hi"', source="S", url="u", category="policy", country="", summary="s" * 200)
    columns = {k: F.lit(v) for k, v in values.items()}
    columns["published_date"] = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    now = F.current_timestamp().cast("timestamp_ntz")
    config = EngineConfig()
    row = spark.range(1).select(
        frontmatter(columns, now, config).alias("raw"), frontmatter(columns, now, config, True).alias("esc")
    ).first()
    lines = row.raw.split("\n")
    assert lines[0] == lines[-1] == "---"
    assert lines[1] == 'title: "Say "hi""' and lines[2] == 'date: "2024-01-15"'
    assert not any(line.startswith("country") for line in lines)
    assert f'description: "{"s" * 160}"' in lines
    assert 'title: "Say \\"hi\\""' in row.esc


def test_prompt_keeps_placeholders_in_values(spark):
    prompt = T.render_prompt("{title}|{source}|{content}|{other}", 4, F.lit("{source}"), F.lit("S"), F.lit("<b>abcdef</b>"))
    assert spark.range(1).select(prompt.alias("p")).first().p == "{source}|S|abcd|{other}"


def test_dates(apply):
    cases = {
        "Mon, 01 Jan 2024 10:00:00 GMT": datetime(2024, 1, 1, 10),
        "Mon, 01 Jan 2024 10:00:00 +0200": datetime(2024, 1, 1, 8),
        "Mon, 1 Jan 2024 10:00 -0530": datetime(2024, 1, 1, 15, 30),
        "2024-01-01T10:00:00Z": datetime(2024, 1, 1, 10),
        "2024-01-01T10:00:00.25-05:00": datetime(2024, 1, 1, 15, 0, 0, 250000),
        "2024-02-30": None,
        "January 5, 2024 10:11": datetime(2024, 1, 5, 10, 11),
        "5 March 2024": datetime(2024, 3, 5),
        "Tue, 02 Jan 2024 03:04:05 EST": datetime(2024, 1, 2, 3, 4, 5),
        "3/4/2024": datetime(2024, 3, 4),
        "soon": None,
        "": None,
        None: None,
    }
    assert apply(parse_date, list(cases)) == list(cases.values())


def test_urls_resolve_as_in_the_standard_library(apply):
    base = "http://a.example/b/c/d?q#f"
    hrefs = ["", "/x", "y", "../y", "../../../y", "?z", "#z", "//h/k", "mailto:a", "./a/./b/..", "g/", ".", "..",
             "a?x=../y", "/x/../y/./z", "https://other.example/p"]
    assert apply(lambda h: resolve_url(F.lit(base), h), hrefs) == [urljoin(base, h) for h in hrefs]
    assert apply(lambda h: resolve_url(F.lit("http://a.example"), h), ["x", "/x"]) == ["http://a.example/x"] * 2
