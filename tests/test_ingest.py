from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from broadsheet.config import EngineConfig
from broadsheet.operators import ingest
from broadsheet.sources import completer, feeds, tables
from broadsheet.schemas import FEED_ENTRY

DATA = Path(__file__).parent / "data"
NOW = datetime(2024, 3, 1)
PAGES = "url string, page_text string, page_image string"


def _first(spark):
    index = spark.createDataFrame([("first.xml", 4, "https://feed.example/rss")], "file string, source_rank long, feed_url string")
    return feeds.read_feeds(spark, str(DATA / "first.xml"), index)


def test_rss_to_articles(spark):
    rows, rejects = _first(spark)
    assert rejects.count() == 0
    entries = ingest.feed_entries(rows)
    assert [r.title for r in entries.orderBy("idx").collect()] == ["First & foremost", "Old news", "No title", "Beyond the limit"]
    pages = spark.createDataFrame(
        [("https://feed.example/1", "p" * 300, None), ("https://feed.example/3", "tiny", "https://img.example/page.png")], PAGES
    )
    config = EngineConfig(per_source_limit=3)
    out = ingest.entry_articles(entries, pages, NOW, config).orderBy("seq").collect()
    # the stale second entry uses up a place
    assert [(r.seq, r.url) for r in out] == [(12, "https://feed.example/1"), (14, "https://feed.example/3")]
    one, three = out
    assert one.source == "Tech.eu" and one.content == "p" * 300
    assert one.summary == "<p>Short <b>summary</b> text</p>"
    assert one.published_date == datetime(2024, 2, 26, 9) and one.image_url == "https://img.example/1.jpg"
    assert three.content == "The full article body of three" and three.published_date is None
    assert three.image_url == "https://img.example/page.png"


def test_atom(spark):
    rows, _ = feeds.read_feeds(spark, str(DATA / "atom.xml"), kind="atom")
    entry = ingest.feed_entries(rows).first()
    assert (entry.title, entry.link, entry.published) == ("An entry", "https://atom.example/1", "2024-02-28T12:00:00Z")
    assert entry.enclosures[0].href == "https://img.example/atom.png"


def test_a_broken_feed_does_not_stop_the_others(spark, tmp_path):
    for name in ("first.xml",):
        (tmp_path / name).write_text((DATA / name).read_text())
    (tmp_path / "broken.xml").write_text("<rss><channel><title>x</title><item><title>a</b></item></channel></rss>")
    rows, rejects = feeds.read_feeds(spark, str(tmp_path))
    assert [r.feed_title for r in rows.collect()] == ["Deeptech - Tech.eu"]
    assert rejects.count() == 1


def _entry(spark, **fields):
    row = dict(source_rank=0, feed_url="f", feed_title="T", idx=0, title="t", link="l", summary="", published="",
               content=None, media_content=None, enclosures=None)
    row.update(fields)
    names = [c.strip().split(" ")[0] for c in
             "source_rank,feed_url,feed_title,idx,title,link,summary,published,content,media_content,enclosures".split(",")]
    return spark.createDataFrame([tuple(row[n] for n in names)], FEED_ENTRY)


def _article(spark, page=None, **fields):
    pages = spark.createDataFrame([("l", page, None)] if page is not None else [], PAGES)
    return ingest.entry_articles(_entry(spark, **fields), pages, NOW).first()


def test_text_fallback(spark):
    html = "<p>" + "Some feed text. " * 5 + "</p>"
    cleaned = ("Some feed text. " * 5).strip()
    row = _article(spark, page="", summary=html)
    assert (row.content, row.summary) == (cleaned, html)
    assert _article(spark, page="p" * 250, summary=html).content == "p" * 250
    assert _article(spark, page="page text", summary="<b>x</b>").content == "page text"
    assert _article(spark, summary=html, content=[("<p>Encoded</p>",)]).content == "Encoded"
    assert _article(spark, summary=html, content=[("<p> </p>",), ("second",)]).content == cleaned
    assert _article(spark).content == ""


def test_images(spark):
    media = [("https://m.example/1.jpg",), ("https://m.example/2.jpg",)]
    files = [("audio/mpeg", "https://e.example/a.mp3"), ("image/png", "ftp://e.example/x"), ("image/png", "https://e.example/2.png"), (None, "x")]
    assert _article(spark, media_content=media, enclosures=files).image_url == "https://m.example/1.jpg"
    # only the first media element counts
    assert _article(spark, media_content=[("bad",), media[0]], enclosures=files).image_url == "https://e.example/2.png"
    assert _article(spark).image_url is None


def test_age(spark):
    dates = [NOW - timedelta(days=d) for d in (5, 60, 29, 30)] + [None, NOW - timedelta(days=30, seconds=1)]
    df = spark.createDataFrame(list(enumerate(dates)), "i int, published_date timestamp_ntz")
    assert sorted(r.i for r in ingest.fresh(df, NOW, 30).collect()) == [0, 2, 3, 4]


def test_sources(spark, apply):
    names = ["https://sifted.eu", "Deeptech - Tech.eu", "Somewhere"]
    assert apply(ingest.normalize_source, names) == ["Sifted", "Tech.eu", "Somewhere"]
    table = spark.createDataFrame([("a", "A"), ("a", "A"), ("b", "B")], "alias string, canonical string")
    rows = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "a")], "i int, source string")
    out = ingest.join_source_alias(rows, table).orderBy("i").collect()
    assert [r.source for r in out] == ["A", "c", None, "A"]


def test_first_n_is_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    cut = ingest.first_n(df, ["g"], ["o"], 3)
    assert sorted(r.o for r in cut.collect()) == [0, 1, 2, 3, 4, 5]
    assert "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()


def test_web_channel(spark):
    listing = """<a href="/news/1">1</a> <a class="x" href='https://other.example/blog/2?a=1&amp;b=2'>2</a>
      <a href="/about">no</a><a href="news/1">relative</a><a href="/News/1">case</a><a href="/news/1#top">1</a><a href="/news/1">again</a>"""
    pages = spark.createDataFrame([(7, "https://sifted.eu", listing)], "page_id long, url string, html string")
    links = [r.link for r in ingest.page_links(pages).orderBy("place").collect()]
    assert links == [
        "https://sifted.eu/news/1", "https://other.example/blog/2?a=1&b=2", "https://sifted.eu/News/1", "https://sifted.eu/news/1#top"
    ]
    body = """<html><head><title>The &lt;Title&gt;</title><meta content='Lead in' name='description'>
      <meta property="og:image" content="https://img.example/x.png"><meta property="article:published_time" content="2024-02-01T00:00:00+01:00"></head>
      <nav>menu</nav><article class="a"><h1>Head</h1><p>Body&nbsp;text</p></article></html>"""
    fetched = ingest.page_extract(spark.createDataFrame([("https://sifted.eu/news/1", body)], "url string, html string"))
    out = ingest.web_articles(pages, fetched).collect()
    assert len(out) == 1
    row = out[0]
    assert (row.title, row.content, row.summary, row.source) == ("The <Title>", "Head Body text", "Lead in", "Sifted")
    assert row.published_date == datetime(2024, 1, 31, 23) and row.image_url == "https://img.example/x.png"
    feed = spark.createDataFrame([(1, "u")], "seq long, url string")
    both = ingest.union_channels(feed, spark.createDataFrame([(0, "w")], "seq long, url string")).orderBy("seq").collect()
    assert [r.url for r in both] == ["u", "w"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", "u", ' A "quoted", title ', "S", "", "", "two\nlines", "", "2024")]
    df = spark.createDataFrame(rows, tables.ARTICLE_CSV)
    tables.write_csv(df, str(tmp_path / "csv"))
    assert tables.read_articles_csv(spark, str(tmp_path / "csv")).collect() == df.collect()


def test_completer(spark):
    def answer(prompt):
        if prompt == "bad":
            raise RuntimeError("no luck")
        return {"text": prompt.upper(), "tokens_in": 3, "model": "m"}

    prompts = spark.createDataFrame([(1, "classification", "ok"), (2, "classification", "bad")], "seq long, stage string, prompt string")
    out = completer.complete(prompts, answer).orderBy("seq").collect()
    assert [(r.status, r.text, r.tokens_in) for r in out] == [("ok", "OK", 3), ("api_error", "", 0)]
    assert out[1].error == "no luck"


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body>
<header>Site name and a long motto that nobody wants to read as text of an article at all</header>
<ul><li><a href="/1">A long link to some other article</a></li><li><a href="/2">Yet another long link to follow</a></li></ul>
<div class="cookies">We use cookies.</div>{}
<div><a href="/more">Read more about all of these and many other things on the next page</a></div>
<form>Subscribe to the newsletter with your address and never miss a single story of ours</form>
<p>Share this.</p><footer>Imprint, privacy and a lot of other words that are on every single page</footer>
<script>var text = "<p>not a paragraph but a very long string in a script of the page itself</p>";</script></body></html>"""


def test_main_text_without_article_element(spark):
    long = "A paragraph of the article that is long enough to be told from a short notice by its size. "
    bodies = [
        f"<h1>Headline of the page that is long enough to belong to the text, at any rate</h1><p>{long}</p><p>Short.</p><p>{long * 2}</p>",
        f"<div><div><p>{long * 3}<b>bold</b> &amp; more <a href='x'>a link</a> inside.</p></div></div>",
        "<p>Tiny.</p>", "",
    ]
    rows = [(k, PAGE.format(b)) for k, b in enumerate(bodies)]
    rows += [(4, f"<article></article><p>{long}"), (5, None), (6, ""), (7, f"<section>{long * 2000}</section><nav>{long}</nav>")]
    found = {r.k: r.page_text for r in ingest.page_extract(
        spark.createDataFrame(rows, "k int, html string")).collect()}
    head = "Headline of the page that is long enough to belong to the text, at any rate"
    assert found[0] == f"{head} {long}Short. {long * 2}".strip()
    assert found[1] == f"{long * 3}bold & more a link inside."
    # nothing scores: all blocks are taken, without menus and scripts
    assert found[2].endswith("Tiny. Read more about all of these and many other things on the next page Share this.")
    assert "cookies" in found[3] and "Imprint" not in found[3]
    assert found[4] == long.strip() and found[5] == found[6] == "" and found[7] == (long * 2000).strip()


def test_main_text_equals_a_search_over_all_runs(spark):
    import random
    import re

    r = random.Random(11)
    rows = []
    for k in range(60):
        blocks = [r.choice(["", "w" * r.randint(1, 160), f"<a href='x'>{'l' * r.randint(1, 50)}</a> {'t' * r.randint(0, 90)}"])
                  for _ in range(r.randint(1, 9))]
        rows.append((k, "<p>".join(blocks), blocks))
    found = {x.k: x.t for x in spark.createDataFrame([x[:2] for x in rows], "k int, html string")
             .select("k", ingest.main_text(F.col("html")).alias("t")).collect()}
    for k, _, blocks in rows:
        plain = [re.sub("<[^>]*>", " ", b).strip() for b in blocks]
        links = [sum(map(len, re.findall("<a[^>]*>(.*?)</a>", b))) for b in blocks]
        score = [len(" ".join(p.split())) - 3 * n - 40 if p else 0 for p, n in zip(plain, links)]
        runs = [(-sum(score[a:b + 1]), b, -a) for a in range(len(blocks)) for b in range(a, len(blocks))]
        best, end, start = min(runs)
        run = plain[-start:end + 1] if best < 0 else plain
        assert found[k] == " ".join(" ".join(run).split())
