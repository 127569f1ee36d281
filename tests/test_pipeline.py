from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from broadsheet.config import EngineConfig
from broadsheet.functions.text import article_hash
from broadsheet.operators.classify import keyword_labels
from broadsheet.operators.dedup import ordered_dedup
from broadsheet.operators.ingest import entry_articles, feed_entries
from broadsheet.operators.quality import quality_score
from broadsheet.operators.runs import run_state
from broadsheet.operators.store import store_upsert
from broadsheet.plans import pipeline
from broadsheet.plans.catalog import QUERIES
from broadsheet.plans.pipeline import Tables, deduplicated, run_pipeline, score_articles
from broadsheet.schemas import RESPONSE, RUN_STORE, SOURCE_METRIC, STORE, TELEMETRY
from broadsheet.sources.feeds import read_feeds
from broadsheet.sources.tables import read_table
from broadsheet.streaming.dedup import unique_urls
from broadsheet.streaming.feeds import read_feed_files, read_rejects, start_feed_ingest
from broadsheet.streaming.files import drain, read_file_stream
from broadsheet.streaming.ingest import read_stream_store, start_ingest
from broadsheet.streaming.keys import add_keys, keys_of, known_in, merge_full_tiers, unknown_rows
from broadsheet.streaming.metrics import roll_up, start_windowed_metrics, windowed_metrics

NOW = datetime(2024, 3, 1)
SMALL = "/root/testdata/sf0.001"
ARTICLE = "seq long, title string, url string, source string, content string, summary string, published_date timestamp_ntz, image_url string"
LONG = "French machine learning company " * 300
TITLE = "French AI startup raises new funding"


def _articles(spark):
    rows = [
        (1, TITLE, "u1", "Sifted", LONG, "", None, None),
        (2, TITLE, "u1", "Sifted", LONG, "", None, None),
        (3, TITLE + " again", "u2", "Tech.eu", LONG, "old", None, None),
        (4, "Weather", "u3", "Tech.eu", "rain", "", None, None),
        (5, TITLE + " more", "u4", "Other", LONG, "", None, None),
    ]
    return spark.createDataFrame(rows, ARTICLE)


def _responses(spark):
    good = '{"category": "research", "country": "France", "eu_relevance": 9, "confidence": 0.9}'
    rows = [(i, "classification", good, "ok", "", "p", "m", 10, 100, 10) for i in (1, 3, 4, 5)]
    rows += [(i, "summary", "A new summary.", "ok", "", "p", "m", 10, 100, 10) for i in (1, 3, 4, 5)]
    return spark.createDataFrame(rows, RESPONSE)


def _tables(path):
    return Tables(*[str(path / n) for n in ("store", "metrics", "telemetry", "runs")])


def test_run(spark, tmp_path):
    tables = _tables(tmp_path)
    config = EngineConfig(summary_enabled=True, token_cap=1_000)
    assert run_pipeline(spark, "r1", _articles(spark), _responses(spark), tables, NOW, config) == 3
    stored = read_table(spark, tables.store, STORE).orderBy("id").collect()
    assert [(r.id, r.url, r.category, r.summary) for r in stored] == [
        (1, "u1", "research", "A new summary."), (2, "u2", "research", "A new summary."), (3, "u4", "research", "A new summary.")
    ]
    calls = read_table(spark, tables.telemetry, TELEMETRY)
    # the short article is not summarised
    assert {(r.prompt_version, r["count"]) for r in calls.groupBy("prompt_version").count().collect()} == {("classification", 4), ("summary", 3)}
    per_source = {r.source_name: r for r in read_table(spark, tables.metrics, SOURCE_METRIC).collect()}
    assert (per_source["Sifted"].articles_fetched, per_source["Sifted"].articles_stored) == (2, 1)
    assert per_source["Tech.eu"].category_distribution == '{"research":2}'

    # a second run finds nothing new, and continues the ids
    assert run_pipeline(spark, "r2", _articles(spark), _responses(spark), tables, NOW, config) == 0
    more = _articles(spark).withColumn("url", F.concat("url", F.lit("x"))).withColumn("title", F.concat("title", F.lit(" x")))
    assert run_pipeline(spark, "r3", more, _responses(spark), tables, NOW, config) == 3
    assert sorted(r.id for r in read_table(spark, tables.store, STORE).collect()) == [1, 2, 3, 4, 5, 6]
    states = {r.id: (r.status, r.result_count) for r in run_state(spark.read.parquet(tables.runs), ["status"]).collect()}
    assert states["r1"][1] in (3, None) and len(states) == 3


def test_failed_run_is_logged(spark, tmp_path):
    tables = _tables(tmp_path)
    with pytest.raises(Exception):
        run_pipeline(spark, "r1", _articles(spark).drop("content"), None, tables, NOW)
    assert {r.status for r in spark.read.parquet(tables.runs).collect()} == {"running", "failed"}


def _content(spark, tables):
    return [
        sorted(map(str, read_table(spark, path, schema).collect())) for path, schema in (
            (tables.store, RUN_STORE), (tables.metrics, SOURCE_METRIC), (tables.telemetry, TELEMETRY))
    ]


@pytest.mark.parametrize("sink", ["write_run_telemetry", "write_run", "write_run_metrics", "append_table"])
def test_a_run_killed_after_a_sink_is_repeated(spark, tmp_path, monkeypatch, sink):
    """Whichever table was written last, the second try gives the tables of a run that never
    failed, next to those of the run before it."""
    config = EngineConfig(summary_enabled=True, token_cap=1_000)
    first = _articles(spark).filter("seq = 5")
    runs = [("r 1/a=b", first), ("r2", _articles(spark))]
    whole = _tables(tmp_path / "whole")
    for run_id, rows in runs:
        run_pipeline(spark, run_id, rows, _responses(spark), whole, NOW, config)

    tables = _tables(tmp_path / "killed")
    run_pipeline(spark, *runs[0], _responses(spark), tables, NOW, config)
    real, calls = getattr(pipeline, sink), []

    def killed(df, *args):
        real(df, *args)
        calls.append(args)
        if sink != "append_table" or len(calls) == 2:  # the log's second row says "completed"
            raise RuntimeError("killed")

    monkeypatch.setattr(pipeline, sink, killed)
    if sink == "append_table":  # the marker is there, so all is
        with pytest.raises(RuntimeError):
            run_pipeline(spark, *runs[1], _responses(spark), tables, NOW, config)
        assert len(calls) == 3
    else:
        with pytest.raises(RuntimeError):
            run_pipeline(spark, *runs[1], _responses(spark), tables, NOW, config)
    monkeypatch.undo()
    assert run_pipeline(spark, *runs[1], _responses(spark), tables, NOW, config) == 2
    assert _content(spark, tables) == _content(spark, whole)
    assert run_pipeline(spark, *runs[1], _responses(spark), tables, NOW, config) == 2
    assert _content(spark, tables) == _content(spark, whole)
    assert {r.run_id for r in read_table(spark, tables.store, RUN_STORE).collect()} == {"r 1/a=b", "r2"}


def test_budget_runs_through_both_stages(spark):
    config = EngineConfig(summary_enabled=True, token_cap=500)
    batch = deduplicated(_articles(spark), config)
    scored = score_articles(batch, _responses(spark), config).orderBy("seq").collect()
    # four classification calls use 440 tokens, one summary call is left
    assert [r.called for r in scored] == [True] * 4
    assert [r.summary_called for r in scored] == [True, False, False, False]
    assert [r.summary for r in scored] == ["A new summary.", "old", "", ""]
    tight = score_articles(batch, _responses(spark), EngineConfig(token_cap=220)).orderBy("seq").collect()
    assert [r.called for r in tight] == [True, True, False, False]
    assert [r.category for r in tight] == ["research", "research", "other", "startups"]


def test_keywords_only(spark):
    config = EngineConfig(classification_enabled=False)
    scored = score_articles(deduplicated(_articles(spark), config), None, config).orderBy("seq").collect()
    assert [r.category for r in scored] == ["startups", "startups", "other", "startups"]
    assert not any(r.called or r.summary_called for r in scored)


STREAM = "seq long, title string, url string, source string, category string, country string, quality_score double, eu_relevance double, confidence double, content string, summary string, published_date timestamp_ntz"


def _stream_files(spark, folder, parts=4):
    rows = [
        (i, f"t{i % 9}", f"u{i % 13}", f"s{i % 3}", "policy", "", 0.5 + i % 4 / 10, float(i % 6), 0.6, f"c{i % 13}", "", datetime(2024, 2, 1 + i // 10, i % 10))
        for i in range(60)
    ]
    for part in range(parts):
        chunk = rows[part * 15:(part + 1) * 15]
        spark.createDataFrame(chunk, STREAM).coalesce(1).write.parquet(f"{folder}/in/part={part}")
    return spark.createDataFrame(rows, STREAM)


def _source(spark, folder):
    return read_file_stream(spark, f"{folder}/in/part=*", STREAM, files_per_batch=1)


def test_a_stream_without_files_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_file_stream(spark, f"{tmp_path}/none.parquet", STREAM)


def test_stream_queries_read_folder_tables(spark, tmp_path):
    """A table of part files gives what the same table in one file gives."""
    table = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    table.coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    single = next((tmp_path / "one.parquet").glob("part-*"))
    (tmp_path / "single").mkdir()
    single.rename(tmp_path / "single/documents.parquet")
    table.repartition(5).write.parquet(f"{tmp_path}/parts/documents.parquet")
    for name in ("stream_dedup_url", "stream_source_metrics", "stream_ingest_store"):
        one, many = (QUERIES[name](spark, f"{tmp_path}/{d}").drop("seq") for d in ("single", "parts"))
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect())), name
        assert one.count() > 0


def test_stream_ingest_equals_batch(spark, tmp_path):
    whole = _stream_files(spark, tmp_path)
    # unique content hashes per url: (url, title) pairs repeat only together
    whole = whole.withColumn("title", F.concat(F.lit("t"), F.col("url")))
    stream = _source(spark, tmp_path).withColumn("title", F.concat(F.lit("t"), F.col("url")))
    start_ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp"), NOW).awaitTermination()
    stored = read_stream_store(spark, str(tmp_path / "store"))
    expected = store_upsert(whole, None, NOW)
    assert sorted(r.url for r in stored.collect()) == sorted(r.url for r in expected.collect())
    # a batch that is run again leaves the store as it was
    before = sorted((r.seq, r.url, r.batch_id) for r in stored.collect())
    start_ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp2"), NOW).awaitTermination()
    again = read_stream_store(spark, str(tmp_path / "store"))
    assert sorted(r.url for r in again.collect()) == sorted(u for _, u, _ in before)


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    """Also over many batches: the index keeps a bounded number of files per bucket."""
    path, buckets, merge_every = str(tmp_path / "_keys"), 32, 4
    files = []
    for batch_id in range(17):
        rows = spark.createDataFrame(
            [(k, f"u{batch_id}-{k}", f"h{batch_id}-{k}") for k in range(3)], "seq long, url string, content_hash string")
        keys = keys_of(rows, buckets)
        touched = {r.bucket for r in keys.collect()}
        known = known_in(spark, path, keys, batch_id)
        if known is not None:
            read = [f for b in touched for f in (tmp_path / "_keys").glob(f"tier=*/bucket={b}/*.parquet")]
            plan = known._jdf.queryExecution().executedPlan().toString()
            assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
            files.append(len(read) / len(touched))
            assert unknown_rows(spark, path, rows, buckets, batch_id).count() == 3
        add_keys(rows, path, buckets, batch_id)
        merge_full_tiers(spark, path, merge_every, batch_id + 1)
        assert unknown_rows(spark, path, rows, buckets, batch_id + 1).count() == 0
        assert unknown_rows(spark, path, rows, buckets, batch_id).count() == 3  # its own keys don't count
    assert max(files) <= 2 * merge_every  # two tiers


def test_a_store_without_an_index_gets_one(spark, tmp_path):
    whole = _stream_files(spark, tmp_path)
    store_path = str(tmp_path / "store")
    old = store_upsert(whole.filter("seq < 20"), None, NOW)
    old.write.parquet(f"{store_path}/batch_id=90")
    start_ingest(_source(spark, tmp_path), store_path, str(tmp_path / "cp"), NOW, 8, 2).awaitTermination()
    stored = read_stream_store(spark, store_path)
    expected = store_upsert(whole, None, NOW)
    assert sorted(r.seq for r in stored.collect()) == sorted(r.seq for r in expected.collect())


@pytest.mark.parametrize("kind", ["rss", "atom"])
def test_streamed_feed_files_equal_the_batch(spark, tmp_path, kind):
    """In batches of two files; a broken one and one that is no feed are kept apart."""
    folder = tmp_path / "landed"
    folder.mkdir()
    for k in range(5):
        if kind == "rss":
            items = "".join(f"<item><title>T{k}-{j}</title><link>http://x/{k}/{j}</link><description>d</description></item>" for j in range(4))
            text = f"<?xml version='1.0'?><rss version='2.0'><channel><title>Feed {k}</title>{items}</channel></rss>"
        else:
            items = "".join(f"<entry><title>T{k}-{j}</title><link href='http://x/{k}/{j}'/><summary>d</summary></entry>" for j in range(4))
            text = f"<feed xmlns='http://www.w3.org/2005/Atom'><title>Feed {k}</title>{items}</feed>"
        (folder / f"f{k}.xml").write_text(text)
    (folder / "broken.xml").write_text("<rss><channel><title>cut")
    (folder / "other.xml").write_text("<html><body>no feed</body></html>")
    pages = spark.createDataFrame([], "url string, page_text string, page_image string")
    config = EngineConfig(per_source_limit=3)
    score = lambda rows: quality_score(keyword_labels(rows))
    start_feed_ingest(
        read_feed_files(spark, str(folder), 2), pages, score, str(tmp_path / "store"), str(tmp_path / "rejects"),
        str(tmp_path / "cp"), NOW, kind, buckets=4, config=config,
    ).awaitTermination()
    stored = read_stream_store(spark, str(tmp_path / "store")).collect()
    assert len({r.batch_id for r in stored}) > 1
    rejects = read_rejects(spark, str(tmp_path / "rejects")).collect()
    assert sorted(r.path.rsplit("/")[-1] for r in rejects) == ["broken.xml", "other.xml"]
    whole, _ = read_feeds(spark, str(folder), kind=kind)
    batch = entry_articles(feed_entries(whole), pages, NOW, config)
    expected = {(f"http://x/{k}/{j}", f"T{k}-{j}", f"Feed {k}") for k in range(5) for j in range(3)}
    assert {(r.url, r.title, r.source) for r in stored} == expected
    assert {(r.url, r.title, r.source) for r in batch.collect() if r.url} == expected


def test_stream_metrics_equal_batch(spark, tmp_path):
    whole = _stream_files(spark, tmp_path).withColumn("ts", F.col("published_date").cast("timestamp"))
    stream = _source(spark, tmp_path).withColumn("ts", F.col("published_date").cast("timestamp"))
    start_windowed_metrics(stream, "ts", 3.0, f"{tmp_path}/m", f"{tmp_path}/c").awaitTermination()
    found = windowed_metrics(spark, f"{tmp_path}/m")
    assert found.agg(F.sum("articles")).first()[0] == 60
    expected = whole.groupBy(F.window("ts", "6 hours").alias("w"), "source").agg(
        F.count("*").alias("n"), F.round(F.avg(F.nullif("eu_relevance", F.lit(0.0))), 2).alias("eu")
    )
    key = lambda r: (r[0], r[1])
    assert sorted([(r.window_end, r.source, r.articles, r.avg_eu_relevance) for r in found.collect()], key=key) == sorted(
        [(r.w.end, r.source, r.n, r.eu) for r in expected.collect()], key=key)
    closed = {r.window_end for r in found.filter("final").collect()}
    assert max(closed) <= datetime(2024, 2, 6, 8) < max(r.window_end for r in found.collect())


def test_rolled_up_metrics_stay_the_same(spark, tmp_path):
    """Readers meet few batches' parts; a roll-up that stopped before its end counts nothing."""
    _stream_files(spark, tmp_path, parts=4)

    def run(name, **how):
        stream = _source(spark, tmp_path).withColumn("ts", F.col("published_date").cast("timestamp"))
        start_windowed_metrics(stream, "ts", 3.0, f"{tmp_path}/{name}", f"{tmp_path}/c{name}", **how).awaitTermination()
        return sorted(map(str, windowed_metrics(spark, f"{tmp_path}/{name}").collect()))

    plain, rolled = run("plain"), run("rolled", roll_every=2)
    assert plain == rolled
    folders = sorted(p.name for p in (tmp_path / "rolled").glob("batch_id=*"))
    assert folders == ["batch_id=2", "batch_id=3"] and len(list((tmp_path / "rolled/_rolled").iterdir())) == 1
    # half-written, and one whose parts were not deleted yet
    (tmp_path / "rolled/_rolled/upto=9").mkdir()
    roll_up(spark, f"{tmp_path}/rolled", 3)
    assert sorted(map(str, windowed_metrics(spark, f"{tmp_path}/rolled").collect())) == plain
    assert sorted(p.name for p in (tmp_path / "rolled").glob("batch_id=*")) == ["batch_id=3"]


def test_stream_unique_urls(spark, tmp_path):
    whole = _stream_files(spark, tmp_path)
    stream = _source(spark, tmp_path).withColumn("ts", F.col("published_date").cast("timestamp"))
    unique = drain(unique_urls(stream, "ts").select("url"), "d")
    assert sorted(r.url for r in unique.collect()) == sorted(r.url for r in whole.select("url").distinct().collect())


def test_partitioning_does_not_matter(spark):
    rows = [(i, f"t{i % 5}", f"u{i % 11}", "s") for i in range(80)]
    df = spark.createDataFrame(rows, "seq long, title string, url string, source string")
    df = df.withColumn("article_hash", article_hash(F.col("title"), F.col("url"), F.col("source")))
    results = [sorted(r.seq for r in ordered_dedup(df.repartition(n)).collect()) for n in (1, 8)]
    assert results[0] == results[1] == list(range(11))
