from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from broadsheet.config import EngineConfig
from broadsheet.operators import evaluate, metrics, publish, runs, serve, store
from broadsheet.schemas import RUN_EVENT, STORE

NOW = datetime(2024, 3, 1)
T0 = datetime(2024, 1, 1)


def _store(spark, rows):
    full = [
        (i, f"u{i}", r.get("title", f"t{i}"), r.get("source", "S"), r["category"], r.get("country"), r.get("q", 0.8),
         r.get("eu"), None, f"h{i}", None, None, None, r.get("published"), T0 + timedelta(days=i), T0)
        for i, r in enumerate(rows, 1)
    ]
    return spark.createDataFrame(full, STORE)


FOUR = [
    {"category": "startups", "eu": 7.0, "country": "France"}, {"category": "research", "eu": 1.5, "q": 0.7},
    {"category": "industry", "eu": None, "q": 0.9}, {"category": "policy", "eu": 3.0, "q": 0.75},
]


def _ids(df):
    return [r.id for r in df.collect()]


def test_published_list(spark):
    rows = _store(spark, FOUR + [{"category": "other", "eu": 9.0}, {"category": "policy", "eu": 9.0, "q": 0.39}])
    assert sorted(_ids(serve.published_view(rows))) == [1, 3, 4]
    assert sorted(_ids(serve.published_view(rows, EngineConfig(relevance_threshold=0.0)))) == [1, 2, 3, 4]
    assert serve.filtered_total(serve.published_view(rows)).first().total == 3
    assert _ids(serve.facet_filter(rows, category="startups", country="France", min_quality=0.8)) == [1]
    for bad in ({"category": "sports"}, {"country": "Atlantis"}, {"min_quality": 1.1}):
        with pytest.raises(ValueError):
            serve.facet_filter(rows, **bad)


def test_predicates_reach_the_scan(spark, tmp_path):
    _store(spark, FOUR).write.parquet(str(tmp_path / "store"))
    shown = serve.published_view(spark.read.parquet(str(tmp_path / "store")))
    plan = serve.article_page(shown)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(quality_score,0.4)" in plan and "TakeOrderedAndProject" in plan
    assert "content_hash" not in plan.split("ReadSchema")[1]


def test_pages(spark):
    rows = _store(spark, [{"category": "policy", "published": T0 + timedelta(days=d) if d else None} for d in (9, 0, 9, 30)])
    assert _ids(serve.article_page(rows)) == [4, 1, 3, 2]
    assert _ids(serve.article_page(rows, limit=2, offset=1)) == [1, 3]
    assert _ids(serve.article_page_after(rows, T0 + timedelta(days=9), 1, 2)) == [3, 2]
    assert _ids(store.store_recent(rows, 2)) == [4, 3] and len(_ids(store.store_recent(rows))) == 4
    ids = spark.createDataFrame([(2,), (4,), (9,)], "id long")
    assert sorted(_ids(serve.articles_by_id(rows, ids))) == [2, 4]
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            serve.article_page(rows, **bad)


def test_country_category_fix(spark):
    titles = {"Fund raises": "startups", "New law": "policy", "Weather": "industry", "IPO of a lawyer": "startups"}
    before = _store(spark, [{"category": "country", "title": t} for t in titles] + [{"category": "research"}])
    after = store.fix_country_categories(before)
    assert [r.category for r in after.orderBy("id").collect()] == [*titles.values(), "research"]
    counts = {r.state: r.articles for r in store.legacy_category_count(before, after).collect()}
    assert counts == {"before": 4, "after": 0}


def test_reclassification(spark):
    rows = _store(spark, FOUR)
    labels = spark.createDataFrame(
        [(1, "startups", "France", 7.4, 0.9), (2, "research", "", 1.5, 0.8), (4, "policy", None, 3.6, 0.7)],
        "id long, new_category string, new_country string, new_eu_relevance double, new_confidence double",
    )
    changes = {r.id: r for r in store.reclassify_diff(rows, labels).collect()}
    assert set(changes) == {2, 4}  # NULL -> '' is a change, 7.0 -> 7.4 is none
    assert (changes[4].old_eu_relevance, changes[4].new_eu_relevance) == (3.0, 3.6)
    assert store.apply_reclassification(rows, labels) is rows
    done = {r.id: r for r in store.apply_reclassification(rows, labels, apply=True).collect()}
    assert (done[1].eu_relevance, done[1].confidence) == (7.0, 0.9)
    assert (done[2].country, done[4].eu_relevance, done[3].confidence) == ("", 3.6, None)
    assert done[1].asDict().keys() == rows.first().asDict().keys()


def test_schema_align(spark):
    df = spark.createDataFrame([(1,)], "id int")
    aligned = store.schema_align(df, "confidence DOUBLE, ID INT")
    assert aligned.dtypes == [("id", "int"), ("confidence", "double")]
    assert store.schema_align(aligned, "confidence DOUBLE").dtypes == aligned.dtypes


def test_ids_are_consecutive(spark):
    rows = spark.createDataFrame([(s, f"u{s}") for s in (90, 5, 17, 4000, 18)], "seq long, url string")
    out = store.assign_ids(rows.repartition(3), 7).orderBy("id").collect()
    assert [(r.id, r.url) for r in out] == [(7, "u5"), (8, "u17"), (9, "u18"), (10, "u90"), (11, "u4000")]


def test_run_states(spark):
    log = [
        ("a", T0, "queued", "scrape", None, None), ("a", T0 + timedelta(minutes=1), "running", "scrape", None, None),
        ("b", T0, "running", "scrape", None, None), ("b", T0 + timedelta(minutes=2), "completed", "scrape", 5, None),
        ("c", NOW - timedelta(minutes=30), "running", "scrape", None, None),
    ]
    states = runs.run_state(spark.createDataFrame(log, RUN_EVENT))
    by_id = {r.id: r for r in states.collect()}
    assert (by_id["a"].status, by_id["b"].status, by_id["b"].result_count) == ("running", "completed", 5)
    assert by_id["b"].completed_at == T0 + timedelta(minutes=2) and by_id["a"].completed_at is None
    assert _ids(runs.stuck_runs(states, NOW, 30)) == ["a"]  # exactly 30 minutes is not stuck
    assert runs.sweep_stuck_runs(states, NOW, 30) is states
    swept = {r.id: r for r in runs.sweep_stuck_runs(states, NOW, 30, apply=True).collect()}
    assert (swept["a"].status, swept["a"].error_message, swept["a"].completed_at) == ("failed", "timeout_cleanup", NOW)
    assert swept["b"].status == "completed" and swept["c"].status == "running"
    with pytest.raises(ValueError):
        runs.run_event(spark, "x", "paused", NOW)


def test_source_metrics(spark):
    fetched = spark.createDataFrame([("A",), ("A",), ("B",), ("D",)], "source string")
    scored = spark.createDataFrame(
        [("A", "policy", 3.0, 0.5), ("A", "policy", 0.0, 0.0), ("A", "other", 5.0, 0.25), ("C", "", 0.0, 0.0)],
        "source string, category string, eu_relevance double, quality_score double",
    )
    stored = spark.createDataFrame([("A",)], "source string")
    out = {r.source: r for r in metrics.source_run_metrics(fetched, scored, stored, 3.0).collect()}
    a = out["A"]
    assert (a.articles_fetched, a.articles_stored, a.articles_passed_relevance) == (2, 1, 2)
    assert (a.avg_eu_relevance, a.avg_quality_score) == (4.0, 0.38)
    assert a.category_distribution == '{"other":1,"policy":2}'
    c = out["C"]
    assert (c.articles_fetched, c.avg_eu_relevance, c.avg_quality_score, c.category_distribution) == (0, None, None, None)
    assert set(out) == {"A", "B", "C", "D"}


def test_last_write_wins(spark):
    rows = [(i, "No title" if i % 3 == 0 else f"T{i % 4}", None, "S", f"u{i}", "policy", "", "", f"body {i}") for i in range(20)]
    df = spark.createDataFrame(
        rows, "seq long, title string, published_date timestamp_ntz, source string, url string, category string, country string, summary string, content string"
    )
    docs = {r.filename: r.body for r in publish.markdown_docs(df, NOW).collect()}
    assert docs["2024-03-01-no-title.md"].endswith("\n\nbody 18") and len(docs) == 5


def test_class_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("x", "b"), ("a", None), (None, "a"), ("a", "a")]
    df = spark.createDataFrame(pairs, "p string, t string")
    table = {r["class"]: r for r in evaluate.class_metrics(df, "p", "t", ["a", "b", "z"]).collect()}
    assert (table["a"].precision, table["a"].recall, table["a"].support) == (0.5, round(2 / 3, 3), 3)
    assert (table["b"].precision, table["b"].recall, table["b"].f1) == (1.0, round(1 / 3, 3), 0.5)
    assert (table["z"].f1, table["z"].support) == (0.0, 0)
    macro = evaluate.macro_f1(evaluate.class_metrics(df, "p", "t", ["a", "b", "z"]), 0.85).first()
    assert macro.macro_f1 == pytest.approx((table["a"].f1 + 0.5) / 2, abs=0.0006) and not macro.passed
    matrix = {r.truth: (r.a, r.b) for r in evaluate.confusion_matrix(df, "p", "t", ["a", "b"]).collect()}
    assert matrix == {"a": (2, 0), "b": (1, 1)}
    empty = df.filter("p = 'none'")
    assert evaluate.macro_f1(evaluate.class_metrics(empty, "p", "t", ["a"]), 0.85).first().macro_f1 == 0.0
    assert evaluate.agreement(empty, "p", "t").first().percent is None
    assert evaluate.agreement(df, "p", "t").first().percent == 300 // 7


def test_disagreements(spark):
    df = spark.createDataFrame([(i, f"t{i}", "a", "a" if i % 3 else "b") for i in range(60)], "seq long, title string, x string, y string")
    out = evaluate.disagreements(df, "x", "y", shown=15).collect()
    assert len(out) == 15 and {r.not_shown for r in out} == {5}


def _pool(spark, sizes, short):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            rows.append((i, f"u{i}", source, "x" * (100 if short(k) else 900)))
            i += 1
    return spark.createDataFrame(rows, "seq long, url string, source string, content string")


@pytest.mark.parametrize(
    "sizes, n, short, want_short",
    [
        ({"a": 90, "b": 30, "c": 3}, 40, lambda k: k % 2 == 0, 12),
        ({"a": 200, "b": 10}, 50, lambda k: k > 150, 15),
        ({"a": 200, "b": 10}, 50, lambda k: False, 0),
        ({f"s{i}": 1 for i in range(60)}, 20, lambda k: False, 0),
        ({"a": 5, "b": 4}, 20, lambda k: k == 0, 2),
    ],
)
def test_sample(spark, sizes, n, short, want_short):
    pool = _pool(spark, sizes, short)
    sample = evaluate.stratified_sample(pool, n)
    rows = sample.collect()
    again = evaluate.stratified_sample(pool.repartition(5), n).collect()
    assert sorted(r.seq for r in rows) == sorted(r.seq for r in again)
    assert len(rows) == min(n, sum(sizes.values())) == len({r.seq for r in rows})
    assert sum(len(r.content) < 500 for r in rows) >= want_short
    if len(sizes) <= n and want_short == 0:
        assert {r.source for r in rows} == set(sizes)
    rest = evaluate.sample_remainder(pool, sample)
    assert rest.count() == sum(sizes.values()) - len(rows)


def test_serving_predicates_reach_the_scan_of_a_written_store(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, "policy" if i % 2 else "other", 5.0, i / 10) for i in range(10)],
        "id long, category string, eu_relevance double, quality_score double",
    )
    served = serve.write_served(rows, str(tmp_path / "served"))
    shown = serve.facet_filter(serve.published_view(served), category="policy")
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "category" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(quality_score" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert sorted(r.id for r in shown.collect()) == [r.id for r in rows.collect()
                                                     if r.id % 2 and r.quality_score >= EngineConfig().list_gate]


def test_upsert_knows_articles_by_either_key(spark):
    """One hash for two urls, within a batch and against the store."""
    row = dict(source="s", category="c", country="", quality_score=0.5, eu_relevance=0.0,
               confidence=0.0, content="", summary="", published_date=None)
    keys = [(1, "http://x/a|b", "c"), (2, "http://x/a", "b|c"), (3, "http://x/a", "d"),
            (4, "http://y|z", "t"), (5, "http://w", "t")]
    schema = ("seq long, url string, title string, source string, category string, country string, "
              "quality_score double, eu_relevance double, confidence double, content string, "
              "summary string, published_date timestamp_ntz")
    articles = spark.createDataFrame(
        [dict(seq=s, url=u, title=t, **row) for s, u, t in keys], schema)
    known = store.to_store_rows(articles.limit(0).unionByName(spark.createDataFrame(
        [dict(seq=0, url="http://y", title="z|t", **row)], schema)), "2024-01-01 00:00:00")
    rows = store.store_upsert(articles, known, "2024-01-01 00:00:00")
    assert sorted(r.seq for r in rows.collect()) == [1, 3, 5]
    assert sorted(r.seq for r in store.store_upsert(articles, None, "2024-01-01 00:00:00").collect()) == [1, 3, 4, 5]


def _plain_sample(rows, n, share=0.3, short=500):
    import hashlib

    keyed = [(hashlib.md5(f"42{u}".encode()).hexdigest(), i, s, len(c or "") < short) for i, u, s, c in rows]
    by_source = {}
    for r in sorted(keyed):
        by_source.setdefault(r[2], []).append(r)
    picked = []
    for source, own in by_source.items():
        if source is not None:
            picked += own[:max(1, round(n * len(own) / len(rows)))]
    taken = sorted(picked)[:n]
    taken += sorted(set(keyed) - set(taken))[:n - len(taken)]
    out = sorted(set(keyed) - set(taken))
    short_out, long_in = [r for r in out if r[3]], sorted(r for r in taken if not r[3])
    swaps = max(0, min(int(n * share) - sum(r[3] for r in taken), len(short_out), len(long_in)))
    kept = [r for r in taken if r[3]] + long_in[:len(long_in) - swaps] + short_out[:swaps]
    return sorted(r[1] for r in kept)


@pytest.mark.parametrize("n", [1, 7, 60, 299, 300, 500])
def test_sample_equals_a_plain_one(spark, n):
    import random

    r = random.Random(n)
    rows = [(i, f"u{i % 150}", r.choice(["a"] * 12 + ["b", "c", "d", None]), "x" * r.choice([10, 600, 700, 800]))
            for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, url string, source string, content string")
    found = sorted(x.seq for x in evaluate.stratified_sample(df, n).collect())
    assert found == _plain_sample(rows, n)


def test_a_cut_by_key_ranks_one_bin_only(spark):
    """No sort of everything, no window over all rows."""
    keys = spark.range(5000).selectExpr("id AS seq", "md5(cast(id AS string)) AS _key")
    out = evaluate.smallest(keys, "seq", 1234)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan and "Sort [" not in plan
    expected = sorted((r._key, r.seq) for r in keys.collect())[:1234]
    assert sorted((r._key, r.seq) for r in out.collect()) == expected


def test_updates_leave_untouched_files_alone(spark, tmp_path):
    """Only partitions with a changed row are written anew; running it again changes nothing."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "store")
    rows = _store(spark, [
        {"category": "country", "title": "AI startup"}, {"category": "policy", "source": "https://sifted.eu"},
        {"category": "policy"}, {"category": "research", "eu": 1.0}, {"category": "industry"},
    ]).withColumn("run_id", F.concat(F.lit("r"), F.col("id")))
    rows.write.partitionBy("run_id").parquet(path)

    def files():
        return {f.parent.name + "/" + f.name for f in (tmp_path / "store").glob("run_id=*/part-*")}

    labels = spark.createDataFrame(
        [(4, "startups", "France", 9.0, 0.9), (5, "industry", None, 0.0, None)],
        "id long, new_category string, new_country string, new_eu_relevance double, new_confidence double")
    before = files()
    for touched, update in (
        (["r1"], store.fix_country_categories), (["r2"], store.normalize_store_sources),
        (["r4"], lambda s: store.apply_reclassification(s, labels, apply=True)),
    ):
        assert store.update_store(spark, path, update) == touched
        after = files()
        assert {f.split("/")[0] for f in before ^ after} == {f"run_id={t}" for t in touched}
        assert store.update_store(spark, path, update) == [] and files() == after
        before = after
    found = {r.id: r for r in spark.read.parquet(path).collect()}
    assert len(found) == 5 and found[1].category != "country" and found[2].source == "Sifted"
    assert (found[4].category, found[4].country, found[4].eu_relevance, found[4].confidence) == ("startups", "France", 9.0, 0.9)


def test_a_deep_page_reads_one_range(spark, tmp_path):
    rows = _store(spark, [{"category": "policy", "published": T0 + timedelta(hours=k * 7 % 400)} for k in range(1000)])
    path = str(tmp_path / "index")
    serve.write_page_index(rows, path, rows_per_range=100)
    for limit, offset in ((50, 0), (10, 95), (100, 333), (7, 990), (50, 999), (5, 5000)):
        page = serve.indexed_page(spark, path, limit, offset)
        assert _ids(page) == _ids(serve.article_page(rows, limit, offset)), (limit, offset)
        plan = page._jdf.queryExecution().executedPlan().toString()
        if offset < 1000:
            asked = plan.split("PartitionFilters: [")[1].split("]")[0]
            assert "place#" in asked and asked.count(",") <= 3  # one range, or two neighbours
    serve.write_page_index(rows.limit(0), path)
    assert serve.indexed_page(spark, path).collect() == []
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}):
        with pytest.raises(ValueError):
            serve.indexed_page(spark, path, **bad)
