from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from broadsheet.config import EngineConfig
from broadsheet.operators.budget import budget_gate
from broadsheet.operators.dedup import new_rows, not_in_store, ordered_dedup
from pyspark.sql import functions as F

RELAXED = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
# rounds to the end, and no rounds at all
ROUNDS, WALK = EngineConfig(walk_rows=0), EngineConfig()


def _walk(rows):
    """The plain loop: keep a row if neither key belongs to a kept row."""
    first, second, kept = set(), set(), []
    for seq, a, b in sorted(rows):
        if a not in first and b not in second:
            first.add(a)
            second.add(b)
            kept.append(seq)
    return kept


def _dedup(spark, rows, config=ROUNDS):
    df = spark.createDataFrame(rows, "seq long, url string, article_hash string")
    return sorted(r.seq for r in ordered_dedup(df, config=config).collect())


def test_chain(spark):
    rows = [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h2"), (4, "", "h3"), (5, "", "h4")]
    assert _dedup(spark, rows) == [1, 3, 4]


@RELAXED
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=40))
def test_equals_the_sequential_walk(spark, keys):
    rows = [(i, f"u{a}", f"h{b}") for i, (a, b) in enumerate(keys)]
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    assert _dedup(spark, shuffled) == _walk(rows)


def test_hot_url(spark):
    """A third of the rows without a link, each with its own hash."""
    rows = [(i, "" if i % 3 == 0 else f"u{i % 40}", f"h{i % 55}") for i in range(300)]
    assert _dedup(spark, rows) == _walk(rows)
    assert _dedup(spark, rows, EngineConfig()) == _walk(rows)


def test_unique_hashes_take_one_pass(spark):
    rows = [(i, f"u{i % 7}", f"h{i % 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "seq long, url string, article_hash string")
    out = ordered_dedup(df)
    assert sorted(r.seq for r in out.collect()) == list(range(7))
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@RELAXED
@given(st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "x", "y", "z"])),
                min_size=1, max_size=25))
def test_null_is_a_key_like_any_other_on_both_paths(spark, keys):
    rows = [(i, a, b) for i, (a, b) in enumerate(keys)]
    assert _dedup(spark, rows, ROUNDS) == _dedup(spark, rows, WALK) == _walk(rows)


def test_a_null_key_is_kept_once_whatever_else_clashes(spark):
    rows = [(0, None, "h0"), (1, None, "h1"), (2, "a", "h2")]
    assert _dedup(spark, rows) == [0, 2]
    assert _dedup(spark, [*rows, (3, "b", "h2"), (4, None, None)]) == [0, 2]


def test_long_chain(spark):
    rows = []
    for k in range(500):
        rows += [(2 * k, f"u{k}", f"h{k}"), (2 * k + 1, f"u{k + 1}", f"h{k}")]
    assert _dedup(spark, rows, WALK) == _walk(rows)
    assert _dedup(spark, rows[:24], ROUNDS) == _walk(rows[:24])


def test_a_chain_takes_jobs_by_its_logarithm(spark, monkeypatch):
    """Four times the chain adds a few rounds, not four times as many."""
    from broadsheet.operators import components as C

    def rounds(n):
        seen = []
        real = C.materialize
        monkeypatch.setattr(C, "materialize", lambda df, label: seen.append(label) or real(df, label))
        keys = spark.range(2 * n).selectExpr(
            "id AS seq", "concat('u', (id + 1) div 2) AS url", "concat('h', id div 2) AS article_hash")
        kept = ordered_dedup(keys, config=ROUNDS)
        assert kept.count() == n and kept.filter("seq % 2 = 1").count() == 0
        monkeypatch.setattr(C, "materialize", real)
        return len(seen)

    assert rounds(2000) <= rounds(500) + 8


def test_many_components_at_once(spark):
    rows, seq = [], 0
    for k in range(60):
        for j in range(k % 7 + 2):
            rows += [(seq, f"u{k}-{j}", f"h{k}-{j // 2}"), (seq + 1, f"u{k}-{j}", f"h{k}-{j // 2 + 1}")]
            seq += 2
    random.Random(1).shuffle(rows)
    rows = [(i, a, b) for i, (_, a, b) in enumerate(rows)]
    assert _dedup(spark, rows, ROUNDS) == _walk(rows)


def test_store_conflicts_on_either_key(spark):
    schema = "seq long, url string, content_hash string"
    store = spark.createDataFrame([(0, "u1", "h1"), (0, "u2", "h2")], schema)
    batch = spark.createDataFrame(
        [(1, "u1", "x"), (2, "y", "h2"), (3, "u3", "h3"), (4, "u3", "h4"), (5, "u5", "h3"), (6, "u6", "h6")], schema
    )
    free = not_in_store(batch, store, config=ROUNDS)
    assert sorted(r.seq for r in free.collect()) == [3, 4, 5, 6]
    plan = not_in_store(batch, store)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r.seq for r in new_rows(batch, store).collect()) == [3, 6]
    assert sorted(r.seq for r in new_rows(batch, None).collect()) == [1, 2, 3, 6]


def _gate(spark, tokens, cap, partitions=1):
    rows = [("r", i, t) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "run string, seq long, tokens long").repartition(partitions)
    out = budget_gate(df, cap, F.col("tokens"), ["run"], ["seq"]).orderBy("seq").collect()
    return [(r.tokens_before, r.allowed, r.tokens_left) for r in out]


def _gate_loop(tokens, cap):
    used, out = 0, []
    for t in tokens:
        out.append((used, cap == 0 or used < cap, -1 if cap == 0 else max(0, cap - used)))
        used += t
    return out


@RELAXED
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(0, 60))
def test_budget_equals_the_running_total(spark, tokens, cap):
    assert _gate(spark, tokens, cap, 5) == _gate_loop(tokens, cap)


def test_budget_over_sparse_orders_and_null_groups(spark):
    rows = [(g, (i * 0x9E3779B97F4A7C15) % 2**62, i % 7) for g in ("a", None, "b") for i in range(60)]
    df = spark.createDataFrame(rows, "run string, seq long, tokens long")
    out = {(r.run, r.seq): r.tokens_before for r in budget_gate(df, 0, F.col("tokens"), ["run"], ["seq"]).collect()}
    for g in ("a", None, "b"):
        used = 0
        for _, seq, tokens in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert out[(g, seq)] == used
            used += tokens


def test_budget_edges(spark):
    assert [a for _, a, _ in _gate(spark, [5, 5, 1], 10)] == [True, True, False]
    assert [a for _, a, _ in _gate(spark, [5, 5, 1], 0)] == [True, True, True]
