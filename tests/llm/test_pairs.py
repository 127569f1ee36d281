"""N-gram Jaccard join, repeated passages and benchmark leaks against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from broadsheet.llm import jaccard, leaks, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_links int, keys string"


def frame(spark, rows):
    """Documents with two more columns, named like ones the operators make."""
    return spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS)


def near_copies(seed: int, n: int, vocabulary: int = 60) -> list[tuple[int, str]]:
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [r.choice(words) for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.5:
            text = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                if text:
                    text[r.randrange(len(text))] = r.choice(words).upper()
        else:
            text = [r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 6, 30, 80]))]
            if kind > 0.8:
                text[len(text) // 2:len(text) // 2] = passage
        texts.append(" ".join(text))
    return list(enumerate(texts))


def brute_links(rows, size, percent):
    sets = {}
    for i, text in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = ({tuple(words[k:k + size]) for k in range(len(words) - size + 1)}
                   or ({tuple(words)} if words else set()))
    ids = sorted(sets)
    links = {i: {j for j in ids if i != j and sets[i] and sets[j]
                 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in ids}
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([root[i], *(root[j] for j in links[i])])
            if low < root[i]:
                root[i], changed = low, True
    return {i: (len(sets[i]), len(links[i]), root[i]) for i in ids}


@pytest.mark.parametrize("seed,block,per_slice,fan", [(1, 1_000_000, 800_000, 256), (2, 150, 200, 2)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, seed, block, per_slice, fan):
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", block)  # small blocks split groups
    monkeypatch.setattr(jaccard, "KEYS_PER_SLICE", per_slice)
    monkeypatch.setattr(jaccard, "FAN", fan)  # slices in two steps
    rows = near_copies(seed, 160)
    found = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in
             jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert found == brute_links(rows, 4, 85)


def test_trie_finds_all_links_of_its_sets_and_of_probes():
    r = np.random.default_rng(3)
    core = r.integers(0, 2**63, 40, dtype=np.uint64)
    sets = []
    for _ in range(60):
        own = r.integers(0, 2**63, int(r.integers(0, 12)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([core[r.random(40) < 0.9], own])))
    trie = jaccard.Trie(sets[:35], sets[35:], 80)
    found = {k: set(x.tolist()) for k, x in trie.join()}
    for k in range(35):
        expected = {j for j in range(60) if j != k and 100 * len(np.intersect1d(sets[k], sets[j]))
                    >= 80 * len(np.union1d(sets[k], sets[j]))}
        assert found.get(k, set()) == expected  # pruned sets have no links


def test_jaccard_edge_cases(spark):
    long = " ".join(f"x{k}" for k in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, long),
            (7, long + " end"), (7, "another text with this id"), (None, "one two"), (8, long), (8, long)]
    found = sorted(
        (r.doc_id or 0, r.n_shingles, r.n_links, r.component_id)
        for r in jaccard.jaccard_components(frame(spark, rows)).collect()
    )
    assert found == sorted([
        (1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 3), (4, 1, 2, 4), (5, 1, 2, 4), (6, 2997, 3, 6),
        (7, 2998, 3, 6), (7, 2, 0, 7), (0, 1, 2, 4), (8, 2997, 3, 6), (8, 2997, 3, 6),
    ])
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []
    kept = jaccard.one_of_each(frame(spark, [r for r in rows if r[0] != 7]))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6]
    assert kept.columns == ["doc_id", "text", "n_links", "keys"]
    kept = jaccard.one_of_each(frame(spark, [*rows, (6, long)]))
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept.collect()) == [
        (0, "one two"), (1, ""), (2, ""), (3, " \t\n"), (4, "one two"), (6, "x0 x1 x"), (7, "another")]


def test_links_over_rows_without_an_id(spark):
    """Two texts that only meet over a third one, which has no id."""
    words = [f"x{k}" for k in range(60)]
    rows = [(1, " ".join(words[:57])), (2, " ".join(words[3:])), (None, " ".join(words)),
            (None, "a text of its own here")]
    for parts in (1, 4):
        found = sorted(
            (r.doc_id or 0, r.n_links, r.component_id)
            for r in jaccard.jaccard_components(
                frame(spark, rows).repartition(parts), percent=94).collect())
        assert found == [(0, 0, None), (0, 2, 1), (1, 1, 1), (2, 1, 1)]


@pytest.mark.parametrize("parts", [1, 8])
def test_texts_that_share_an_id_are_judged_apart(spark, parts):
    long = " ".join(f"y{k}" for k in range(100))
    rows = [(7, long), (7, "quite another text under it"), (7, long + " z"), (8, long + " w z"),
            (8, "a text that only eight has"), (9, "quite another text under it")]
    kept = jaccard.one_of_each(frame(spark, rows).repartition(parts)).collect()
    assert len(kept) == 3 and {r.text for r in kept} >= {rows[1][1], rows[4][1]}
    assert {r.doc_id for r in kept if r.text.startswith("y0")} == {7}


def brute_repeats(rows, size):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            if window in seen:
                gone[k:k + size] = [True] * size
            seen.add(window)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("seed,vocabulary,fan", [(5, 400, 256), (6, 3, 256), (7, 1, 256), (5, 400, 3)])
def test_removed_passages_equal_brute_force(spark, monkeypatch, seed, vocabulary, fan):
    monkeypatch.setattr(repeats, "KEYS_PER_SLICE", 50)  # many slices
    monkeypatch.setattr(repeats, "FAN", fan)
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(r.randint(0, 4)):
            text += r.choice(passages) if r.random() < 0.5 else [
                r.choice(words) for _ in range(r.randint(0, 40))]
            if r.random() < 0.2:
                text += [r.choice(words)] * r.randint(1, 50)
        rows.append((i, "\n".join(text)))
    rows.append((1000, None))
    rows.append((None, rows[10][1]))
    found = repeats.remove_repeats(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(brute_repeats(rows, 20), key=str)


def test_repeats_edge_cases(spark):
    text = " ".join(f"x{k}" for k in range(25))
    same = [(1, text), (1, text), (2, ""), (3, "  ")]
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in
                   repeats.remove_repeats(frame(spark, same)).collect())
    assert found == [(1, 25, 0, text), (1, 25, 0, text), (2, 0, 0, ""), (3, 0, 0, "")]
    assert repeats.remove_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("parts", [1, 8])
def test_equal_places_under_one_id_fare_alike_in_any_partition(spark, parts):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(5, passage + " one"), (5, passage + " two"), (1, "z " + passage),
            (None, "n " + " ".join(f"q{k}" for k in range(30))),
            (2, " ".join(f"q{k}" for k in range(30)))]
    found = sorted((r.doc_id or 0, r.n_removed, r.kept) for r in repeats.remove_repeats(
        frame(spark, rows).repartition(parts)).collect())
    assert [x[:2] for x in found] == [(0, 0), (1, 0), (2, 30), (5, 25), (5, 25)]
    assert [x[2] for x in found[3:]] == ["one", "two"]


def test_an_exchange_makes_no_row_per_piece_and_slice(spark):
    """The first step's rows grow with the pieces, the second's with a part of the slices' square;
    a row per piece and slice would be 2,560 and 40,960."""
    import pyarrow as pa

    from broadsheet.llm import common

    fan = 8

    def exchanged(pieces, slices):
        def send(batches):
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    value = np.arange(k * 64, k * 64 + 64)
                    home = common.homes_of(value, slices)
                    yield from common.addressed(
                        home, slices, {"v": (value, pa.int64())}, k, fan).combine_chunks().to_batches()

        def gather(table):
            value = common.flat_column(table, "v")
            home = int(table.column("slice")[0].as_py())
            assert (common.homes_of(value, slices) == home).all()
            return pa.table({"home": [home], "rows": [table.num_rows], "total": [int(value.sum())]})

        sent = spark.range(pieces).mapInArrow(send, common.address_ddl("v array<long>"))
        found = common.exchange(sent, slices, gather, "home long, rows long, total long", fan).collect()
        assert len({r.home for r in found}) == len(found)
        assert sum(r.total for r in found) == sum(range(pieces * 64))
        return sent.count(), sum(r.rows for r in found)

    first, second = exchanged(40, 64), exchanged(160, 256)
    assert first[0] <= 40 * fan and second[0] <= 160 * fan
    assert first[1] <= 64 and second[1] <= 256 * 4


def brute_distance(item, words):
    row = [0] * (len(words) + 1)
    for k, w in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_leaks_reach_the_target_recall_of_brute_force(spark):
    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    items = [(k, [r.choice(words) for _ in range(r.randint(12, 60))]) for k in range(40)]
    rows = []
    for i in range(150):
        text = [r.choice(words) for _ in range(r.randint(0, 150))]
        if i % 2:
            item = list(r.choice(items)[1])
            for _ in range(r.randint(0, len(item) // 5)):
                k = r.randrange(len(item))
                act = r.random()
                if act < 0.4:
                    item[k] = r.choice(words)
                elif act < 0.7 and len(item) > 1:
                    del item[k]
                else:
                    item.insert(k, r.choice(words))
            at = r.randint(0, len(text))
            text[at:at] = item
        rows.append((i, ", ".join(text).upper() if i % 3 else " ".join(text)))
    expected = {(i, k) for i, text in rows for k, item in items
                if brute_distance(item, re.findall(r"\w+", text.lower())) <= len(item) // 5}
    benchmark = spark.createDataFrame(
        [(k, " ".join(w)) for k, w in items] + [(None, "x y z"), (90, None), (91, " . ")],
        "item_id long, text string",
    )
    found = {(x.doc_id, x.item_id) for x in leaks.find_leaks(frame(spark, rows), benchmark).collect()}
    assert found <= expected and len(found) >= 0.95 * len(expected) > 50
    clean = leaks.without_leaks(frame(spark, rows), benchmark)
    assert {x.doc_id for x in clean.collect()} == {i for i, _ in rows} - {i for i, _ in found}


def test_leaks_edge_cases(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    none = benchmark.limit(0)
    rows = [(1, None), (2, ""), (3, "A b, c d e f g h!"), (3, "A b, c d e f g h!"),
            (None, "a b c d e f g h"), (4, "z " * 50_000 + "a b c d e f g x")]
    found = leaks.find_leaks(frame(spark, rows), benchmark).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} == {(3, 1, 0), (None, 1, 0), (4, 1, 1)}
    assert leaks.find_leaks(frame(spark, rows), none).collect() == []
    assert leaks.find_leaks(frame(spark, []), benchmark).collect() == []
    assert leaks.without_leaks(frame(spark, rows), none).count() == len(rows)


def test_long_items_with_edits_in_blocks_are_found(spark):
    r = random.Random(12)
    words = [f"w{k}" for k in range(2_000)]
    items = [[r.choice(words) for _ in range(n)] for n in (100, 150, 200, 250, 300) for _ in range(8)]
    rows = []
    for k, item in enumerate(items):
        n, edits = len(item), len(item) // 5
        for j, starts in enumerate(([0, n // 2], [0], [n - edits])):
            text = list(item)
            for at in starts:
                for p in range(at, at + edits // len(starts)):
                    text[p] = r.choice(words)
            rows.append((10 * k + j, " ".join(words[:20] + text + words[20:40])))
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)],
                                      "item_id long, text string")
    expected = {(i, k) for i, text in rows for k, item in [(i // 10, items[i // 10])]
                if brute_distance(item, text.split()) <= len(item) // 5}
    assert len(expected) == len(rows)
    found = {(x.doc_id, x.item_id) for x in leaks.find_leaks(frame(spark, rows), benchmark).collect()}
    assert found <= expected and len(found) >= 0.98 * len(expected)


def test_exact_copies_of_very_short_items_are_found(spark):
    items = [(10 * n + j, " ".join(f"s{n}x{j}y{k}" for k in range(n))) for n in range(1, 10) for j in range(4)]
    rows = [(i, f"before it {text} after it all") for i, text in items]
    # one edit is allowed from five words on
    rows += [(1_000 + i, " ".join(["new", *text.split()[1:], "end"])) for i, text in items]
    found = leaks.find_leaks(
        frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(x.doc_id, x.item_id, x.distance) for x in found} == (
        {(i, i, 0) for i, _ in items} | {(1_000 + i, i, 1) for i, _ in items if i >= 50}
    )
