"""Fingerprints, urls, toxicity, archives, languages, token ids, mixing and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from broadsheet.llm import imatch, language, mixing, tokens, toxicity, urls, warc
from broadsheet.llm.oracle import ORACLE
from broadsheet.llm.queries import QUERIES
from checks.compare import compare, duck

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "very long " * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_duckdb(spark, name):
    assert compare(spark, duck(SMALL), SMALL, name, QUERIES[name], ORACLE[name]) is None


# --- I-Match ---------------------------------------------------------------------------------

def test_imatch_equals_a_plain_computation(spark):
    r = random.Random(4)
    words = [f"term{k}" for k in range(200)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (None, "a null id"), (103, LONG), (103, LONG)]
    found = imatch.compare_edited(docs(spark, rows)).collect()
    ordered = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0))
    texts = [t or "" for _, t in ordered]
    edited = {}
    for k, (i, _) in enumerate(ordered):
        own, following = texts[k], texts[(k + 1) % len(texts)]
        cut = len(own) // 4
        edited[i] = own[:len(own) - cut] + following[:cut]
    assert len(found) == len(rows)
    by_text: dict = {}
    for x in found:
        assert x.edited_sha256 == hashlib.sha256(edited[x.doc_id].encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
        by_text.setdefault(dict(ordered)[x.doc_id] or "", set()).add(x.fingerprint)
        if edited[x.doc_id] == (dict(ordered)[x.doc_id] or ""):
            assert x.near_edited == 1 and x.fingerprint == x.edited_fingerprint
    assert all(len(prints) == 1 for prints in by_text.values())
    assert imatch.compare_edited(docs(spark, [])).collect() == []


def test_a_fingerprint_follows_the_terms_in_the_band_alone(spark):
    texts = [(k, f"common w{k % 7} w{k % 5} only{k}") for k in range(40)]
    lexicon = imatch.learn_lexicon(docs(spark, texts), 0.1, 0.5)
    rows = spark.createDataFrame(
        [(1, ["w1 w2 common", "COMMON w2, w1 w1!", "w1 w2 w3 unseen", ""])], "k long, sides array<string>"
    )
    marks = {r.side: r.marks for r in imatch.fingerprints(rows, lexicon, ["k"]).collect()}
    assert marks[0] == marks[1] != marks[2] and marks[3] == []


def test_near_copies_of_a_large_group_are_alike(spark):
    r = random.Random(5)
    group = [f"shared{k}" for k in range(80)]
    rows = []
    for i in range(40):
        text = list(group)
        text[i + 10] = f"edit{i}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(f"own{r.randrange(3_000)}" for _ in range(80))) for i in range(80)]
    found = {x.doc_id: x for x in imatch.compare_edited(docs(spark, rows)).collect()}
    assert all(found[i].near_next > 0.5 for i in range(39))
    assert all(found[i].near_next < 0.3 for i in range(100, 179))


# --- urls -------------------------------------------------------------------------------------

def test_urls_take_the_longest_rule_and_else_their_template(spark):
    rows = [
        (1, "http://a.Example.COM/en/1", "example.com/en/", "block"),
        (2, "http://www.example.com/en/1?x", "www.example.com/en/", "allow"),
        (3, "https://other.com/en/1", "com/", "allow"),
        (4, "x://a.net/es/9#y", "net/es/", "block"),
        (5, "x://notnet/es/9", None, None), (6, None, None, "allow"), (7, "no separator", None, "allow"),
        (8, "http://a.net/es", None, None), (9, "http://", None, None),
    ] + [(100 + k, f"http://b.net/fr/{k}", "net/fr/", "block") for k in range(30)] \
      + [(200 + k, f"http://c.org/fr/{k}", None, "block") for k in range(30)] \
      + [(300 + k, f"http://c.com/de/{k}", "com/", "allow") for k in range(30)] \
      + [(400 + k, f"http://c.org/de/{k}", None, "allow") for k in range(3)]
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u, _, _ in rows],
                                  "page_id long, url string, host string, template string")
    found = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for i, _, rule, verdict in rows:
        assert found[i].rule == rule
        assert verdict is None or found[i].verdict == verdict, found[i]
    assert (found[6].host, found[6].path) == ("", "") == (found[7].host, found[7].path)
    assert found[5].host == "notnet" and found[1].host == "a.example.com"
    assert urls.judge_urls(pages.limit(0)).collect() == []
    assert {(r.rule, r.verdict) for r in urls.judge_urls(pages, []).collect()} == {(None, "allow")}


def test_a_place_with_many_rare_segments_is_a_wildcard(spark):
    rows = [("h", f"/user/name{chr(97 + k)}x/post", None) for k in range(12)]
    rows += [("h", "/about/us", None)] * 12
    found = urls.template_purity(spark.createDataFrame(rows, "host string, path string, label int"))
    assert {r.template for r in found.collect()} == {"/user/*/post", "/about/us"}


def test_variable_segments_below_variable_segments(spark):
    def name(k):
        return "".join(chr(97 + int(c)) for c in f"{k:03d}")

    rows = [("h", f"/u/u{name(k)}/p/s{name(7 * k)}", 1 if k < 10 else None) for k in range(60)]
    rows += [("h", "/about/us", 0)] * 40
    found = urls.template_purity(spark.createDataFrame(rows, "host string, path string, label int"))
    purity = {r.template: r.purity for r in found.collect()}
    assert set(purity) == {"/u/*/p/*", "/about/us"}
    assert purity["/u/*/p/*"] > 0.6 > 0.2 > purity["/about/us"]


def test_branches_that_look_alike_merge_at_each_level(spark):
    rows = [("h", f"/docs/{v}/{leaf}", label) for v in ("old", "new") for leaf in ("guide", "api")
            for label in ([1] * 5 if leaf == "guide" else [0] * 5)]
    rows += [("h", f"/shop/{leaf}", 0) for leaf in ("cart", "pay", "list")] * 5
    found = urls.template_purity(spark.createDataFrame(rows, "host string, path string, label int"))
    assert {r.template for r in found.collect()} == {
        "/docs/new/api", "/docs/new/guide", "/shop/cart"}


# --- toxicity ---------------------------------------------------------------------------------

def test_folding():
    assert toxicity.fold("1D10T ídïot\u200b іdіоt $cum!") == " idiot idiot idiot scum "
    assert toxicity.fold(None) == toxicity.fold("") == "  "


def test_toxicity_learns_words_and_their_exceptions(spark):
    r = random.Random(9)
    plain = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]

    def text(extra):
        body = [r.choice(plain) for _ in range(30)]
        for e in extra:
            body.insert(r.randrange(len(body)), e)
        return " ".join(body)

    rows = [(i, text(["nastyword"] if i % 4 == 0 else ["not nastyword"] if i % 13 == 0 else [])) for i in range(400)]
    labels = spark.createDataFrame(
        [(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs(spark, rows), labels)
    assert any("nastyword".startswith(e) for e in model.lexicon) and len(model.lexicon) < 5
    tests = [(1, text(["n4stywоrds"])), (2, text([])), (3, text(["not nastyword"])), (4, None), (5, ""),
             (6, LONG), (None, text(["NASTYWORD"]))]
    scores = {x.doc_id: x.s for x in docs(spark, tests).select(
        "doc_id", toxicity.toxicity(F.col("text"), model).alias("s")).collect()}
    assert scores[1] >= 0.7 and scores[None] >= 0.7
    assert max(scores[k] for k in (2, 3, 4, 5, 6)) < 0.7
    empty = toxicity.learn(docs(spark, []), labels.limit(0))
    assert empty.lexicon == {}


# --- archives ---------------------------------------------------------------------------------

def test_archives_are_equal_whatever_the_partitioning_and_read_back(spark, tmp_path):
    r = random.Random(2)
    big = "b" * 1500
    rows = [(i, f"http://h/{i}\r\nx: é%41", "".join(chr(r.randint(32, 255)) for _ in range(r.randint(0, 3000))))
            for i in range(120)]
    rows += [(200, None, big), (201, "u", big), (150, "u", big), (300, "u", None), (301, "u", ""),
             (None, "u", "null id"), (400, "u", "twice"), (400, "u", "twice"), (7, "again", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit(1))
    files = []
    for n, parts in enumerate((1, 7)):
        folder = f"{tmp_path}/w{n}"
        manifest = warc.write_warc(pages.repartition(parts), folder, file_bytes=20_000, shard_bytes=60_000)
        names = sorted(x.file for x in manifest.collect())
        assert len(names) > 3 and not list(Path(folder).glob("_tmp*"))
        files.append({f: Path(folder, f).read_bytes() for f in names})
    assert files[0] == files[1]
    found = warc.read_warc(spark, folder, payload=True).collect()
    assert len(found) == len(rows)
    for x in found:
        kind = "revisit" if x.page_id in (150, 200) else "response"
        assert (x.record_type, x.refers_to) == (kind, 201 if kind == "revisit" else None)
    expected = sorted((i or -1, u or "", (h or "").encode()) for i, u, h in rows if i not in (150, 200))
    assert sorted((x.page_id or -1, x.url or "", bytes(x.payload)) for x in found
                  if x.record_type == "response") == expected
    assert all(x.payload_digest == hashlib.sha1(big.encode()).hexdigest() and x.payload_bytes == 1500
               for x in found if x.page_id in (150, 200, 201))
    broken = gzip.decompress(files[0][names[0]])[:-10].replace(b"HTTP/1.1 200", b"HTTP/1.1 201", 1)
    with pytest.raises(ValueError):
        warc.decode_record(broken)
    nothing = f"{tmp_path}/none"
    warc.write_warc(pages.limit(0), nothing)
    assert warc.read_warc(spark, nothing).collect() == []


# --- languages --------------------------------------------------------------------------------

def test_languages_by_out_of_place_distance(spark):
    r = random.Random(1)

    def text(letters):
        return " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(40))

    rows = [(i, text("abcde" if i % 2 else "defgh"), "xx" if i % 2 else "yy", None, None) for i in range(60)]
    rows += [(90, None, "xx", None, None), (91, "abc abc", None, None, None)]
    profiles = language.learn_profiles(spark.createDataFrame(rows, DOC))
    assert set(profiles) == {"xx", "yy"}
    tests = [(1, text("abcde")), (2, text("DEFGH")), (3, None), (4, ""), (5, "123 !?"), (6, LONG), (None, "abcab")]
    found = {x.doc_id: x.p for x in docs(spark, tests).select(
        "doc_id", language.language(F.col("text"), profiles).alias("p")).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 4, 5)] == ["xx", "yy", "und", "und", "und"]
    assert found[3].score == 0 and 0 < found[1].score <= 1 and found[6].lang_pred in profiles
    assert language.learn_profiles(docs(spark, [])) == {}
    none = docs(spark, tests).select(language.language(F.col("text"), {}).alias("p")).collect()
    assert {x.p.lang_pred for x in none} == {"und"}


def test_ngram_counts_equal_a_plain_count():
    texts = ["Ab ab", "", "x", "été 12 ab"]
    found: dict = {}
    for owner, gram, count in zip(*language.grams(texts)):
        size = int(gram) >> 48
        chars = [(int(gram) >> 16 * k) & 0xFFFF for k in reversed(range(size))]
        found[(int(owner), "".join(chr(c) if c else "_" for c in chars))] = int(count)
    expected: dict = {}
    for k, t in enumerate(texts):
        for word in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            padded = f"_{word}_"
            for n in (1, 2, 3):
                for a in range(len(padded) - n + 1):
                    gram = padded[a:a + n]
                    if gram != "_":
                        expected[(k, gram)] = expected.get((k, gram), 0) + 1
    assert found == expected


# --- token ids --------------------------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_token_files_give_back_the_library_s_ids(spark, tmp_path):
    r = random.Random(8)
    odd = ["", "a  b", "a \nb ", " lead", "x\n\n y  ", "\t z <|endoftext|> q", "\0 x \0a", "é\u00a0 \u3000ß",
           "it's we'll 12 3", LONG]
    rows = [(i, " ".join(r.choice(["the", "of", "Straße,", "ñandú", "x1", "\n"]) for _ in range(r.randint(0, 300))))
            for i in range(0, 200, 2)] + [(1000 + k, t) for k, t in enumerate(odd)]
    rows += [(None, "null id"), (5000, None), (6, "same id"), (6, "same id")]
    folder = f"{tmp_path}/t"
    manifest = tokens.write_tokens(docs(spark, rows), folder, PATH, shard_bytes=10_000, section_ids=2_000)
    assert manifest.count() > 4 and manifest.agg(F.sum("symbols") < F.sum("ids")).first()[0]
    library = Tokenizer.from_file(PATH)
    start, expected, last = 0, [], {}
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        last[i] = ids
    found = [tuple(x) for x in tokens.read_digests(spark, folder).collect()]
    key = lambda x: str((x[0], x[2], x[3]))  # noqa: E731  rows of one id may stand in either order
    assert sorted((x[0], 0, *x[2:]) for x in found if x[0] == 6) == sorted(
        (x[0], 0, *x[2:]) for x in expected if x[0] == 6)
    assert sorted((x for x in found if x[0] != 6), key=key) == sorted(
        (x for x in expected if x[0] != 6), key=key)
    place = manifest.orderBy("shard", "section").collect()[-1]
    whole = tokens.read_document(spark, folder, place.shard, place.section, place.documents - 1)
    assert whole.tolist() == last[5000]
    section = next(tokens.Section(Path(folder, m.file).read_bytes()[m.offset:m.offset + m.bytes])
                   for m in manifest.collect() if m.rules and m.documents > 1)
    for k in range(len(section.lengths)):
        every = section.document(k)
        for a, b in ((0, 1), (3, 17), (5, 5), (1, 10**6)):
            assert section.document(k, a, b).tolist() == every[a:b].tolist()
    tokens.write_tokens(docs(spark, []), f"{tmp_path}/e", PATH)
    assert tokens.read_digests(spark, f"{tmp_path}/e").collect() == []


# --- mixing -----------------------------------------------------------------------------------

def test_mix_reaches_targets(spark):
    r = random.Random(5)
    rows = []
    for i in range(3000):
        source = r.choice(["a"] * 10 + ["b", "c", "d", "é", None])
        rows.append((i, " ".join(["w"] * r.randint(0, 40)), None, source, 0))
    rows += [(None, "x y", None, "a", 0), (7, rows[7][1], None, rows[7][3], 0), (9000, None, None, "c", 0),
             (9001, "", None, "zero", 0)]
    frame = spark.createDataFrame(rows, DOC).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1))
    found = mixing.mix_sources(frame).toPandas()
    assert len(found) == len(rows)
    whole = found["size"].sum()
    assert (found.taken <= 2 * found["size"]).all()
    per = found.fillna({"source": "~"}).groupby("source").agg(
        size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"), source_size=("source_size", "first"))
    assert (per["size"] == per.source_size).all()
    assert ((per.taken - per.target).abs() <= 20.5).all()
    assert abs(per.target.sum() - min(1.5 * whole, 2 * whole)) < 1e-6 * whole or (per.target <= 2 * per["size"]).all()
    again = mixing.mix_sources(frame.repartition(5)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(str, found[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    repeated = mixing.mixed(spark.createDataFrame(rows, DOC))
    assert repeated.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert repeated.count() == found.copies.sum()
    assert mixing.mix_sources(frame.limit(0)).collect() == []


# --- pipeline ---------------------------------------------------------------------------------

def test_pipeline_stages_take_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontaminate", "mix", "token_ids"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    passed = "clean and quiet words about nothing " * 5
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    more = docs(spark, [(10_000, passed + "one two"), (10_001, passed + "one two three"),
                        (10_002, "before it stands " + bench), (10_003, None)])
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["toxicity"](spark, given.unionByName(more), SMALL)
    assert kept.columns == given.columns
    kept = stage["jaccard"](spark, kept, SMALL)
    ids = {r.doc_id for r in kept.collect()}
    assert {10_000, 10_002, 10_003} <= ids and 10_001 not in ids
    kept = stage["decontaminate"](spark, kept, SMALL)
    ids = {r.doc_id for r in kept.collect()}
    assert {10_000, 10_003} <= ids and 10_002 not in ids and kept.columns == given.columns
    out = stage["token_ids"](spark, stage["mix"](spark, kept, SMALL), SMALL)
    assert {r.doc_id for r in out.collect()} <= ids


def test_branches_merge_by_counts_not_by_steps_of_purity(spark):
    """Shares on two sides of a quarter merge where counts can't tell them apart, and the same
    shares part where they can."""
    def branch(name, blocked, allowed):
        return [("h", f"/p/{name}", 1)] * blocked + [("h", f"/p/{name}", 0)] * allowed

    def templates(rows):
        found = urls.template_purity(
            spark.createDataFrame(rows, "host string, path string, label int"))
        return {r.template for r in found.collect()}

    rest = [("h", "/q/x/y", 0)] * 20 + [("h", "/q/x/y", 1)] * 7
    assert templates(branch("a", 5, 16) + branch("b", 6, 15) + rest) == {"/p/a", "/q/x/y"}
    assert templates(branch("a", 300, 1500) + branch("b", 600, 1200) + rest) == {
        "/p/a", "/p/b", "/q/x/y"}


def test_language_of_texts_without_letters_and_of_copies(spark):
    rows = [(i, "der die das und nicht ein", "de") for i in range(200)]
    rows += [(300 + i, f"the and of to in that it was {i}", "en") for i in range(30)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn_profiles(known, most_per_lang=5)
    assert len(profiles["de"]) > 10  # a text with all of a language's rows still teaches
    texts = ["😀😀 🎉", "12 %", "𝐝𝐞𝐫 und das", "the and", "", None, "der 😀 die"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [r.p for r in frame.select(
        "i", language.language(F.col("text"), profiles).alias("p")).orderBy("i").collect()]
    assert [p.lang_pred for p in found] == ["und", "und", "de", "en", "und", "und", "de"]
    assert found[0].score == 0


# --- token ids: encoder and grammar -----------------------------------------------------------

def test_encoder_gives_the_library_s_ids_for_any_text():
    r = random.Random(12)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "«", "»", " ", " ", "　", "中", "😀", "'s", "'", "'re",
            "1", "23", ".", "!", "\x1c", "\x85", "the", " of", "x" * 70, "<|endoftext|>", "\0", "", "é.", "×", "÷",
            "don't", "\r\n", "\n\n", "(", ")", "9é", "ſ", "İ", "_", "ß9"]
    encode, library = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(600):
        texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 8))]
        if k == 300:
            encode.clear()
        ids, sizes = encode.encode(texts)
        ends = np.cumsum(sizes)
        for text, a, b in zip(texts, ends - sizes, ends):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids + [0], text


def test_grammars_expand_to_their_ids():
    r = np.random.default_rng(2)
    for _ in range(120):
        n = int(r.integers(1, 400))
        ids = r.integers(0, int(r.integers(1, 6)), n)
        ends = np.unique(np.append(r.integers(1, n + 1, 3), n))
        lengths = np.diff(ends, prepend=0)
        symbols, per_doc, lefts, rights = tokens.repair(ids, lengths, 10, int(r.integers(2, 6)))
        grammar = tokens.Grammar(10, lefts, rights)
        assert grammar.expand(symbols).tolist() == ids.tolist()
        begin = np.cumsum(per_doc) - per_doc
        for k in range(len(lengths)):
            part = grammar.expand(symbols[begin[k]:begin[k] + per_doc[k]])
            assert part.tolist() == ids[ends[k] - lengths[k]:ends[k]].tolist()


def test_repeats_of_any_length_become_rules():
    stretch = np.random.default_rng(3).integers(0, 50_000, 64)
    for ids in (np.tile(stretch, 4000), np.zeros(200_000, dtype=np.int64)):
        symbols, _, lefts, rights = tokens.repair(ids, np.array([len(ids)]), 50_257)
        assert len(symbols) < 100
        assert tokens.Grammar(50_257, lefts, rights).expand(symbols).tolist() == ids.tolist()


def test_sections_hold_large_vocabularies():
    r = np.random.default_rng(4)
    ids = np.concatenate([r.integers(0, 128_000, 5000), np.tile([70_000, 127_999], 500)])
    lengths = np.array([2000, len(ids) - 2000])
    data, _, rules = tokens.encode_section([1, None], ids, lengths, 128_000)
    section = tokens.Section(data)
    assert rules > 0 and section.all_ids().tolist() == ids.tolist()
    assert section.document(1, 100, 200).tolist() == ids[2100:2200].tolist()


def test_rows_under_one_id_are_cut_into_shards(spark, tmp_path):
    rows = [(i, f"text {k} " * 50) for i in (None, 4) for k in range(60)] + [(9, "the last")]
    folder = f"{tmp_path}/t"
    manifest = tokens.write_tokens(docs(spark, rows).repartition(3), folder, PATH, shard_bytes=4_000)
    assert manifest.select("shard").distinct().count() > 8
    found = tokens.read_digests(spark, folder).orderBy("start").collect()
    assert [x.doc_id for x in found] == [None] * 60 + [4] * 60 + [9]
    library = Tokenizer.from_file(PATH)
    sums = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
                  for _, t in rows)
    assert sorted(x.ids_crc32 for x in found) == sums


def test_rows_without_an_id_are_spread_and_reruns_agree(spark):
    rows = [(None, f"w{k} " * (k % 9 + 1), None, "a", 0) for k in range(400)]
    rows += [(5, "x y z", None, "b", 0), (5, "z y x", None, "b", 0), (6, "q " * 30, None, "b", 0)]
    frame = spark.createDataFrame(rows, DOC)
    taken = [
        sorted(map(str, mixing.mixed(frame.repartition(parts)).collect())) for parts in (1, 6)]
    assert taken[0] == taken[1]
    names = frame.select(mixing.uniform(mixing.rank_name()).alias("u")).distinct().count()
    assert names == 402


def test_archive_rows_without_an_id_are_cut_into_shards(spark, tmp_path):
    rows = [(None, f"u{k}", f"n{k} " * 400) for k in range(60)] + [(3, "u", f"{k} " * 400) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"{tmp_path}/w", shard_bytes=5_000)
    assert manifest.select("shard").distinct().count() > 12
    found = warc.read_warc(spark, f"{tmp_path}/w", payload=True).collect()
    assert sorted((x.page_id or 0, bytes(x.payload).decode()) for x in found) == sorted(
        (i or 0, h) for i, _, h in rows)
