"""Toxicity and language scores computed again in plain Python, and the pipeline as a whole."""

from __future__ import annotations

import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from broadsheet.llm import language, toxicity
from broadsheet.llm.oracle import ORACLE

from tests.llm.test_pairs import brute_links

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
SYLLABLES = "ba be bi ba do du ka ke ki lo lu ma me mi no nu pa pe ra re sa se ta te".split()


def words(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


# --- toxicity ---------------------------------------------------------------------------------

def plain_score(model, text):
    """Entries are looked for at each word, phrases at each place, one after another."""
    folded = toxicity.fold(text)
    starts = [m.start() for m in re.finditer(" (?=.)", folded)]
    covered = set()
    for phrase in model.exceptions:
        at = folded.find(f" {phrase} ")
        while at >= 0:
            covered |= {k for k in range(at, at + len(phrase) + 1)}
            at = folded.find(f" {phrase} ", at + 1)
    weight = 0.0
    for at in starts:
        found = [w for entry, w in model.lexicon.items() if folded.startswith(entry, at + 1)]
        if found and at not in covered:
            weight += max(found)
    length = folded.count(" ") + 20
    const, whole, dense = model.coefficients
    x = const + whole * math.log1p(weight) + dense * math.log1p(100 * weight / length)
    return 1 / (1 + math.exp(-x))


def test_toxicity_scores_equal_a_plain_computation(spark):
    r = random.Random(21)
    bad = ["scumbag", "vilepig", "vilepigs"]
    rows = []
    for i in range(300):
        text = words(r, 25).split()
        if i % 3 == 0:
            text[r.randrange(25)] = r.choice(bad)
        if i % 7 == 0:
            text[3:4] = ["no", "vilepig"]
        rows.append((i, " ".join(text)))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    assert model.lexicon
    texts = [t for _, t in rows] + [None, "", "SCUMB4G scumbag", "no vilepig", "vílepigs " * 300, "x " * 50_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [x.s for x in frame.select("i", toxicity.toxicity(F.col("text"), model).alias("s")).orderBy("i").collect()]
    for text, score in zip(texts, found):
        assert math.isclose(score, plain_score(model, text), rel_tol=1e-9)


# --- language ---------------------------------------------------------------------------------

def plain_grams(text):
    """Counts of n-grams of 1 to 3 letters as numbers; words are padded by a gap (0)."""
    codes = [0]
    for char in (text or "").lower():
        code = ord(char) if char.isalpha() else 0
        if code > 0xFFFF:
            code = 0x8000 + (code & 0x7FFF)
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    counts = {}

    def add(size, *part):
        key = size << 48
        for k, c in enumerate(reversed(part)):
            key |= c << (16 * k)
        counts[key] = counts.get(key, 0) + 1

    for k, code in enumerate(codes):
        if code:
            add(1, code)
            add(3, codes[k - 1], code, codes[k + 1])
        if k + 1 < len(codes) and (code or codes[k + 1]):
            add(2, code, codes[k + 1])
    return counts


def ranked(counts, n):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]]


def test_languages_equal_plain_rank_distances(spark):
    r = random.Random(4)
    talk = {"de": "der die das und nicht ein schöne Straße über".split(),
            "en": "the of and to in that was with house".split(),
            "xx": "zu wa ki ło ñu ça été 中文 日本".split()}
    rows = [(i, " ".join(r.choice(talk[lang]) for _ in range(12)), lang)
            for i, lang in enumerate(["de", "en", "xx"] * 40)]
    profiles = language.learn_profiles(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=120)
    own = {}
    for lang in talk:
        total = {}
        for text in {t for _, t, x in rows if x == lang}:
            for g, n in plain_grams(text).items():
                total[g] = total.get(g, 0) + n
        own[lang] = ranked(total, 120)
        assert profiles[lang] == own[lang]
    texts = ["der the zu", "über", "x", "", None, "12!", "the house was 中文 with", "é" * 3000, words(r, 400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = [x.p for x in frame.select(
        "i", language.language(F.col("text"), profiles, 80).alias("p")).orderBy("i").collect()]
    most = max(map(len, own.values()))
    for text, p in zip(texts, found):
        grams = ranked(plain_grams(text), 80)
        if not any(g >> 48 == 1 for g in plain_grams(text)):
            assert (p.lang_pred, p.score) == ("und", 0.0)
            continue
        apart = {lang: sum(min(abs(own[lang].index(g) - k), most) if g in own[lang] else most
                           for k, g in enumerate(grams)) for lang in own}
        best = min(sorted(apart), key=apart.get)
        assert p.lang_pred == best and math.isclose(p.score, 1 - apart[best] / (len(grams) * most))


# --- the pipeline -----------------------------------------------------------------------------

def folder_of(spark, tmp_path, rows):
    folder = str(tmp_path / "data")
    frame = spark.createDataFrame(rows, DOC)
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_the_pipeline_equals_its_stages_done_plainly(spark, tmp_path):
    """Each stage's rows are computed again in another way from what the one before kept."""
    r = random.Random(17)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    rows = []
    for i in range(70):
        text = words(r, r.randint(20, 60))
        rows.append((i, text, "en", r.choice(["a", "b", None]), 0))
        if i % 5 == 0:
            rows.append((100 + i, text + " " + words(r, 2), "en", "c", 0))
        if i % 11 == 0:
            rows.append((200 + i, f"{text} {item}", "en", "a", 0))
    rows += [(7, "quite another text of ten words under the same id", "en", "b", 0), (None, rows[3][1], None, "a", 0),
             (400, None, None, "b", 0), (401, "", None, None, 0)]
    folder = folder_of(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [x for x in rows if plain_score(model, x[1]) < corpus_pipeline.TOXIC_AT]
    # one of each group of near copies; texts under one id are told apart by their place
    named = [(k, x[1]) for k, x in sorted(enumerate(kept), key=lambda x: (x[1][0] is None, x[1][0] or 0))
             if x[0] is not None]
    order = {k: place for place, (k, _) in enumerate(
        sorted(((k, t) for k, t in named if kept[k][0] is not None), key=lambda x: kept[x[0]][0]))}
    groups = brute_links([(order[k], t) for k, t in named if k in order], 5, 80)
    kept = [x for k, x in enumerate(kept) if x[0] is None or groups[order[k]][2] == order[k]]
    plain = re.sub(r"[\W_]+", " ", item.lower()).strip()
    kept = [x for x in kept if plain not in re.sub(r"[\W_]+", " ", (x[1] or "").lower())]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", kept)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {}
    for x in kept:
        texts.setdefault((x[0], len((x[1] or "").split())), []).append(x[1] or "")
    expected = []
    for doc_id, size, taken in db.execute(
            "SELECT doc_id, size, taken FROM (" + ORACLE["op10_mix_sources"] + ")").fetchall():
        text = texts[doc_id, size].pop()
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        times = taken // size if size else None
        expected.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), times))
    found = [tuple(x) for x in corpus_pipeline.run(spark, folder).select(
        "doc_id", "n_tokens", "ids_crc32").collect()]
    for doc_id, n, crc, times in expected:
        if times is not None:  # copies of a text without words don't show in the words taken
            assert found.count((doc_id, n, crc)) == times, (doc_id, n, times)
    assert {x[:3] for x in expected} >= set(found)


def test_the_pipeline_of_nothing_is_empty(spark, tmp_path):
    folder = folder_of(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, folder)
    assert out.collect() == [] and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
