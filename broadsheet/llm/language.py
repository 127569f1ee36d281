"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bound of the documents of each language that its profile is learned from.
MOST_PER_LANG = 2_000
PROFILE = 400
DOC_PROFILE = 300
PIECE_CHARS = 500_000
_LETTERS = np.fromiter((chr(c).isalpha() for c in range(65536)), dtype=bool, count=65536)
MOST_TEXTS = 2**14 - 1
SHIFT, OWNER = np.uint64(16), np.uint64(50)
SIZES = {n: np.uint64(n << 48) for n in (1, 2, 3)}
GRAM = np.uint64(2**50 - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters as 16-bit codes with 0 for a gap, and the text each belongs to."""
    joined = np.frombuffer("\0".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(joined < 65536, joined, 32768 + (joined & 32767)).astype(np.uint16)
    letter = (joined < 65536) & _LETTERS[codes]
    high = np.flatnonzero(joined >= 65536)
    if len(high):  # few in most texts
        met, place = np.unique(joined[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in met.tolist()])[place]
    codes = np.where(letter, codes, 0).astype(np.uint64)
    # texts are told apart by the characters between them; lower() can change lengths
    owner = np.cumsum(joined == 0)
    return codes, owner


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of all n-grams of 1 to 3 letters, words padded by a gap.

    An n-gram is a number: its size, then 16 bits a letter. Rows come by text, then n-gram.
    At most 2**14 texts go in one call.
    """
    texts = [t.replace("\0", " ") for t in texts]
    codes, owner = _codes(texts)
    codes = np.concatenate([[0], codes, [0]]).astype(np.uint64)
    owner = np.concatenate([[0], owner, owner[-1:] if len(owner) else [0]]).astype(np.uint64)
    same = np.concatenate([[False], (codes[1:] == 0) & (codes[:-1] == 0)])
    codes, owner = codes[~same], owner[~same]
    one = codes != 0
    two = codes[:-1] << SHIFT | codes[1:]
    three = two[:-1] << SHIFT | codes[2:]
    # a gap before a word counts with the word's text; the size goes into the top bits
    keys = np.concatenate([
        owner[one] << OWNER | SIZES[1] | codes[one],
        np.where(one[1:], owner[1:], owner[:-1]) << OWNER | SIZES[2] | two,
        owner[1:-1][one[1:-1]] << OWNER | SIZES[3] | three[one[1:-1]],
    ])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    counts = np.diff(np.append(first, len(keys)).astype(np.int64))
    keys = keys[first] if len(keys) else keys
    return (keys >> OWNER).astype(np.int64), keys & GRAM, counts


def pieces(texts: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= PIECE_CHARS or len(held) == MOST_TEXTS:
            yield held
            held, size = [], 0
    if held:
        yield held


def learn_profiles(
    docs: DataFrame, most_per_lang: int = MOST_PER_LANG, size: int = PROFILE
) -> dict[str, list[int]]:
    """For each value of lang its ``size`` most frequent n-grams, in rank order.

    Learned from text and lang alone; of each language about ``most_per_lang`` distinct texts
    are used, picked by their hash. Copies teach once, null texts and languages nothing; equal
    counts rank by the n-gram's number.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(
        "text", "lang", F.xxhash64("text").alias("h"))
    shares = known.select("lang", "h").distinct().groupBy("lang").agg(
        (most_per_lang / F.count(F.lit(1))).alias("share"))
    shares = {r.lang: r.share for r in shares.collect()}  # one row per language
    if not shares:
        return {}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    sample = known.where(
        F.pmod("h", F.lit(1_000_000)) / 1e6 < share[F.col("lang")]
    ).dropDuplicates(["lang", "h"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for part in pieces(rows["text"]):
                    _, keys, counts = grams(part)
                    whole, place = np.unique(keys, return_inverse=True)
                    yield pd.DataFrame({
                        "lang": pd.Series([lang] * len(whole), dtype=object), "gram": whole.astype(np.int64),
                        "n": np.bincount(place, weights=counts).astype(np.int64),
                    })

    counts = sample.mapInPandas(count, "lang string, gram long, n long")
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = (
        counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= size)
        .orderBy("lang", "rank").collect()
    )
    profiles: dict[str, list[int]] = {}
    for r in rows:
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def language(
    text: Column, profiles: dict[str, list[int]], size: int = DOC_PROFILE
) -> Column:
    """Struct of lang_pred and score for each whole text.

    A text's ``size`` most frequent n-grams are ranked (equal counts by the n-gram's number);
    the distance to a profile is the sum of rank differences, an n-gram that the profile
    lacks counts as the profile's length. The nearest profile wins, the first in the order of
    names on a tie. score is 1 minus its distance over the largest possible one. A null text,
    or one without a letter, is ``und`` with score 0, as is any text without profiles.
    """
    names = sorted(profiles)
    most = max((len(p) for p in profiles.values()), default=0)
    known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.uint64))
    ranks = np.full((len(known) + 1, len(names)), -1, dtype=np.int64)
    for k, name in enumerate(names):
        ranks[np.searchsorted(known, np.array(profiles[name], dtype=np.uint64)), k] = np.arange(
            len(profiles[name])
        )

    def judge(texts: list[str]) -> tuple[list[str], list[float]]:
        owner, gram, count = grams(texts)
        # by text, then falling count, then n-gram: rows already come in the last order
        order = np.sort(
            owner.astype(np.uint64) << np.uint64(50)
            | (np.uint64(2**22 - 1) - np.minimum(count, 2**22 - 1).astype(np.uint64)) << np.uint64(28)
            | np.arange(len(owner), dtype=np.uint64)
        ) & np.uint64(2**28 - 1)
        owner, gram = owner[order], gram[order]
        begin = np.searchsorted(owner, np.arange(len(texts) + 1))
        rank = np.arange(len(owner)) - begin[owner]
        top = rank < size
        owner, gram, rank = owner[top], gram[top], rank[top]
        at = np.searchsorted(known, gram)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != gram)] = len(known)
        theirs = ranks[at]
        apart = np.where(theirs < 0, most, np.minimum(np.abs(theirs - rank[:, None]), most))
        total = np.zeros((len(texts), len(names)), dtype=np.int64)
        np.add.at(total, owner, apart)
        used = np.bincount(owner, minlength=len(texts))
        best = total.argmin(axis=1)
        score = 1 - total[np.arange(len(texts)), best] / np.maximum(used * most, 1)
        has = np.zeros(len(texts), dtype=bool)
        has[owner[gram >> np.uint64(48) == 1]] = True
        return ([names[b] if h else "und" for b, h in zip(best, has)],
                np.where(has, score, 0.0).tolist())

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for part in pieces(texts):
            got = judge(part) if names else (["und"] * len(part), [0.0] * len(part))
            langs += got[0]
            scores += got[1]
        return pd.DataFrame({"lang_pred": pd.Series(langs, dtype=object),
                             "score": pd.Series(scores, dtype=float)})

    return predict(text)
