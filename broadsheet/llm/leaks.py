"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import LETTERS, gram_hashes, mix, text_pieces, word_hashes

SIMILARITY = 0.8
STEPS = 24
SAMPLED = 3
TARGET_RECALL = 0.99
# Share of embedding steps on which texts at the edit bound agree, at least on average.
AGREEING = 0.5
# Words between the places of an item from which a walk starts, and words kept for the last walk.
ANCHOR_WORDS = 6
WALK_WORDS = 10
ITEMS_PER_BLOCK = 5_000
CHARS_PER_BLOCK = 1_500_000
LEAK = "array<struct<item_id:long,start:int,distance:int,words:int>>"


def repetitions(target: float = TARGET_RECALL, agreeing: float = AGREEING) -> int:
    """How often the sampling is repeated so that a pair at the bound is met at ``target``."""
    return math.ceil(math.log(1 - target) / math.log(1 - agreeing**SAMPLED))


def allowed(words: int, similarity: float = SIMILARITY) -> int:
    """The most edits at which an item of so many words still counts as found."""
    return int(math.floor((1 - similarity) * words + 1e-9))


def embed(words: np.ndarray, starts: np.ndarray, reps: int, seed: int = 7) -> np.ndarray:
    """LSH keys [start, repetition] of the CGK embeddings of the words from each start.

    A walk reads a word at each step and moves on to the next if a random function of step and
    word says so. Texts within few edits fall into step again after each edit, so their walks
    agree on most steps: edit distance becomes Hamming distance. A key is the words read on
    ``SAMPLED`` random steps.
    """
    random = np.random.default_rng(seed)
    coin = random.integers(0, 2**63, (STEPS, reps), dtype=np.uint64) * 2 + 1
    sampled = np.stack([random.choice(STEPS, SAMPLED, replace=False) for _ in range(reps)])
    key = np.broadcast_to(np.arange(reps, dtype=np.uint64), (len(starts), reps)).copy()
    place = np.repeat(starts[:, None], reps, axis=1)
    for step in range(STEPS):
        read = words[place]
        used = (sampled == step).any(axis=1)
        key[:, used] = mix(key[:, used] * np.uint64(0xD6E8FEB86659FD93) + read[:, used])
        place = place + ((read * coin[step]) >> np.uint64(63)).astype(np.int64)
    return key


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edit distance of ``item`` to a run of ``text``'s words, and the run's end."""
    row = np.zeros(len(text) + 1, dtype=np.int64)
    steps = np.arange(len(text) + 1)
    for k, word in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != word))
        new[0] = k + 1
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def anchors(words: int) -> np.ndarray:
    """Places of an item from which it is embedded: all along it, so that edits that crowd in
    some stretches leave walks over the others."""
    return np.append(np.arange(0, max(words - WALK_WORDS, 1), ANCHOR_WORDS), max(words - WALK_WORDS, 0))


@dataclass
class Index:
    """The items of one block: words, LSH keys of walks all along them, the pairs of words.

    Items that allow one edit at most are met by an exact half (the whole, if they allow none).
    """

    ids: list[int]
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        self.reps = repetitions()
        self.sets = [set(w.tolist()) for w in self.words]
        gap = np.zeros(STEPS + 1, dtype=np.uint64)
        long = [k for k, w in enumerate(self.words) if allowed(len(w)) > 1]
        joined = np.concatenate([gap, *[x for k in long for x in (self.words[k], gap)]])
        sizes = np.array([len(self.words[k]) for k in long], dtype=np.int64)
        begin = len(gap) + np.cumsum(sizes + len(gap)) - sizes - len(gap)
        places = [anchors(n) for n in sizes.tolist()]
        per_item = [len(p) for p in places]
        shift = np.concatenate([np.zeros(0, dtype=np.int64), *places])
        keys = embed(joined, np.repeat(begin, per_item) + shift, self.reps).ravel()
        number = np.repeat(np.repeat(np.array(long, dtype=np.int32), per_item), self.reps)
        order = np.argsort(keys, kind="stable")
        self.keys, self.number = keys[order], number[order]
        self.shift = np.repeat(shift.astype(np.int32), self.reps)[order]
        self.parts = self._parts()
        pairs = np.concatenate([gram_hashes(w, 2) for w in self.words])
        self.bits = np.uint64(64 - max(16, int(8 * max(len(pairs), 1)).bit_length()))
        self.pairs = np.zeros(1 << int(64 - self.bits), dtype=bool)
        self.pairs[(pairs >> self.bits).astype(np.int64)] = True
        self.sizes = np.unique(sizes)  # of the items that are met by walks

    def _parts(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: sorted hashes of the exact parts of short items, item numbers, shifts."""
        parts: dict[int, list[tuple]] = {}
        for k, w in enumerate(self.words):
            half = len(w) // 2
            cuts = {0: [(0, len(w))], 1: [(0, half), (half, len(w))]}.get(allowed(len(w)), [])
            for a, b in cuts:
                parts.setdefault(b - a, []).append((gram_hashes(w[a:b], b - a)[0], k, a))
        out = {}
        for n, found in parts.items():
            hashes = np.array([h for h, _, _ in found], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            out[n] = (hashes[order], *[np.array([f[j] for f in found])[order] for j in (1, 2)])
        return out

    def near(self, words: np.ndarray) -> np.ndarray:
        """Places that an item-sized window covers which could hold an item.

        Each edit breaks at most two of an item's pairs of neighbouring words, so a window
        with fewer of the items' pairs than the rest holds none: no item is lost here.
        """
        hit = np.zeros(len(words) + 1, dtype=np.int32)
        pairs = gram_hashes(words, 2)
        np.cumsum(self.pairs[(pairs >> self.bits).astype(np.int64)], out=hit[1:len(pairs) + 1])
        hit[len(pairs) + 1:] = hit[len(pairs)]
        change = np.zeros(len(words) + 1, dtype=np.int32)
        for size in self.sizes.tolist():
            k = allowed(size)
            if len(words) < size - k:
                continue
            # an item with deletions is shorter: windows may reach over the end
            ends = np.minimum(np.arange(len(words)) + size + k - 1, len(words))
            full = hit[ends] - hit[:-1] >= max(size - 1 - 2 * k, 1 if size > 1 else 0)
            at = np.flatnonzero(full)
            np.add.at(change, at, 1)
            np.add.at(change, np.minimum(at + size + k, len(words)), -1)
        return np.flatnonzero(np.cumsum(change[:-1]))

    @staticmethod
    def _meet(
        keys: np.ndarray, starts: np.ndarray, known: np.ndarray, number: np.ndarray, shift: np.ndarray
    ) -> np.ndarray:
        """(start, item, shift) of all entries whose key is met; ``keys`` is [start, repetition]."""
        flat = keys.ravel()
        lo, hi = np.searchsorted(known, flat), np.searchsorted(known, flat, side="right")
        met = np.flatnonzero(hi > lo)
        count = (hi - lo)[met]
        entry = np.repeat(lo[met], count) + np.arange(count.sum()) - np.repeat(
            np.cumsum(count) - count, count
        )
        return np.stack([np.repeat(starts[met // keys.shape[1]], count), number[entry], shift[entry]])

    def find(self, words: np.ndarray, before: np.ndarray) -> list[list[tuple]]:
        """For each text of a piece (words ``before[i]`` to ``before[i + 1]``) the items in it."""
        out: list[list[tuple]] = [[] for _ in range(len(before) - 1)]
        met = [
            self._meet(gram_hashes(words, n)[:, None], np.arange(len(words) - n + 1), *part)
            for n, part in self.parts.items() if len(words) >= n
        ]
        starts = self.near(words)
        if len(starts):
            padded = np.concatenate([words, np.zeros(STEPS + 1, dtype=np.uint64)])
            keys = embed(padded, starts, self.reps)
            met.append(self._meet(keys, starts, self.keys, self.number, self.shift))
        if not met:
            return out
        start, number, shift = np.concatenate(met, axis=1)
        text = np.searchsorted(before, start, side="right") - 1
        found = np.unique(np.stack([text, number, start - shift], axis=1), axis=0)
        # candidates of one item that lie close together are verified in one stretch
        same = (np.diff(found[:, 0]) == 0) & (np.diff(found[:, 1]) == 0) & (np.diff(found[:, 2]) <= 64)
        for group in np.split(found, np.flatnonzero(~same) + 1) if len(found) else []:
            t, n, low, high = *group[0], group[-1, 2]
            item = self.words[n]
            k = allowed(len(item))
            a = max(int(low) - k, int(before[t]))
            b = min(int(high) + len(item) + k, int(before[t + 1]))
            # each edit spares all but one of the item's words
            if len(self.sets[n].difference(words[a:b].tolist())) > k:
                continue
            distance, end = edit_distance(item, words[a:b])
            if distance <= k:
                start = max(a + end - len(item) - int(before[t]), 0)
                out[t].append((self.ids[n], start, distance, len(item)))
        return out


def build_index(benchmark: DataFrame) -> list[Index]:
    """Indexes of all items, in blocks of bounded size; the items are a stated query set.

    Null ids or texts and texts without a word are no items.
    """
    blocks, ids, texts, chars = [], [], [], 0

    def close() -> None:
        if ids:
            words, before = word_hashes([t.lower().encode() for t in texts], LETTERS)
            parts = [(i, words[a:b]) for i, a, b in zip(ids, before, before[1:]) if b > a]
            if parts:
                blocks.append(Index([i for i, _ in parts], [w for _, w in parts]))
            ids.clear(), texts.clear()

    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        chars += len(row.text)
        if len(ids) == ITEMS_PER_BLOCK or chars >= CHARS_PER_BLOCK:
            close()
            chars = 0
    close()
    return blocks


def leaks(text: Column, index: Index) -> Column:
    """The items of a block that each whole text holds, as (item_id, start, distance, words).

    Words are runs of letters and digits in lower case. An item is found where the edit
    distance of its words to some run of the text's words is at most a fifth of their number.
    A null or empty text holds none; an item that a text holds several times may be listed
    several times; equal items are each listed.
    """

    @F.pandas_udf(LEAK)
    def find(texts: pd.Series) -> pd.Series:
        out: list[list[tuple]] = []
        for k in range(0, len(texts), 200):
            lowered = [t if t is None else t.lower() for t in texts.iloc[k:k + 200]]
            for _, piece in text_pieces(lowered, lowered):
                words, before = word_hashes(piece, LETTERS)
                out += index.find(words, before)
        return pd.Series([
            [dict(zip(("item_id", "start", "distance", "words"), leak)) for leak in found]
            for found in out
        ], index=texts.index)

    return find(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, distance, words: each item in each document once, at its nearest
    place. Documents and benchmarks without rows give none."""
    found = [
        docs.select("doc_id", F.explode(leaks(F.col("text"), index)).alias("leak"))
        for index in build_index(benchmark)
    ]
    if not found:
        return docs.where(F.lit(False)).select(
            "doc_id", *[F.lit(None).cast(t).alias(n) for n, t in
                        (("item_id", "long"), ("start", "int"), ("distance", "int"), ("words", "int"))]
        )
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("doc_id", "leak.item_id").agg(
        F.min(F.struct("leak.distance", "leak.start", "leak.words")).alias("best")
    ).select("doc_id", "item_id", "best.start", "best.distance", "best.words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns."""
    for index in build_index(benchmark):
        docs = docs.where(F.size(leaks(F.col("text"), index)) == 0)
    return docs
