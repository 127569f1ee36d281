"""Removal of long repeated word sequences, found by recompression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import (
    FAN, _powers, address_ddl, addressed, exchange, flat_column, forget_shuffles, homes_of, lists_of,
    mix, slices_for, text_pieces, word_hashes,
)
from broadsheet.session import materialize

ROUNDS = 3
KEYS_PER_SLICE = 2_000_000
BYTES_PER_KEY = 25
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_WINDOW = np.uint64(0xA0761D6478BD642F)
NO_ID = -(2**63)


class Words:
    """The words of a piece of texts, with hashes of any stretch of them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.hash, self.before = word_hashes(texts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.before))
        n = len(self.hash)
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * _powers(_BASE, n) if n else self.hash, out=self._sum[1:])
        self._back = _powers(_INVERSE, n + 1)

    def stretch(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sum[hi] - self._sum[lo]) * self._back[lo] + (hi - lo).astype(np.uint64))


@dataclass
class Symbols:
    """Symbols in order: name, the words ``lo`` to ``hi`` that alone decide that the symbol is
    there, and the text. ``sure`` is off where a text's end had a part in it."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sure: np.ndarray
    text: np.ndarray


def name_runs(s: Symbols) -> Symbols:
    """Runs of one symbol become a symbol; a run is known by what stands on both sides."""
    n = len(s.name)
    first = np.flatnonzero(np.concatenate(
        [[True], (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])]
    ))
    size = np.diff(np.append(first, n))
    left, right = np.maximum(first - 1, 0), np.minimum(first + size, n - 1)
    inside = (first > 0) & (first + size < n) & (s.text[left] == s.text[first]) & (
        s.text[right] == s.text[first])
    name = np.where(size > 1, mix(s.name[first] + mix(size.astype(np.uint64))), s.name[first])
    return Symbols(
        name, np.minimum(s.lo[left], s.lo[first]), np.maximum(s.hi[right], s.hi[first]),
        inside & s.sure[left] & s.sure[first] & s.sure[right], s.text[first],
    )


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """A left symbol followed by a right one becomes a symbol; a hash of the name and the
    round says which symbols are left ones. Pairs never overlap, and whether a symbol is in
    one shows from the neighbour on its open side."""
    n = len(s.name)
    salt = np.uint64((turn + 1) * int(_WINDOW) % 2**64)
    right = (mix(s.name + salt) >> np.uint64(63)).astype(bool)
    opens = np.zeros(n, dtype=bool)
    opens[:-1] = ~right[:-1] & right[1:] & (s.text[1:] == s.text[:-1])
    taken = np.concatenate([[False], opens[:-1]])
    near = np.clip(np.arange(n) + np.where(right, -1, 1), 0, n - 1)
    met = (s.text[near] == s.text) & (near != np.arange(n))
    follow = np.minimum(np.arange(n) + 1, n - 1)
    name = np.where(opens, mix(s.name * _PAIR + s.name[follow]), s.name)
    out = ~taken
    return Symbols(
        name[out], np.minimum(s.lo, s.lo[near])[out], np.maximum(s.hi, s.hi[near])[out],
        (s.sure & s.sure[near] & met)[out], s.text[out],
    )


def recompress(words: Words, rounds: int = ROUNDS) -> Symbols:
    """Symbols after naming runs and some rounds of pairs.

    A name is a hash of what it stands for, so equal runs and pairs get the same name in every
    task without a dictionary; equal stretches of words have the same symbols in their
    interior, in whatever text they stand.
    """
    n = len(words.hash)
    s = Symbols(words.hash, np.arange(n), np.arange(n) + 1, np.ones(n, dtype=bool), words.text)
    if n:
        s = name_runs(s)
        for turn in range(rounds):
            s = name_pairs(s, turn)
    return s


@dataclass
class Parse:
    """What stands for the windows of a piece: marks (keys of symbols, and of windows that hold
    no symbol for sure) with their texts, and the windows that each symbol lies in."""

    words: Words
    size: int

    def __post_init__(self) -> None:
        words, size = self.words, self.size
        n = len(words.hash)
        begin, end = words.before[:-1][words.text], words.before[1:][words.text]
        self.window = np.arange(n) + size <= end  # a window starts here
        s = recompress(words)
        fit = s.sure & (s.hi - s.lo <= size) & (end[s.lo] - begin[s.lo] >= size) if n else s.sure
        lo, hi = s.lo[fit], s.hi[fit]
        key = words.stretch(lo, hi)
        half = key & np.uint64(1) == 0  # by content, so alike wherever the stretch stands
        self.lo, self.hi, self.key = lo[half], hi[half], key[half]
        # it lies in the windows from here to its own start
        self.first = np.maximum(self.hi - size, begin[self.lo]) if n else self.lo
        self.alone = np.flatnonzero(self.window & (self._within(None) == 0))
        self.alone_key = mix(words.stretch(self.alone, self.alone + size) ^ _WINDOW)

    def _within(self, some: np.ndarray | None) -> np.ndarray:
        """For each window, how many of (some) symbols lie in it."""
        n = len(self.words.hash)
        first, last = (self.first, self.lo) if some is None else (self.first[some], self.lo[some])
        change = np.bincount(first, minlength=n + 1) - np.bincount(last + 1, minlength=n + 1)[:n + 1]
        return np.cumsum(change)[:n]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and the texts they stand in."""
        return (np.concatenate([self.key, self.alone_key]),
                self.words.text[np.concatenate([self.lo, self.alone])])

    def candidates(self, repeated: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Windows whose marks are all repeated; (key, text) pairs given as two columns."""
        known = np.unique(mix(repeated) + owner.astype(np.uint64) * _PAIR)

        def among(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
            asked = mix(keys) + self.words.text[places].astype(np.uint64) * _PAIR
            at = np.searchsorted(known, asked)
            return known[np.minimum(at, len(known) - 1)] == asked if len(known) else at < 0

        all_in, hit_in = self._within(None), self._within(np.flatnonzero(among(self.key, self.lo)))
        both = self.window & (all_in > 0) & (all_in == hit_in)
        return np.union1d(np.flatnonzero(both), self.alone[among(self.alone_key, self.alone)])


def _per_owner(
    sent: DataFrame, slices: int, name: str, kind: pa.DataType, ddl: str
) -> DataFrame:
    """rk and the list of all its values, from rows with owners and values."""

    def merge(table: pa.Table) -> pa.Table:
        owner, value = flat_column(table, "owners"), flat_column(table, name)
        order = np.argsort(owner, kind="stable")
        owners, group = np.unique(owner[order], return_inverse=True)
        return pa.table({
            "rk": pa.array(owners, pa.int64()),
            name: lists_of(value[order], group, len(owners), kind),
        })

    return exchange(sent, slices, merge, f"rk long, {name} array<{ddl}>", FAN)


def _in_slices(key: np.ndarray, slices: int) -> np.ndarray:
    return ((key >> np.uint64(16)) % np.uint64(slices)).astype(np.int64)


def _repeated_marks(rows: DataFrame, size: int, slices: int) -> DataFrame:
    """rk, keys: for each text the marks that stand elsewhere too, or twice in it.

    A task first looks at its own piece: what is met twice there is repeated for sure, and only
    one of the equal marks travels on, so a stretch that a third of all texts hold is met once
    per piece where its hash is gathered.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            for rks, piece in text_pieces(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, text = Parse(Words(piece), size).marks()
                owner = np.array(rks, dtype=np.int64)[text]
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(key)))
                # 0 asks for equals elsewhere, 2 does so and is settled, 1 is settled
                asks = np.where(times > 1, 2, 0)
                sure = np.repeat(times > 1, times) & ~new
                # what only is settled goes anywhere, by turns
                home = np.append(_in_slices(key[new], slices), np.full(sure.sum(), number % slices))
                number += 1
                yield from addressed(home, slices, {
                    "keys": (np.append(key[new], key[sure]).view(np.int64), pa.int64()),
                    "owners": (np.append(owner[new], owner[sure]), pa.int64()),
                    "sure": (np.append(asks, np.ones(sure.sum(), dtype=np.int64)), pa.int8()),
                }, number, FAN).combine_chunks().to_batches()

    def gather(table: pa.Table) -> pa.Table:
        key, owner = flat_column(table, "keys"), flat_column(table, "owners")
        sure = flat_column(table, "sure")
        ordered = np.sort(key[sure != 1])
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        at = np.searchsorted(again, key)
        hit = again[np.minimum(at, len(again) - 1)] == key if len(again) else np.zeros(len(key), bool)
        hit |= sure > 0
        return addressed(homes_of(owner[hit], slices), slices, {
            "owners": (owner[hit], pa.int64()), "keys": (key[hit], pa.int64()),
        }, int(table.column("slice")[0].as_py()), FAN)

    sent = rows.mapInArrow(
        send, address_ddl("keys array<long>, owners array<long>, sure array<tinyint>"))
    found = exchange(
        sent, slices, gather, address_ddl("owners array<long>, keys array<long>"), FAN)
    return _per_owner(found, slices, "keys", pa.int64(), "long")


def _later_windows(rows: DataFrame, size: int, slices: int) -> DataFrame:
    """rk, starts: the windows of each text whose words also start earlier.

    ``rows`` has rk, doc_id, text and the text's repeated marks. Candidate windows are compared
    by a hash of all their words, within a piece first, then everywhere.
    """
    def after_first(key, doc, start, rk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by key and place; there, the rows at each key's first place, one per text,
        and what comes after it."""
        order = np.lexsort((rk, start, doc, key))
        key, doc, start, rk = key[order], doc[order], start[order], rk[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        begin = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
        later = (doc != doc[begin]) | (start != start[begin])
        again = np.concatenate([[False], rk[1:] == rk[:-1]]) if len(key) else new
        return order, ~later & (new | ~again), later

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            rks, docs = b.column(0).to_pylist(), b.column(1).to_pylist()
            places = list(range(len(rks)))
            marks = b.column(3)
            for part, piece in text_pieces(places, b.column(2).to_pylist()):
                parse = Parse(Words(piece), size)
                asked = marks.slice(part[0], len(part))
                owner = np.repeat(np.arange(len(part)), asked.value_lengths().to_numpy())
                at = parse.candidates(asked.flatten().to_numpy().view(np.uint64), owner)
                text = parse.words.text[at]
                key = parse.words.stretch(at, at + size)
                doc = np.array([NO_ID if docs[k] is None else docs[k] for k in part], np.int64)[text]
                rk = np.array([rks[k] for k in part], np.int64)[text]
                start = (at - parse.words.before[text]).astype(np.int32)
                order, new, later = after_first(key, doc, start, rk)
                key, doc, rk, start = key[order], doc[order], rk[order], start[order]
                # what is later for sure goes anywhere, by turns, and needs no more than its place
                n, late = int(new.sum()), int(later.sum())
                home = np.append(_in_slices(key[new], slices), np.full(late, number % slices))
                nothing = np.zeros(late, dtype=np.int64)
                number += 1
                yield from addressed(home, slices, {
                    "keys": (np.append(key[new].view(np.int64), nothing), pa.int64()),
                    "docs": (np.append(doc[new], nothing), pa.int64()),
                    "starts": (np.append(start[new], start[later]), pa.int32()),
                    "owners": (np.append(rk[new], rk[later]), pa.int64()),
                    "late": (np.repeat([0, 1], [n, late]), pa.int8()),
                }, number, FAN).combine_chunks().to_batches()

    def gather(table: pa.Table) -> pa.Table:
        key, doc, start, owner = (
            flat_column(table, c) for c in ("keys", "docs", "starts", "owners"))
        late = flat_column(table, "late") > 0
        asked = np.flatnonzero(~late)
        order, _, later = after_first(key[asked], doc[asked], start[asked], owner[asked])
        late[asked[order[later]]] = True
        return addressed(homes_of(owner[late], slices), slices, {
            "owners": (owner[late], pa.int64()), "starts": (start[late], pa.int32()),
        }, int(table.column("slice")[0].as_py()), FAN)

    sent = rows.mapInArrow(send, address_ddl(
        "keys array<long>, docs array<long>, starts array<int>, owners array<long>, "
        "late array<tinyint>"))
    found = exchange(
        sent, slices, gather, address_ddl("owners array<long>, starts array<int>"), FAN)
    return _per_owner(found, slices, "starts", pa.int32(), "int")


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept for every row of ``docs`` (doc_id, text).

    A window is ``size`` consecutive words of a text. Each word is removed that a window covers
    whose words also start earlier: in a smaller doc_id, or before in the same one. Windows are
    judged on the input. ``kept`` holds the other words, joined by one space.

    Recompression finds them: equal windows have equal symbols inside, so a window can only
    repeat if all symbols that lie in it do. Symbols are shared out by hash to see which are
    repeated, windows that consist of repeated ones are compared in full, also by hash, and
    their earliest place is kept.

    A null text has no words. A null doc_id is smaller than all others. Rows that share a
    doc_id are judged one by one; equal places in them don't count as earlier, so repeated
    rows are treated alike. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "rk", F.xxhash64("doc_id", "text")
    )
    volume = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slices = slices_for(volume, KEYS_PER_SLICE * BYTES_PER_KEY)
    marks = materialize(_repeated_marks(rows.select("rk", "text"), size, slices), "repeat-marks")
    forget_shuffles(docs.sparkSession)
    later = materialize(
        _later_windows(
            rows.join(marks, "rk").select("rk", "doc_id", "text", "keys"), size, slices
        ), "repeat-windows",
    )
    forget_shuffles(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kept, sizes, gone = b.column(0), [], [], []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2)):
                words = text.encode("utf-8", "surrogatepass").split()
                sizes.append(len(words))
                if starts.is_valid and len(starts):
                    change = np.zeros(len(words) + 1, dtype=np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                    stay = np.cumsum(change[:-1]) == 0
                    words = [words[k] for k in np.flatnonzero(stay).tolist()]
                gone.append(sizes[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept)],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return rows.join(later, "rk", "left").select("doc_id", "text", "starts").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string"
    )
