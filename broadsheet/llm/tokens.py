"""Token ids of documents in files: a Re-Pair grammar per section, with random access.

A file is a shard of the documents in ascending doc_id order. Its sections hold whole
documents of about ``SECTION_IDS`` ids each, one grammar each:

    magic "RPG2" | documents, rules, symbols, terminals, bytes of a symbol (u64 each)
    doc_ids (i64) | null flags (u8) | ids per document (u64) | symbols per document (u64)
    left, right of each rule | expansion length of each rule (u32) | symbols

A symbol takes two bytes where terminals and rules number at most 65,536, else four.
All numbers are little-endian. A symbol below ``terminals`` is a token id, one above it a rule
for a pair of earlier symbols. Pairs never cross documents, so a document is decoded alone, and
the expansion lengths tell which of its symbols cover a range of ids. The manifest lists each
section's place.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import mix, running_total, shuffle_width
from broadsheet.llm.warc import _store

MAGIC = b"RPG2"
END_ID = 0
SECTION_IDS = 1_000_000
SHARD_BYTES = 16 << 20
MOST_SHARDS = 65536
NO_ID = -(2**63)
LEAST_USES = 8
PAIR_BITS = 20
MOST_CACHED = 1_000_000
TABLE_BITS = 21
# characters encoded in one go, and rows of a batch made Python objects at a time
TEXT_CHARS = 500_000
ROWS_AT_ONCE = 64
LONGEST_KEPT = 64
MANIFEST = ("shard int, section int, file string, offset long, bytes long, documents long, "
            "ids long, symbols long, rules long")
# Classes of bytes in UTF-8: letters (ASCII and Latin with marks), digits, punctuation, spaces;
# all others may be anything.
LETTER, DIGIT, MARK, SPACE = 1, 2, 3, 4
CLASS = np.array([
    SPACE if b in (9, 10, 11, 12, 13, 32) else 0 if b < 33 or b == 127 else
    DIGIT if 48 <= b < 58 else LETTER if b in (0xC3, 0xC4, 0xC5) or b < 128 and chr(b).isalpha()
    else MARK if b < 128 else 0 for b in range(256)
], dtype=np.uint8)
# bytes that surely open a visible character: no lead byte of a space's code
VISIBLE = np.array([32 < b < 127 or (b > 0xC2 and not 0xE1 <= b <= 0xE3) for b in range(256)])


def piece_starts(raw: np.ndarray) -> np.ndarray:
    """Places in UTF-8 text where the byte-level pattern surely begins a new token, whatever
    stands further off: between letters, digits, punctuation and spaces, but that one space
    before a visible character stands apart, and a blank goes with what follows. An apostrophe
    may hold on to the letters after it."""
    kind = CLASS[raw]
    after = np.flatnonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5)) + 1
    sign = (raw[after - 1] == 0xC3) & ((raw[after] == 0x97) | (raw[after] == 0xB7))
    kind[after] = np.where(sign, 0, LETTER)
    kind[after[sign] - 1] = 0
    was, now = kind[:-1], kind[1:]
    out = np.zeros(len(raw), dtype=bool)
    known = (was > 0) & (was < SPACE)
    out[1:] = known & (now > 0) & (was != now) & ~((raw[:-1] == 39) & (now == LETTER))
    shown = VISIBLE[raw[1:]]
    out[:-1] |= (kind[:-1] == SPACE) & shown
    out[1:] |= (was == SPACE) & (raw[:-1] != 32) & shown
    return out


def _kind(piece: bytes) -> int:
    """How a piece may be encoded with others: 1 one after another, as it opens with a blank,
    2 on lines of their own, 0 not at all."""
    if len(piece) > 1 and piece[0] == 32 and VISIBLE[piece[1]]:
        return 1
    return 2 if piece and VISIBLE[piece[0]] and 0 < CLASS[piece[-1]] < SPACE else 0


class Encoder:
    """Ids of whole texts, each distinct piece encoded once by the tokenizers library.

    Byte-level BPE cuts text by its usual pattern first. A text is cut where that pattern
    surely cuts (:func:`piece_starts`), and what the library gives for a piece is kept under
    two 64-bit hashes of its bytes. All but the new pieces is a handful of array operations
    over the bytes of many texts. Tokenizers of another make, and texts that hold a special
    token's string, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        self.cuttable = (
            shape.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.special = [t["content"] for t in shape.get("added_tokens", [])]
        self.terminals = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # in a byte-level vocabulary each character of a token stands for one byte
        self.bytes_of = np.zeros(self.terminals, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes_of[k] = len(token)
        self.clear()

    def clear(self) -> None:
        """Forget all pieces."""
        self.table = np.full(1 << TABLE_BITS, -1, dtype=np.int32)
        self.hash = np.zeros(1 << 12, dtype=np.uint64)
        self.check = np.zeros(1 << 12, dtype=np.uint64)
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.length = np.zeros(1 << 12, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.pieces = self.used = 0

    def _find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The numbers of kept pieces, -1 for others: linear probing of all at once."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        left = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(left):
            entry = self.table[slot]
            met = entry >= 0
            left, slot, entry = left[met], slot[met], entry[met]
            same = (self.hash[entry] == hashes[left]) & (self.check[entry] == checks[left])
            out[left[same]] = entry[same]
            left, slot = left[~same], (slot[~same] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Append pieces' ids, one after another; their numbers."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.pieces + len(lengths) > len(self.begin):
            for name in ("hash", "check", "begin", "length"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        numbers = np.arange(self.pieces, self.pieces + len(lengths))
        self.pool[self.used:self.used + len(ids)] = ids
        self.begin[numbers] = self.used + np.cumsum(lengths) - lengths
        self.length[numbers] = lengths
        self.used += len(ids)
        self.pieces += len(lengths)
        return numbers

    def _whole(self, texts: list[str]) -> np.ndarray:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._keep(
            np.fromiter(chain.from_iterable(found), dtype=np.int32, count=sum(map(len, found))),
            np.fromiter(map(len, found), dtype=np.int64, count=len(found)),
        )

    def _joined(self, pieces: list[bytes], gap: bytes) -> np.ndarray:
        """Encode pieces, many in one call: no token spans two of them, nor the gap."""
        numbers = []
        for k in range(0, len(pieces), 4096):
            part = pieces[k:k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(
                [gap.join(part).decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
            sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            upto = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum(sizes + len(gap)) - len(gap)
            stop = np.searchsorted(upto, ends) + 1
            length = np.diff(stop, prepend=-len(gap)) - len(gap)  # a gap is one byte and one id
            if gap:
                inside = np.ones(len(ids), dtype=bool)
                inside[stop[:-1]] = False
                ids = ids[inside]
            numbers.append(self._keep(ids, length))
        return np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their numbers in order."""
        kind = np.fromiter(map(_kind, pieces), dtype=np.int8, count=len(pieces))
        out = np.zeros(len(pieces), dtype=np.int64)
        for k, encode in enumerate((
            lambda part: self._whole([p.decode() for p in part]),
            lambda part: self._joined(part, b""), lambda part: self._joined(part, b"\n"),
        )):
            of = np.flatnonzero(kind == k)
            out[of] = encode([pieces[i] for i in of.tolist()])
        return out

    def _numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of cuttable texts in order, and pieces per text."""
        data = b"\0".join(texts) + bytes(9)
        raw = np.frombuffer(data, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        opens = np.cumsum(sizes) - sizes
        at = piece_starts(raw)
        at[opens] = True
        starts = np.flatnonzero(at[:int(sizes.sum())])
        first = np.searchsorted(starts, opens)
        ends = np.append(starts[1:], int(sizes.sum()))
        ends[np.append(first[1:], len(starts)) - 1] -= 1  # the mark between two texts
        size = ends - starts
        # two hashes, eight bytes at a time
        state, check = mix(size.astype(np.uint64)), np.zeros(len(starts), dtype=np.uint64)
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=data, strides=(1,))
        inside = np.flatnonzero(size <= LONGEST_KEPT)
        for k in range(0, LONGEST_KEPT, 8):
            inside = inside[size[inside] > k]
            rest = np.minimum(size[inside] - k, 8).astype(np.uint64)
            chunk = eight[starts[inside] + k] << (np.uint64(64) - rest * np.uint64(8))
            state[inside] = mix(state[inside] ^ chunk)
            check[inside] = check[inside] * np.uint64(0x9E3779B97F4A7C15) + chunk
        numbers = self._find(state, check)
        numbers[size > LONGEST_KEPT] = -1
        new = np.flatnonzero(numbers < 0)
        if len(new):
            # a long piece is encoded where it stands, equal short ones once
            long = size[new] > LONGEST_KEPT
            own = np.where(long, mix(~new.astype(np.uint64)), state[new])
            _, lead, group = np.unique(own, return_index=True, return_inverse=True)
            lead = new[lead]
            got = self._learn(
                [data[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist())])
            self.hash[got], self.check[got] = state[lead], check[lead]
            self._enter(got[size[lead] <= LONGEST_KEPT])
            numbers[new] = got[group]
        return numbers, np.diff(first, append=len(starts))

    def _enter(self, numbers: np.ndarray) -> None:
        left = numbers
        slot = (self.hash[left] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of several in one slot the last one stays
            waits = self.table[slot] != left
            left, slot = left[waits], (slot[waits] + 1) & ((1 << TABLE_BITS) - 1)

    def encode(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by ``end_id``, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        if self.pieces > MOST_CACHED or self.used > 8 * MOST_CACHED:
            self.clear()
        cut = np.array([
            self.cuttable and "\0" not in t and not any(s in t for s in self.special) for t in texts
        ])
        counts = np.ones(len(texts), dtype=np.int64)
        whole = self._whole([t for t, c in zip(texts, cut) if not c])
        if cut.any():
            found, counts[cut] = self._numbered([t.encode() for t, c in zip(texts, cut) if c])
            pieces = np.zeros(int(counts.sum()), dtype=np.int64)
            of = np.repeat(cut, counts)
            pieces[of], pieces[~of] = found, whole
        else:
            pieces = whole
        begin, length = self.begin[pieces], self.length[pieces]
        # one more place after each text's last piece for the end id
        last = np.cumsum(counts) - 1
        room = length.copy()
        room[last] += 1
        ends = np.cumsum(room)
        out = np.full(int(ends[-1]), end_id, dtype=np.int32)
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        out[at + np.repeat(ends - room, length)] = self.pool[at + np.repeat(begin, length)]
        return out, np.diff(ends[last], prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer, so that tasks share what it has met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches as tuples, a few made at a time: a batch may hold long texts."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            yield from zip(*(c.to_pylist() for c in part.columns))


def _frequent(pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(place among the pairs, rank) of those met ``least`` times or more; the most frequent
    pair has rank 0."""
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    uses = np.diff(np.append(first, len(ordered)))
    often = np.flatnonzero(uses >= least)
    often = often[np.argsort(-uses[often], kind="stable")]
    chosen = ordered[first[often]]
    # most places are found by a table over a hash of the pair, those that share one by search
    slot = (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    home = (chosen * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    table = np.full(1 << PAIR_BITS, -1, dtype=np.int32)
    table[home[::-1]] = np.arange(len(chosen))[::-1]
    rank = table[slot]
    at = np.flatnonzero(rank >= 0)
    rank = rank[at]
    other = chosen[rank] != pairs[at] if len(chosen) else np.zeros(0, dtype=bool)
    if other.any():
        sort = np.argsort(chosen)
        asked = pairs[at[other]]
        found = np.minimum(np.searchsorted(chosen, asked, sorter=sort), len(chosen) - 1)
        found = sort[found]
        rank[other] = np.where(chosen[found] == asked, found, -1)
        at, rank = at[rank >= 0], rank[rank >= 0]
    return at, rank


def _apart(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which pairs to replace, given their places in order and ranks: of a run of one pair every
    second, of neighbours the more frequent one, and so on among those left."""
    taken = np.zeros(len(at), dtype=bool)
    left = np.arange(len(at))
    for _ in range(3):
        if not len(left):
            break
        p, r = at[left], rank[left]
        near = np.diff(p) == 1
        head = np.concatenate([[True], ~near | (r[1:] != r[:-1])])
        order = np.arange(len(p))
        left = left[(order - np.maximum.accumulate(np.where(head, order, 0))) % 2 == 0]
        p, r = at[left], rank[left]
        near = np.diff(p) == 1
        beaten = np.zeros(len(p), dtype=bool)
        beaten[1:] |= near & (r[:-1] < r[1:])
        beaten[:-1] |= near & (r[1:] < r[:-1])
        won = left[~beaten]
        taken[won] = True
        gone = np.zeros(len(at) + 2, dtype=bool)
        gone[won + 1] = True
        # a neighbour in place is a neighbour in the list
        beside = np.zeros(len(at), dtype=bool)
        beside[1:] |= taken[:-1] & (np.diff(at) == 1)
        beside[:-1] |= taken[1:] & (np.diff(at) == 1)
        left = left[~taken[left] & ~beside[left]]
    return taken


def repair(
    ids: np.ndarray, lengths: np.ndarray, terminals: int, least: int = LEAST_USES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols per document, rule lefts, rule rights) of ids cut by ``lengths``.

    Each round counts neighbouring pairs within documents and replaces the frequent ones at
    once, the more frequent one where two overlap. The first round looks at all pairs, later
    ones only at those with a new symbol and at frequent ones that had to wait, as all other
    counts can only fall. Rounds end when no pair is met ``least`` times, or none of those
    could be replaced half as often.
    """
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), dtype=bool)  # a document's last symbol opens no pair
    last[np.cumsum(lengths) - 1] = True
    lefts, rights, count = [], [], terminals
    active = np.flatnonzero(~last)
    while len(active) >= least:
        pairs = symbols[active].astype(np.uint64) << np.uint64(32) | symbols[active + 1]
        hit, rank = _frequent(pairs, least)
        if not len(hit):
            break
        at = active[hit]
        taken = _apart(at, rank)
        uses = np.bincount(rank[taken], minlength=int(rank.max()) + 1)
        good = uses >= max(2, least // 2)  # a rule costs two symbols and a length
        if not good.any():
            break
        taken &= good[rank]
        number = np.cumsum(good) - 1 + count
        where = at[taken]
        first = np.zeros(len(good), dtype=np.int64)
        first[rank[taken]] = where  # any place tells what a rule stands for
        lefts.append(symbols[first[good]])
        rights.append(symbols[first[good] + 1])
        count += int(good.sum())
        symbols[where] = number[rank[taken]]
        last[where] = last[where + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[where + 1] = False
        # counts of other pairs can only fall: next come pairs with a new symbol, and frequent
        # ones that had to wait
        again = np.zeros(len(symbols), dtype=bool)
        again[at[~taken]] = True
        again[where] = True
        before = np.cumsum(keep) - 1
        symbols, last, again = symbols[keep], last[keep], again[keep]
        new = before[where]
        again[new[new > 0] - 1] = True
        again &= ~last
        active = np.flatnonzero(again)
    nothing = [np.zeros(0, dtype=np.uint32)]
    return (symbols, np.diff(np.flatnonzero(last), prepend=-1),
            np.concatenate(lefts or nothing), np.concatenate(rights or nothing))


class Grammar:
    """Full expansions of all symbols of a section."""

    def __init__(self, terminals: int, lefts: np.ndarray, rights: np.ndarray) -> None:
        pairs = np.stack([lefts, rights], axis=1).astype(np.int64)
        rule, symbol = np.repeat(np.arange(len(pairs)), 2), pairs.ravel()
        while (open_ := symbol >= terminals).any():  # a pass per round of the grammar at most
            times = open_ + 1
            second = np.cumsum(times)[open_] - 1
            rule, found = np.repeat(rule, times), symbol[open_] - terminals
            symbol = np.repeat(symbol, times)
            symbol[second - 1], symbol[second] = pairs[found, 0], pairs[found, 1]
        self.length = np.concatenate([
            np.ones(terminals, dtype=np.int64), np.bincount(rule, minlength=len(pairs))
        ])
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.concatenate([np.arange(terminals), symbol]).astype(np.uint32)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        length = self.length[symbols]
        at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return self.pool[at + np.repeat(self.begin[symbols], length)]


class Section:
    """A decoded view of one section's bytes."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a section of token ids")
        docs, rules, symbols, terminals, width = np.frombuffer(data, "<u8", 5, 4).tolist()
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls = take("<i8", docs), take("u1", docs).astype(bool)
        self.lengths, self.per_doc = take("<u8", docs), take("<u8", docs)
        lefts, rights = take(f"<u{width}", rules), take(f"<u{width}", rules)
        self.rule_lengths = take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.grammar = Grammar(terminals, lefts, rights)
        self.begin = np.cumsum(self.per_doc) - self.per_doc

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document; only symbols that cover them are
        expanded."""
        symbols = self.symbols[int(self.begin[k]):int(self.begin[k] + self.per_doc[k])]
        ends = np.cumsum(self.grammar.length[symbols])
        stop = int(self.lengths[k]) if stop is None else min(stop, int(self.lengths[k]))
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.grammar.expand(symbols[a:b])[start - skipped:stop - skipped]

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)


def encode_section(
    doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, terminals: int
) -> tuple[bytes, int, int]:
    """A section's bytes, and its numbers of symbols and rules."""
    symbols, per_doc, lefts, rights = repair(ids, lengths, terminals)
    grammar_lengths = Grammar(terminals, lefts, rights).length[terminals:]
    width = 2 if terminals + len(lefts) <= 65536 else 4
    head = np.array([len(doc_ids), len(lefts), len(symbols), terminals, width], dtype="<u8")
    return b"".join([
        MAGIC, head.tobytes(),
        np.array([0 if d is None else d for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is None for d in doc_ids], dtype="u1").tobytes(),
        lengths.astype("<u8").tobytes(), per_doc.astype("<u8").tobytes(),
        *(x.astype(f"<u{width}").tobytes() for x in (lefts, rights)),
        grammar_lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ]), len(symbols), len(lefts)


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [c.strip().split(" ") for c in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)],
        names=[n for n, _ in fields],
    )


def _write(folder: str, tokenizer: str, section_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        store, path = _store(folder)
        out = shard = None
        held: list[tuple[int | None, str]] = []
        chars, ready_docs, ready_ids, ready_lengths, waiting = 0, [], [], [], 0
        done: list[tuple] = []

        def tokens() -> None:
            nonlocal held, chars, waiting
            if held:
                ids, lengths = encode.encode([t for _, t in held])
                ready_docs.extend(d for d, _ in held)
                ready_ids.append(ids)
                ready_lengths.append(lengths)
                waiting += len(ids)
                held, chars = [], 0
            if waiting >= section_ids:
                section()

        def section() -> None:
            nonlocal waiting, offset, number
            if not ready_docs:
                return
            data, symbols, rules = encode_section(
                ready_docs, np.concatenate(ready_ids), np.concatenate(ready_lengths),
                encode.terminals,
            )
            out.write(data)
            done.append((shard, number, name, offset, len(data), len(ready_docs), waiting,
                         symbols, rules))
            offset, number, waiting = offset + len(data), number + 1, 0
            ready_docs.clear(), ready_ids.clear(), ready_lengths.clear()

        def close() -> None:
            tokens()
            section()
            if out is not None:
                out.close()
                store.move(temp, f"{path}/{name}")

        offset = number = 0
        name = temp = ""
        for s, doc_id, text in rows_of(batches):
            if s != shard:
                close()
                shard, offset, number = s, 0, 0
                name, temp = f"shard-{s:05d}.rpg", f"{path}/_tmp-{uuid.uuid4().hex}"
                out = store.open_output_stream(temp, compression=None)
            held.append((doc_id, text))
            chars += len(text)
            if chars >= TEXT_CHARS:
                tokens()
            if done:
                yield _arrow(done, MANIFEST)
                done.clear()
        close()
        if done:
            yield _arrow(done, MANIFEST)

    return write


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, shard_bytes: int = SHARD_BYTES,
    section_ids: int = SECTION_IDS,
) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) into files; returns the manifest.

    Shards are cut at fixed places of the doc_id order, about ``shard_bytes`` of text each, so
    a rerun makes the same files. They are written under temporary names and renamed; only
    what the manifest table lists is committed. A null text is empty (its end id alone). Rows
    that share a doc_id follow each other by a hash of their texts, so many of them are cut
    into shards as well; a null doc_id comes first.
    An empty table gives an empty manifest. Other columns are ignored.
    """
    spark = docs.sparkSession
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    sizes = rows.groupBy("doc_id", "h").agg(
        F.sum(F.octet_length("text").cast("long") + 1).alias("size"))
    placed = running_total(sizes, ["doc_id", "h"], "size", "token-order")
    total = placed.agg(F.sum("size")).first()[0] or 0
    shard_bytes = max(shard_bytes, -(-total // MOST_SHARDS))  # bounds the list of cuts
    cuts = [r.start for r in placed.groupBy(F.floor(F.col("before") / shard_bytes).alias("shard"))
            .agg(F.min(F.struct("doc_id", "h")).alias("start")).orderBy("shard").collect()]
    start_ids = np.array([NO_ID if c.doc_id is None else c.doc_id for c in cuts], dtype=np.int64)
    start_hashes = np.array([c.h for c in cuts], dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The last shard that starts at or before (doc_id, h)."""
        known = ids.fillna(NO_ID).astype("int64").to_numpy()
        low = np.searchsorted(start_ids, known, side="left")
        high = np.searchsorted(start_ids, known, side="right")
        out = high - 1
        for k in np.unique(low[low < high]).tolist():  # shards that start at a row's own id
            own = np.flatnonzero((low == k) & (low < high))
            inside = start_hashes[k:high[own[0]]]
            out[own] = k + np.searchsorted(inside, hashes.to_numpy()[own], side="right") - 1
        return pd.Series(np.maximum(out, 0).astype(np.int32))

    manifest = (
        rows.select(shard_of("doc_id", "h").alias("shard"), "doc_id", "h", "text")
        .repartitionById(max(1, len(cuts)), "shard")  # a task per shard
        .sortWithinPartitions("shard", "doc_id", "h").select("shard", "doc_id", "text")
        .mapInArrow(_write(folder, tokenizer, section_ids), MANIFEST)
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row per section: what lies before it
    order = Window.orderBy("shard", "section").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(
        "file", "offset", "bytes", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("before")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as stream:
                    section = Section(stream.read_at(row["bytes"], row["offset"]))
                ids = section.all_ids().astype("<u4")
                ends = np.cumsum(section.lengths.astype(np.int64))
                starts = ends - section.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(section.doc_ids.astype(np.int64), mask=section.nulls),
                    pa.array(starts + row["before"]), pa.array(ends - starts),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64()),
                ], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(shuffle_width(spark), "file", "offset").mapInArrow(read, schema)


def read_document(
    spark: SparkSession, folder: str, shard: int, section: int, k: int,
    start: int = 0, stop: int | None = None,
) -> np.ndarray:
    """Some ids of the k-th document of a section, read from its bytes alone."""
    row = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").where(
        (F.col("shard") == shard) & (F.col("section") == section)
    ).first()
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{row.file}") as stream:
        return Section(stream.read_at(row.bytes, row.offset)).document(k, start, stop)
