"""Packing documents into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.tokens import TEXT_CHARS, Encoder, encoder, rows_of

SEQUENCE = 2048
END_ID = 1
# what a cut costs, in tokens of padding; a cut between documents is free
SENTENCE_CUT = 8
HARD_CUT = 64
# a stretch without a sentence's end is cut at every so many tokens
STRIDE = 64
# the shortest window that counts as full because its length is a power of two
LEAST_EXACT = 128
SECTION_IDS = 500_000
TASK_BYTES = 16 << 20
PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long")
_CLOSES = re.compile(r"[.!?。！？][\"'’”)\]]*\Z|\n\Z")


def sentence_marks(encode: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """By token id: whether it can close a sentence, and whether it can follow the close."""
    closes = np.zeros(encode.terminals, dtype=bool)
    opens = np.zeros(encode.terminals, dtype=bool)
    for k, text in enumerate(encode.tokenizer.decode_batch([[k] for k in range(encode.terminals)])):
        closes[k] = _CLOSES.search(text) is not None
        opens[k] = text[:1].isspace()
    return closes, opens


def places(
    ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, opens: np.ndarray,
    sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, stride: int = STRIDE,
) -> tuple[np.ndarray, np.ndarray]:
    """(positions, costs) of all cuts that windows may use; 0 and the last end are among them."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    newline = closes & opens  # a token that ends in a line break needs nothing after it
    cost[1:-1][closes[ids[:-1]] & (opens[ids[1:]] | newline[ids[:-1]])] = sentence_cut
    cost[0] = 0
    cost[ends] = 0
    at = np.flatnonzero(cost >= 0)
    gap = np.diff(at)
    more = (gap - 1) // stride  # hard cuts inside each stretch
    if more.any():
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        cost[np.repeat(at[:-1], more) + nth * stride] = hard_cut
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def choose_cuts(
    at: np.ndarray, cost: np.ndarray, length: int = SEQUENCE, least_exact: int = LEAST_EXACT
) -> np.ndarray:
    """The ends of the cheapest windows over all of ``at``.

    A window between two places at most ``length`` apart costs what its end costs, plus its
    padding: what it lacks of ``length``, or nothing if it is a power of two from
    ``least_exact`` on. With f for the cheapest way to a place, the padded windows need the
    least f(i) + i among the places in reach, which a queue of rising values holds in front;
    the full ones are looked up. Ties go to the longest window.
    """
    exact: dict[int, list[int]] = {}
    size = length // 2
    while size >= least_exact:
        first = np.searchsorted(at, at - size)
        for c in np.flatnonzero(at[first] == at - size).tolist():
            exact.setdefault(c, []).append(int(first[c]))
        size //= 2
    places, costs = at.tolist(), cost.tolist()
    best, reach = [0] * len(places), [0] * len(places)
    from_ = [0] * len(places)
    queue, head = [0], 0
    for c in range(1, len(places)):
        p = places[c]
        while places[queue[head]] < p - length:
            head += 1
        i = queue[head]
        f = reach[i] + length - p
        if c in exact:
            for j in exact[c]:
                if best[j] < f:
                    f, i = best[j], j
        best[c] = f = f + costs[c]
        from_[c] = i
        reach[c] = f = f + p
        while len(queue) > head and reach[queue[-1]] > f:
            queue.pop()
        queue.append(c)
    cuts, c = [], len(places) - 1
    while c > 0:
        cuts.append(places[c])
        c = from_[c]
    return np.array(cuts[::-1], dtype=np.int64)


def _pieces(
    doc_ids: list, ids: np.ndarray, lengths: np.ndarray, cuts: np.ndarray, sequence: int
) -> pa.RecordBatch:
    ends = np.cumsum(lengths)
    stops = np.union1d(ends, cuts)
    starts = np.concatenate([[0], stops[:-1]])
    doc = np.searchsorted(ends, starts, side="right")
    window = np.searchsorted(cuts, starts, side="right")
    # pieces follow each other without gaps, so the ids are one buffer cut at their ends
    own = pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer(np.append(0, 4 * stops).astype(np.int32)),
        pa.py_buffer(ids.astype("<u4").tobytes()),
    ])
    return pa.RecordBatch.from_arrays([
        pa.array([doc_ids[d] for d in doc.tolist()], pa.int64()),
        pa.array(starts - (ends - lengths)[doc]), pa.array(stops - starts),
        own,
        pa.array(lengths[doc]), pa.array(sequence + window),
        pa.array(starts - np.concatenate([[0], cuts])[window]),
    ], names=[c.strip().split(" ")[0] for c in PIECES.split(",")])


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = SEQUENCE, end_id: int = END_ID,
    sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, task_bytes: int = TASK_BYTES,
    section_ids: int = SECTION_IDS,
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids, in doc_id order.

    One row per piece: doc_id, start (its place in the document), length, ids (unsigned 32-bit
    little-endian), doc_tokens (ids of the document with its end id), sequence_id (ascending
    in document order), offset (its place in the sequence). Each id is in exactly one piece.

    Rows are range-partitioned by (doc_id, text hash) into tasks of about ``task_bytes`` of
    text, whatever the ids are; a task packs sections of about ``section_ids`` ids as they
    come, so it holds one section and the longest document. A sequence never spans two
    sections: that costs at most one padded sequence each. A rerun over other partitions may
    cut elsewhere.

    A null text is empty and gives its end id alone. Rows that share a doc_id, or have none,
    follow each other by a hash of their texts and are packed as documents of their own;
    other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        closes, opens = sentence_marks(encode)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, str]] = []
        doc_ids: list[int | None] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        chars = waiting = 0

        def tokens() -> None:
            nonlocal chars, waiting
            ids, lengths = encode.encode([t for _, t in held], end_id)
            doc_ids.extend(d for d, _ in held)
            parts.append((ids, lengths))
            waiting += len(ids)
            held.clear()
            chars = 0

        def section() -> pa.RecordBatch:
            nonlocal waiting, sequence
            ids, lengths = (np.concatenate(x) for x in zip(*parts))
            at, cost = places(ids, np.cumsum(lengths), closes, opens, sentence_cut, hard_cut,
                              min(STRIDE, length))
            cuts = choose_cuts(at, cost, length)
            out = _pieces(doc_ids, ids, lengths, cuts, sequence)
            sequence += len(cuts)
            doc_ids.clear(), parts.clear()
            waiting = 0
            return out

        for doc_id, text in rows_of(batches):
            held.append((doc_id, text))
            chars += len(text)
            if chars >= TEXT_CHARS:
                tokens()
                if waiting >= section_ids:
                    yield section()
        if held:
            tokens()
        if parts:
            yield section()

    tasks = max(1, -(-total // task_bytes))
    return (
        rows.withColumn("salt", F.xxhash64("text"))
        .repartitionByRange(tasks, "doc_id", "salt")
        .sortWithinPartitions("doc_id", "salt")
        .select("doc_id", "text")
        .mapInArrow(pack, PIECES)
    )
