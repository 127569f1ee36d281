"""Cheapest repairs of conversation structure, by auctions on the lattice of edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import shuffle_width
from broadsheet.session import materialize

# What a repaired conversation may have shown so far: nothing, a system turn, an open user
# turn, a complete pair.
START, SYSTEM, USER, PAIR = range(4)
# the state that the next role leads to, and that role
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIR}, {"u": USER})
WANTED = ("user", "user", "assistant", "user")
WANTED_STATE = (USER, USER, PAIR, USER)
# costs
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# what is left to pay after the last turn: a pair is complete, nothing at all is fine
LAST_PRICES = (0, 2 * INSERT, INSERT, 0)
# from which states a state can be reached
REACHES = ((START,), (START, SYSTEM), (START, SYSTEM, USER, PAIR), (START, SYSTEM, USER, PAIR))
NEVER = 1 << 40
PIECE_TURNS, PIECE_CHARS = 5_000, 500_000
BLANKS = " \t\n\x0b\f\r"

# A turn's mark is two characters: its role's initial (s, u, a or ?) and its fault.
GOOD, BAD, SHORT = "-", "x", "t"

PIECE = ("conv_id long, piece long, open boolean, marks string, cost long, audit string, "
         "roles array<string>, texts array<string>, blank long, duplicate long, truncated long, "
         "illegal long, turns long, low long, high long, first_turn long, last_turn long")
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")


# --- the lattice ------------------------------------------------------------------------------

def _edits(mark: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, turns passed, next state) of the arcs that leave a turn in a state."""
    role, fault = mark
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, WANTED_STATE[state])]
    if fault != BAD:
        extra = CUT_OFF if fault == SHORT else 0
        if role in AFTER[state]:
            arcs.append(("K", extra, 1, AFTER[state][role]))
        arcs.append(("R", REROLE + extra, 1, WANTED_STATE[state]))
    return sorted(arcs)


# all arcs of a turn, by its mark and state
ARCS = {
    role + fault: tuple(tuple(_edits(role + fault, q)) for q in range(4))
    for role in "sua?" for fault in GOOD + BAD + SHORT
}


def _auction(arcs: tuple, prices: list[int], settled: list[bool], beyond: list[int]) -> None:
    """Settle one turn's nodes; ``beyond`` holds the settled prices of the next turn's.

    Each open node in turn is the origin of a path. If its end's price is below what the best
    arc offers, the price rises to that and the path contracts by a node, else it extends
    along that arc. Prices never exceed true distances (they start at the least price beyond,
    and all costs are positive integers but for K), and all arcs of the path are tight, so
    once it meets a settled node, all its nodes have their true distances.
    """
    for origin in range(4):
        path = [origin]
        while not settled[origin]:
            node = path[-1]
            best, to, inside = NEVER * 2, -1, False
            for _, cost, step, q in arcs[node]:
                offer = cost + (beyond[q] if step else prices[q])
                if offer < best:
                    best, to, inside = offer, q, not step
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            elif inside and not settled[to]:
                path.append(to)
            else:
                for q in path:
                    settled[q] = True


def settle(marks: str, last: list[int], reach: tuple[int, ...] = (0, 1, 2, 3)) -> list[list[int]]:
    """Prices of all nodes: the cheapest way from a state before a turn on to the end, where
    state q costs ``last[q]``. Only states in ``reach`` can get there."""
    layers = [list(last)]
    for k in range(len(marks) - 2, -1, -2):
        beyond = layers[-1]
        floor = min(beyond)
        prices = [floor if q in reach else NEVER for q in range(4)]
        _auction(ARCS[marks[k:k + 2]], prices, [q not in reach for q in range(4)], beyond)
        layers.append(prices)
    return layers[::-1]


def trace(marks: str, layers: list[list[int]], state: int) -> tuple[str, int, list[int]]:
    """(letters, last state, state after each letter) of the ASCII-least cheapest edits from a
    state on: at each node the least letter among the tight arcs, which lead to one node each."""
    letters, states, k = [], [], 0
    while 2 * k < len(marks):
        price = layers[k][state]
        for letter, cost, step, q in ARCS[marks[2 * k:2 * k + 2]][state]:
            if cost + layers[k + step][q] == price:
                break
        letters.append(letter)
        k, state = k + step, q
        states.append(state)
    return "".join(letters), state, states


def ending(state: int) -> str:
    """The inserts after the last turn."""
    return "I" * (LAST_PRICES[state] // INSERT)


def rebuild(
    audit: str, states: list[int], roles: list[str], texts: list[str]
) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    turns = iter(zip(roles, texts))
    out_roles, out_texts = [], []
    for letter, state in zip(audit, states):
        if letter == "I":
            role, text = ("assistant" if state == PAIR else "user"), ""
        else:
            role, text = next(turns)
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if state == PAIR else "user"
        out_roles.append(role)
        out_texts.append(text)
    return out_roles, out_texts


def _finished(
    marks: str, layers: list[list[int]], state: int, last: bool, roles: list, texts: list
) -> tuple[str, list[str], list[str]]:
    audit, state, states = trace(marks, layers, state)
    if last:
        for _ in ending(state):
            audit, state = audit + "I", WANTED_STATE[state]
            states.append(state)
    return audit, *rebuild(audit, states, roles, texts)


# --- pieces -----------------------------------------------------------------------------------

class _Piece:
    """Turns of one conversation that follow each other, and what is counted over them."""

    def __init__(self, conv_id: int) -> None:
        self.conv_id, self.chars, self.open = conv_id, 0, False
        self.clear()

    def clear(self) -> None:
        self.marks, self.roles, self.texts, self.turns = [], [], [], []
        self.faults = [0, 0, 0]
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, mark: str) -> None:
        fault = "bdt".find(mark[1])
        if fault >= 0:
            self.faults[fault] += 1
        self.marks.append(mark[0] + (GOOD if fault < 0 else BAD if fault < 2 else SHORT))
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.chars += len(text)

    def row(self, number: int) -> tuple:
        marks = "".join(self.marks)
        known = [t for t in self.turns if t is not None]
        counted = (
            *self.faults, illegal_pairs(marks), len(set(known)), min(known, default=None),
            max(known, default=None), self.turns[0], self.turns[-1],
        )
        if self.open:
            return (self.conv_id, number, True, marks, 0, "", self.roles, self.texts, *counted)
        layers = settle(marks, LAST_PRICES)
        audit, roles, texts = _finished(marks, layers, START, True, self.roles, self.texts)
        return (self.conv_id, number, False, marks, layers[0][START], audit, roles, texts, *counted)


def illegal_pairs(marks: str) -> int:
    roles = marks[::2]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(),
          "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.strip().split(" ") for c in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], _KINDS[t]) for k, (_, t) in enumerate(fields)],
        names=[n for n, _ in fields],
    )


def _cut(piece_turns: int, piece_chars: int):
    """Sorted turns as pieces. A conversation that lies inside this task's rows and is short is
    repaired at once; the first and the last one may go on in other tasks and stay open."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        piece, first, done = None, True, []

        def emit() -> None:
            nonlocal number
            done.append(piece.row(number))
            number += 1
            piece.clear()

        for batch in batches:
            for conv_id, turn, role, text, mark in zip(
                *(batch.column(k).to_pylist() for k in range(5))
            ):
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        emit()
                        first = False
                    piece = _Piece(conv_id)
                    piece.open = first
                elif len(piece.marks) >= piece_turns or piece.chars >= piece_chars:
                    piece.open = True
                    emit()
                piece.add(turn, role, text, mark)
            if done:
                yield _batch(done, PIECE)
                done.clear()
        if piece is not None:
            piece.open = True
            emit()
            yield _batch(done, PIECE)

    return cut


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, the cheapest way from each state before it to each state after it."""
    for batch in batches:
        rows = []
        for conv_id, piece, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ways = [settle(marks, [0 if q == to else NEVER for q in range(4)], REACHES[to])[0]
                    for to in range(4)]
            rows.append((conv_id, piece, [p for way in ways for p in way]))
        yield _batch(rows, "conv_id long, piece long, ways array<long>")


def _last_prices(rows: pd.DataFrame) -> pd.DataFrame:
    """The prices after each piece of one conversation, from the last piece to the first."""
    rows = rows.sort_values("piece", ascending=False)
    prices, found = list(LAST_PRICES), []
    for ways in rows["ways"]:
        found.append(prices)
        prices = [min(int(ways[4 * to + q]) + prices[to] for to in range(4)) for q in range(4)]
    return pd.DataFrame({"conv_id": rows["conv_id"], "piece": rows["piece"], "prices": found})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, the state that the edits from each state lead to."""
    for batch in batches:
        rows = []
        for conv_id, piece, marks, prices in zip(
            *(batch.column(k).to_pylist() for k in range(4))
        ):
            layers = settle(marks, prices)
            rows.append((conv_id, piece, [trace(marks, layers, q)[1] for q in range(4)]))
        yield _batch(rows, "conv_id long, piece long, exits array<long>")


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each piece of one conversation, and whether it is the last one."""
    rows = rows.sort_values("piece")
    state, found = START, []
    for exits in rows["exits"]:
        found.append(state)
        state = int(exits[state])
    last = [False] * (len(found) - 1) + [True]
    return pd.DataFrame({"conv_id": rows["conv_id"], "piece": rows["piece"], "entry": found,
                         "final": last})


_TRACED = [c.strip() for c in PIECE.split(",")]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open pieces repaired, as the prices after them and the state before them are known."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            layers = settle(row["marks"], row["prices"])
            audit, roles, texts = _finished(
                row["marks"], layers, row["entry"], row["final"], row["roles"], row["texts"])
            # a piece costs what its prices fall by, the last one all that is left
            cost = layers[0][row["entry"]]
            if not row["final"]:
                cost -= row["prices"][trace(row["marks"], layers, row["entry"])[1]]
            row |= {"cost": cost, "audit": audit, "roles": roles, "texts": texts}
            rows.append(tuple(row[c.split(" ")[0]] for c in _TRACED))
        yield _batch(rows, PIECE)


def _closed(open_: DataFrame) -> DataFrame:
    """Open pieces repaired across their borders.

    A conversation may have any number of pieces, in any number of tasks: each piece is
    reduced to a matrix of prices, those of a conversation (one row per piece) are chained
    from the end for the prices between pieces, and the states between them from the start.
    """
    key = ["conv_id", "piece"]
    prices = (
        open_.select(*key, "marks").mapInArrow(_matrices, "conv_id long, piece long, ways array<long>")
        .groupBy("conv_id")
        .applyInPandas(_last_prices, "conv_id long, piece long, prices array<long>")
    )
    prices = materialize(prices, "structure-prices")
    entries = (
        open_.select(*key, "marks").join(prices, key).select(*key, "marks", "prices")
        .mapInArrow(_exits, "conv_id long, piece long, exits array<long>")
        .groupBy("conv_id")
        .applyInPandas(_entries, "conv_id long, piece long, entry long, final boolean")
    )
    return open_.join(prices, key).join(entries, key).mapInArrow(_finish, PIECE)


# --- tables -----------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults put in by the checksum of their place:
    one in twenty each is dropped, emptied, loses its ends of sentences, is repeated, or
    becomes the user's. A null role or text becomes one space."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    ).cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
    ).where("kind <> 0").withColumn("times", F.when(F.col("kind") == 3, 2).otherwise(1)).select(
        "conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"),
    ).drop("copy")


def _marked(conversations: DataFrame) -> DataFrame:
    """Turns with their order (conv_id, turn, h1, h2, place) and their mark: the role's initial,
    and b, d, t or - for blank, duplicate, truncated and sound ones."""
    rows = materialize(
        conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
        ).withColumns({
            "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role"),
            "place": F.monotonically_increasing_id(),
        }), "structure-turns",
    )
    same = ["conv_id", "h1", "h2"]
    # of equal turns the first is none; rows that agree in all may take any order
    firsts = rows.groupBy(*same).agg(F.min(F.struct("turn", "place")).alias("met")).select(
        *same, "met.place", F.lit(True).alias("first"))
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(body == "", "b").when(F.col("first").isNull(), "d")
        .when(~F.substring(body, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    )
    return rows.join(firsts, [*same, "place"], "left").select(
        "conv_id", "turn", "h1", "h2", "place", "role", "text",
        F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault).alias("mark"),
    )


def repair_conversations(
    conversations: DataFrame, piece_turns: int = PIECE_TURNS, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Cheapest repairs of all conversations of (conv_id, turn, role, text), as pieces.

    Columns as in ``PIECE``: conv_id; piece, ascending along a conversation; audit, the edits'
    initials in order; roles and texts of what is left and put in; cost; counts of faults.
    Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (a must for blank turns and those
    met before), Insert an empty one 5; a truncated turn that stays costs 5. What is left reads
    nothing, or an optional system turn and pairs of user and assistant. Of the cheapest ways
    the ASCII-least audit is taken.

    Turns go by ``turn``, null first; those that share a number by a hash of role and text, so
    repeated ones are neighbours. A null role or text is one space; a role that begins with
    none of s, u and a, or is empty, can't be kept. Rows without a conv_id belong to no
    conversation and are left out; an empty table gives no rows; other columns are ignored.

    Rows are range-partitioned, so a conversation with any share of them lies in many tasks,
    which hold one piece of it at a time.
    """
    order = ["conv_id", "turn", "h1", "h2", "place"]
    pieces = materialize(
        _marked(conversations)
        .repartitionByRange(shuffle_width(conversations.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("conv_id", "turn", "role", "text", "mark")
        .mapInArrow(_cut(piece_turns, piece_chars), PIECE), "structure-pieces",
    )
    return pieces.where("NOT open").unionByName(_closed(pieces.where("open")))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; the text only passes the digest."""
    conv: dict | None = None

    def result() -> tuple:
        gaps = 0 if conv["low"] is None else conv["high"] - conv["low"] + 1 - conv["turns"]
        return (conv["conv_id"], gaps, *(conv[c] for c in _ADDED), "".join(conv["audit"]),
                conv["state"].hexdigest())

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if conv is None or conv["conv_id"] != row["conv_id"]:
                if conv is not None:
                    done.append(result())
                conv = {**row, "state": hashlib.sha256(), "audit": [row["audit"]], "any": False}
            else:
                for c in _ADDED:
                    conv[c] += row[c]
                # the pieces' border: a pair of turns, and perhaps one turn number on both sides
                conv["illegal"] += illegal_pairs(conv["marks"][-2:] + row["marks"][:2])
                conv["turns"] += row["turns"] - (
                    row["first_turn"] is not None and row["first_turn"] == conv["last_turn"])
                for c, pick in (("low", min), ("high", max)):
                    both = [x for x in (conv[c], row[c]) if x is not None]
                    conv[c] = pick(both) if both else None
                conv["last_turn"], conv["marks"] = row["last_turn"], row["marks"]
                conv["audit"].append(row["audit"])
            for role, text in zip(row["roles"], row["texts"]):
                conv["state"].update(f"{chr(10) if conv['any'] else ''}{role}:{text}".encode())
                conv["any"] = True
        yield _batch(done, RESULT)
    if conv is not None:
        yield _batch([result()], RESULT)


_ADDED = ("blank", "duplicate", "truncated", "illegal", "cost")


def summaries(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per conv_id of ``ids``: gaps, faults, cost, audit and the SHA-256 of the repaired
    ``role:text`` lines. One without turns has zeros, no audit and the digest of nothing."""
    whole = pieces.where("NOT open").select(
        "conv_id",
        F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns"))
        .cast("long").alias("gaps"), *_ADDED, "audit",
        F.sha2(F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)),
                            "\n"), 256).alias("repaired_sha256"),
    )
    split = (
        pieces.where("open").repartition(shuffle_width(pieces.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "piece").mapInArrow(_summed, RESULT)
    )
    found = whole.unionByName(split)

    def or_zero(c: str) -> Column:
        return F.coalesce(c, F.lit(0).cast("long")).alias(c)

    return ids.join(found, "conv_id", "left").select(
        "conv_id", *[or_zero(c) for c in ("gaps", *_ADDED)],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
        .alias("repaired_sha256"),
    )
