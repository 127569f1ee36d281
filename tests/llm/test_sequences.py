"""Packing, the prefix trie of conversations and their repair, against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from broadsheet.llm import packing, structure, trie
from broadsheet.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
TURN = "conv_id long, turn long, role string, text string"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "very long " * 40_000
NOTHING = hashlib.sha256(b"").hexdigest()


# --- packing ----------------------------------------------------------------------------------

def padding(length, full=2048):
    return 0 if length & (length - 1) == 0 else full - length


def plain_cost(at, cost, length, least):
    best = {0: 0}
    for c in range(1, len(at)):
        ways = []
        for i in range(c):
            size = at[c] - at[i]
            if size <= length:
                full = size >= least and size & (size - 1) == 0
                ways.append(best[i] + (0 if full else length - size))
        best[c] = min(ways) + cost[c]
    return best[len(at) - 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.sampled_from([0, 3, 9])), min_size=1, max_size=30))
def test_windows_are_the_cheapest(steps):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    cost = np.array([0] + [c for _, c in steps])
    cuts = packing.choose_cuts(at, cost, length=16, least_exact=2)
    assert cuts[-1] == at[-1] and (np.diff(cuts, prepend=0) <= 16).all()
    price = dict(zip(at.tolist(), cost.tolist()))
    total = sum(
        price[b] + (0 if b - a in (2, 4, 8, 16) else 16 - (b - a))
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())
    )
    assert total == plain_cost(at.tolist(), cost.tolist(), 16, 2)


def check_pieces(rows, texts, length=2048):
    """Every id in one piece, sequences without gaps; the share of padding."""
    tokenizer = Tokenizer.from_file(BPE)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    left = {}
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        left.setdefault((doc_id, len(ids)), []).append(np.array(ids, dtype="<u4"))
    assert set(left) == set(by_doc)
    for key, pieces in by_doc.items():
        whole = left[key]
        for start, size in {(p.start, p.length) for p in pieces}:
            mine = sorted(p.ids_crc32 for p in pieces if (p.start, p.length) == (start, size))
            possible = sorted(zlib.crc32(w[start:start + size].tobytes()) for w in whole)
            assert set(mine) <= set(possible)
        assert sum(p.length for p in pieces) == sum(map(len, whole))
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in pieces])
        assert [p.offset for p in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= length
    sizes = [sum(p.length for p in pieces) for pieces in by_sequence.values()]
    return sum(padding(s, length) for s in sizes) / sum(sizes)


def test_packing_query_over_the_table(spark):
    rows = QUERIES["op11_packing"](spark, SMALL).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
             .select("doc_id", "text").collect()]
    assert check_pieces(rows, texts) < 0.03
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order)


def test_packing_edges(spark):
    texts = [(1, None), (2, ""), (3, LONG), (3, "shared id"), (4, "same"), (4, "same"),
             (None, "no id"), (5, "x" * 30_000), (6, "One. Two! Three? " * 2_000)]
    df = spark.createDataFrame([(i, t, None, None, None, 7) for i, t in texts],
                               DOC + ", sequence_id int")
    from pyspark.sql import functions as F
    for task in (packing.TASK_BYTES, 50_000):
        rows = packing.pack_documents(df, BPE, task_bytes=task).withColumn(
            "ids_crc32", F.crc32("ids")).collect()
        assert check_pieces(rows, texts) < 0.06
    assert packing.pack_documents(df.limit(0), BPE).count() == 0
    short = packing.pack_documents(df, BPE, length=64).withColumn("ids_crc32", F.crc32("ids"))
    check_pieces(short.collect(), texts, 64)


def test_cuts_prefer_boundaries(spark):
    df = spark.createDataFrame([(i, "A sentence of eight words stands right here. " * 40)
                                for i in range(60)], "doc_id long, text string")
    rows = packing.pack_documents(df, BPE).collect()
    tokenizer = Tokenizer.from_file(BPE)
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert ids[-1] == 1 or tokenizer.decode(ids).endswith(".")


# --- the prefix trie --------------------------------------------------------------------------

def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    original = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:2])] for c, v in turns.items()}
    conv = {}
    for c in original:
        h = zlib.crc32(str(c).encode()) % 4
        conv[c] = original.get(c - c % 20, [])[:h] + original[c][h:]
    nodes, kids = {}, {}
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            nodes.setdefault(tuple(conv[c][:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[b] for b in below)
    return sorted((
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p],
         saved[p], hashlib.sha256(",".join(
             str(c) for c in sorted(m) if len(conv[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items()
    ), key=str)


def found_trie(df):
    return sorted((tuple(r) for r in trie.rebuilt_trie(df).drop("d1", "d2").collect()), key=str)


def talk(r, conv_id, turns, texts):
    return [(conv_id, t, r.choice(["user", "assistant"]), r.choice(texts)) for t in range(turns)]


def test_trie_equals_a_plain_one(spark):
    r = random.Random(3)
    rows = []
    for c in range(90):  # few texts, so that prefixes of all lengths are shared
        rows += talk(r, c, r.randint(1, 13), ["a b", "c. d e", None])
    rows += [(c, t, "user", "same") for c in (200, 201, 202, 203, 207) for t in range(9)]
    rows += [(301, 0, "user", "its family has no first conversation")]
    rows += [(400, None, None, "null turn first"), (400, 0, "user", None), (400, 3, "", "")]
    assert found_trie(spark.createDataFrame(rows, TURN)) == plain_trie(rows)


def test_trie_with_a_conversation_of_most_rows(spark):
    r = random.Random(8)
    rows = [(20, t, "user", f"w{t % 7}") for t in range(600)]
    rows += [(27, t, "user", f"w{t % 7}") for t in range(500)]
    for c in range(40, 50):
        rows += talk(r, c, 3, ["x", LONG])
    df = spark.createDataFrame(rows, TURN).repartition(5)
    assert found_trie(df) == plain_trie(rows)


def test_trie_edges(spark):
    df = spark.createDataFrame([(None, 0, "user", "x")], TURN)
    assert found_trie(df) == [] and found_trie(df.limit(0)) == []
    # all turns go: 3 takes three turns of a conversation that is not there
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone")]
    ids = hashlib.sha256(str(lone).encode()).hexdigest()
    assert found_trie(spark.createDataFrame(rows, TURN)) == [(lone, 0, None, 1, 0, 1, 0, ids)]
    clash = spark.createDataFrame(
        [(*r, 1, 2) for r in rows], TURN + ", depth int, n_convs int")
    assert len(found_trie(clash)) == 1


# --- repair -----------------------------------------------------------------------------------

STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "p"}, "p": {"u": "u"}}
PUTS = {"": ("user", "u"), "s": ("user", "u"), "u": ("assistant", "p"), "p": ("user", "u")}


def plain_faults(turns):
    seen, marks = set(), []
    for _, role, text in turns:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        if not shown:
            marks.append("b")
        elif (role, text) in seen:
            marks.append("d")
        else:
            marks.append("-" if shown[-1] in ".!?" else "t")
        seen.add((role, text))
    return marks


def plain_repair(turns, marks):
    """All ways in order of cost, then of letters."""
    heap, least = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(turns) and state in ("", "p"):
            return cost, audit, out
        if least.setdefault((k, state), cost) < cost:
            continue
        role, to = PUTS[state]
        heapq.heappush(heap, (cost + 5, audit + "I", k, to, (*out, (role, ""))))
        if k < len(turns):
            _, own, text = turns[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, out))
            if marks[k] in "-t":
                more = cost + 5 * (marks[k] == "t")
                if own[:1] in STEPS[state]:
                    heapq.heappush(heap, (more, audit + "K", k + 1, STEPS[state][own[:1]],
                                          (*out, (own, text))))
                heapq.heappush(heap, (more + 1, audit + "R", k + 1, to, (*out, (role, text))))


def plain_summary(turns):
    if not turns:
        return (0,) * 6 + ("", NOTHING)
    marks = plain_faults(turns)
    cost, audit, out = plain_repair(turns, marks)
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out = {c: [] for c, *_ in rows if c is not None}
    for c, t, role, text in rows:
        if c is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0)) for c, v in out.items()}


def repaired(df, **sizes):
    ids = df.where("conv_id IS NOT NULL").select("conv_id").distinct()
    rows = structure.summaries(structure.repair_conversations(structure.damage(df), **sizes), ids)
    return {r[0]: tuple(r[1:]) for r in rows.collect()}


def test_repair_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()]
    found = {r[0]: tuple(r[1:]) for r in QUERIES["op13_structure_repair"](spark, SMALL).collect()}
    assert found == {c: plain_summary(v) for c, v in damaged(rows).items()}


ROLES = ["user", "assistant", "system", "tool", "", "User", None]
TEXTS = ["Fine.", "Cut off", " \t", "", "Is it? ", "Other one!", " ", "", None]


@pytest.mark.parametrize("sizes", [{}, {"piece_turns": 1}, {"piece_turns": 3}, {"piece_chars": 9}])
def test_repair_equals_a_plain_search(spark, sizes):
    r = random.Random(5)
    rows = []
    for c in range(120):
        turns = r.sample(range(20), r.randint(1, 11))
        rows += [(c, t, r.choice(ROLES), r.choice(TEXTS) or f"Text {r.randint(0, 5)}.")
                 for t in turns]
    rows += [(500, None, "user", "No turn."), (500, 4, "assistant", "Yes.")]
    rows += [(501, None, None, None)]
    df = spark.createDataFrame(rows, TURN).repartition(6)
    assert repaired(df, **sizes) == {c: plain_summary(v) for c, v in damaged(rows).items()}


def test_repair_of_a_conversation_with_most_rows(spark):
    """Its rows lie in all ranges and in many pieces; a long plain search would not end, so its
    cost and letters come from a table over all turns and states."""
    r = random.Random(9)
    turns = [(t, r.choice(["user", "assistant", "assistant", "system"]),
              r.choice([f"Turn {t}.", f"Turn {t}", "Again.", ""])) for t in range(900)]
    rows = [(7, *x) for x in turns] + [(c, 0, "user", "Hi.") for c in (1, 2, 30)]
    df = spark.createDataFrame(rows, TURN).repartition(5)
    ids = df.select("conv_id").distinct()
    pieces = structure.repair_conversations(df, piece_turns=40)
    assert pieces.where("conv_id = 7").count() > 20
    found = {x.conv_id: x for x in structure.summaries(pieces, ids).collect()}[7]
    marks = plain_faults(turns)
    price = {(len(turns), q): {"": 0, "s": 10, "u": 5, "p": 0}[q] for q in STEPS}
    arcs = {}
    for k in range(len(turns) - 1, -1, -1):
        for q in ("p", "u", "s", ""):
            arcs[k, q] = [("D", 2, (k + 1, q)), ("I", 5, (k, PUTS[q][1]))]
            if marks[k] in "-t":
                more = 5 * (marks[k] == "t")
                if turns[k][1][0] in STEPS[q]:
                    arcs[k, q].append(("K", more, (k + 1, STEPS[q][turns[k][1][0]])))
                arcs[k, q].append(("R", more + 1, (k + 1, PUTS[q][1])))
            price[k, q] = 10**9
        for _ in range(4):  # inserts lead to nodes of the same turn
            for q in STEPS:
                price[k, q] = min(c + price[to] for _, c, to in arcs[k, q])
    node, audit = (0, ""), ""
    while node[0] < len(turns):
        letter, node = min((a, to) for a, c, to in arcs[node] if c + price[to] == price[node])
        audit += letter
    audit += "I" * (price[node] // 5)
    assert (found.cost, found.audit) == (price[0, ""], audit)
    assert found.duplicate == marks.count("d") and found.blank == marks.count("b")
    assert found.gaps == 0


def test_repair_edges(spark):
    empty = spark.createDataFrame([(None, 0, "user", "x")], TURN)
    assert repaired(empty) == {} and repaired(empty.limit(0)) == {}
    # equal rows in any number: one stays, and they count as duplicates
    rows = [(3, 1, "user", "Same. " + LONG)] * 50 + [(3, 2, "assistant", "Ok.")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], TURN + ", audit string")
    assert repaired(df) == {3: plain_summary(damaged(rows)[3])}
    dropped = next(c for c in range(99) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "x")], TURN)
    assert repaired(gone) == {dropped: (0,) * 6 + ("", NOTHING)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua?"), st.sampled_from("-xt")), max_size=12))
def test_auction_prices_are_distances(marks):
    text = "".join(a + b for a, b in marks)
    layers = structure.settle(text, structure.LAST_PRICES)
    for k in range(len(marks)):
        for q in range(4):
            arcs = structure.ARCS[text[2 * k:2 * k + 2]][q]
            assert layers[k][q] == min(c + layers[k + step][to] for _, c, step, to in arcs)
