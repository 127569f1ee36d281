"""The prefix trie of conversations, found by blocks of turns first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import WORD, shuffle_width
from broadsheet.llm.turns import in_ranges, running
from broadsheet.session import materialize

# turns in a block
BLOCK = 4
# how many turns at most a rebuilt conversation takes from its family's first, and the family
SHARED_TURNS = 4
FAMILY = 20
CHUNK_IDS = 50_000
KEY = ["d1", "d2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of (role, text), words: all that the trie needs of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, role).alias("h2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``pos``: 1 for a conversation's first turn, and so on."""
    ranged = in_ranges(rows, order, label)
    return running(ranged, order, F.sum, F.lit(1).cast("long"), "pos")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a rebuilt conversation takes from its family's first one."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED_TURNS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, turns) of the rebuilt conversations: the first h turns of the family's first
    conversation, then the own turns after the first h. ``turns`` comes from
    :func:`turn_rows`; the result has ``pos`` as its order."""
    order = ["turn", "h1", "h2"]
    placed = materialize(numbered(turns, order, "trie-turns").drop("_range", "turn"), "trie-placed")
    ids = placed.select("conv_id").distinct()
    heads = placed.where(F.col("pos") < SHARED_TURNS).withColumnRenamed("conv_id", "base")
    given = (
        ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base")
        .where(F.col("pos") <= shared_turns(F.col("conv_id"))).drop("base")
    )
    own = placed.where(F.col("pos") > shared_turns(F.col("conv_id")))
    return ids, own.unionByName(given)


def blocks_of(turns: DataFrame) -> DataFrame:
    """One row per conversation and block of ``BLOCK`` turns.

    b1, b2: the digest of all turns before the block; turns: for each of its turns depth, the
    digest up to it (d1, d2), up to the one before (p1, p2), and words. A digest is the xor of
    two 64-bit hashes of all (depth, turn), so it is a running value that ranges of rows can
    add up, and the digest after a block says that blocks up to it are equal.
    """
    ranged = numbered(turns.withColumnRenamed("pos", "at"), ["at"], "trie-rebuilt")
    ranged = materialize(
        ranged.withColumnRenamed("pos", "depth").withColumns({
            "t1": F.xxhash64("depth", "h1", "h2"), "t2": F.xxhash64("h2", "depth", "h1"),
        }).drop("h1", "h2", "at"), "trie-depths",
    )
    rows = ranged
    for k in "12":
        rows = running(rows, ["depth"], F.bit_xor, F.col(f"t{k}"), f"d{k}")
    turn = F.struct("depth", *KEY, F.col("d1").bitwiseXOR(F.col("t1")).alias("p1"),
                    F.col("d2").bitwiseXOR(F.col("t2")).alias("p2"), "words")
    return rows.groupBy(
        "conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block")
    ).agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "conv_id", "block", F.col("turns")[0].p1.alias("b1"), F.col("turns")[0].p2.alias("b2"),
        "turns",
    )


def _last(turns: str) -> list[Column]:
    last = F.element_at(turns, -1)
    return [last.d1.alias("a1"), last.d2.alias("a2")]


def nodes_of(blocks: DataFrame) -> DataFrame:
    """depth, d1, d2, p1, p2, words, conv_id (the smallest member), n_convs of every node
    below the root.

    Conversations are grouped by whole blocks on top of equal ones, on the map side first.
    Where one kind of block follows a digest, all its turns have the same members, and they
    are taken as they stand. Where siblings diverge, turn boundaries inside their blocks are
    counted, one row per kind of block and turn, whatever number of conversations share it.
    """
    kinds = materialize(
        blocks.groupBy("block", "b1", "b2", *_last("turns")).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.min("turns").alias("turns"),
        ), "trie-kinds",
    )
    above = ["block", "b1", "b2"]
    # the first block always diverges, and all kinds of it share one digest: it needs no look
    alone = kinds.where("block > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("k")).where("k = 1")
    turn = [F.explode("turns").alias("t"), "conv_id", "n_convs"]
    fields = ["t.depth", "t.d1", "t.d2", "t.p1", "t.p2", "t.words"]
    straight = kinds.join(alone, above, "left_semi").select(*turn).select(
        *fields, "conv_id", "n_convs")
    split = kinds.join(alone, above, "left_anti").select(*turn).select(
        *fields, "conv_id", "n_convs"
    ).groupBy("depth", *KEY, "p1", "p2", "words").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return straight.unionByName(split)


def subtree_sums(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved_tokens.

    Each node belongs to its smallest member; those of a conversation are the end of its path,
    from a depth ``top`` on. So a node's subtree is the rest of its owner's part, plus the
    whole parts of all other members: each conversation adds its part's sums to the nodes
    above ``top`` on its path. Equal stretches of a block are summed before turns are.
    """
    children = nodes.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
        "gain": (F.col("n_convs") - 1) * F.col("words"),
    })
    ranged = in_ranges(nodes, ["depth"], "trie-owned")
    nodes = materialize(running(ranged, ["depth"], F.sum, F.col("gain"), "upto"), "trie-upto")
    parts = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.sum("gain").alias("part"),
        F.count_if(F.col("n_children") == 0).alias("leaf"),
    )
    given = (
        blocks.where("block IS NOT NULL").join(parts.where("top > 1"), "conv_id")
        .where(F.col("turns")[0].depth < F.col("top"))
        .withColumn("turns", F.filter("turns", lambda t: t.depth < F.col("top")))
        .groupBy(*_last("turns")).agg(
            F.min("turns").alias("turns"), F.sum("part").alias("part"), F.sum("leaf").alias("leaf"))
        .select(F.explode("turns").alias("t"), "part", "leaf")
        .groupBy("t.d1", "t.d2").agg(F.sum("part").alias("more"), F.sum("leaf").alias("leaves"))
    )
    return (
        nodes.join(parts.select("conv_id", "part", "leaf"), "conv_id").join(given, KEY, "left")
        .withColumns({
            "saved_tokens": F.col("part") - F.col("upto") + F.col("gain")
            + F.coalesce("more", F.lit(0)),
            "n_leaves": F.col("leaf") + F.coalesce("leaves", F.lit(0)),
        })
        .drop("gain", "upto", "part", "leaf", "more", "leaves", "_range")
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as runs of ids in decimal, at most ``CHUNK_IDS`` each."""
    for batch in batches:
        d1, d2, ids = (batch.column(k).to_pylist() for k in range(3))
        out, start = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or k - start == CHUNK_IDS or (d1[k], d2[k]) != (d1[start], d2[start]):
                out.append((d1[start], d2[start], ids[start], ",".join(map(str, ids[start:k]))))
                start = k
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.string(),))],
            names=["d1", "d2", "first", "ids"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its runs in order; only the digest's state is held."""
    key, state = None, None
    for batch in batches:
        done = []
        for d1, d2, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (d1, d2) == key:
                state.update(b",")
            else:
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = (d1, d2), hashlib.sha256()
            state.update(ids.encode())
        yield _ends(done)
    if state:
        yield _ends([(*key, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([
        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
        pa.array(columns[2], pa.string()),
    ], names=["d1", "d2", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """d1, d2 and the SHA-256 of the ids that end there, ascending and comma-joined.

    A node where many conversations end lies in many ranges, each of which joins its ids; the
    digest, which no two tasks can share, then runs over a few long strings.
    """
    width = shuffle_width(ends.sparkSession)
    chunks = (
        ends.repartitionByRange(width, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
        .select(*KEY, "conv_id").mapInArrow(_chunks, "d1 long, d2 long, first long, ids string")
    )
    return (
        chunks.repartition(width, *KEY).sortWithinPartitions(*KEY, "first").select(*KEY, "ids")
        .mapInArrow(_digests, "d1 long, d2 long, ends_sha256 string")
    )


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations.

    ``ids`` (conv_id) names all conversations, those without turns too; ``turns`` (conv_id,
    pos, h1, h2, words) are their turns as hashes, in the order of ``pos``, unique within a
    conversation. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256, and the digest d1, d2. The root has depth
    0; without conversations there is none.

    Turn equality is equality of 128 hash bits. A conversation of any length is spread over
    ranges of rows; a turn, block or whole conversation that many share is collapsed on the
    map side or met by joins whose hot keys adaptive execution splits.
    """
    ids = materialize(ids, "trie-ids")
    blocks = materialize(blocks_of(turns), "trie-blocks")
    nodes = materialize(nodes_of(blocks), "trie-nodes")
    full = materialize(subtree_sums(nodes, blocks), "trie-sums")
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("block", *_last("turns"))).alias("e"))
    ends = ids.join(last, "conv_id", "left").select(
        F.coalesce("e.a1", F.lit(0).cast("long")).alias("d1"),
        F.coalesce("e.a2", F.lit(0).cast("long")).alias("d2"), "conv_id",
    )
    everyone = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    top = full.where("depth = 1").agg(
        F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    nothing = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = everyone.where("n_convs > 0").crossJoin(top).select(  # a single row each
        zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), "conv_id", "n_convs",
        nothing.alias("parent_conv_id"), "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
    )
    first = everyone.select(F.col("conv_id").alias("root"))
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    below = (
        full.where("depth = 1").crossJoin(F.broadcast(first))  # a single row
        .withColumnRenamed("root", "parent_conv_id").drop("p1", "p2")
        .unionByName(full.where("depth > 1").join(parents, ["p1", "p2"]).drop("p1", "p2"))
        .select(root.columns)
    )
    return (
        root.unionByName(below).join(ends_digests(ends), KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
                *KEY)
    )


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of all conversations of (conv_id, turn, role, text), rebuilt by
    :func:`rebuilt`.

    Turns go by ``turn``, null first; those that share a number by a hash of role and text.
    A null role or text is empty. Rows without a conv_id belong to no conversation and are
    left out. Other columns are ignored; an empty table gives no rows.
    """
    return prefix_trie(*rebuilt(turn_rows(conversations)))
