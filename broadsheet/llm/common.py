"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from broadsheet.session import materialize

# A word is a run of characters other than these six; A-Z is what lower-casing touches.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices_for(rows: int, per_slice: int) -> int:
    """How many slices keep each below ``per_slice`` rows on average."""
    return max(1, -(-rows // per_slice))


def forget_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark deletes them when the driver's garbage collector finds that nothing can read them
    any more, which between two long steps may not happen by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Narrow rows of a written table, to be broadcast if they are few: they are counted
    first. More of them meet the other side in a shuffle."""
    return F.broadcast(rows) if rows.count() <= most else rows


def running_total(rows: DataFrame, order: list[str], value: str, label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over all rows that come earlier.

    Two levels, so that no task sees more than one range of rows: a range partitioning,
    running sums within each range, and the ranges' own sums (one row per range) added on
    top. Give narrow rows; ``order`` should name a unique key.
    """
    spark = rows.sparkSession
    ranged = materialize(
        rows.repartitionByRange(shuffle_width(spark), *order).withColumn(
            "_range", F.spark_partition_id()
        ),
        label,
    )
    offsets = (
        ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum"))
        .select("_range", "_offset")
    )
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")  # one row per shuffle partition
        .withColumn("before", F.sum(value).over(within) - F.col(value) + F.col("_offset"))
        .drop("_range", "_offset")
    )


def components(links: DataFrame, label: str) -> DataFrame:
    """(id, root): the smallest id reachable over ``links`` (a, b), for every linked id.

    Alternating large-star and small-star rounds: each round moves every neighbour to the
    smallest one it sees, which needs two aggregations over the edges and at most a
    logarithmic number of rounds. Each round is a written table, so a lost executor costs a
    re-read.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-0",
    )
    step = 0
    while True:
        step += 1
        # large star: neighbours above a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            )).alias("e")).select("e.*").where("a <> b").distinct()
        )
        after = materialize(small, f"{label}-{step}")
        same = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() == same:
            return after.select(F.col("a").alias("id"), F.col("b").alias("root"))
        edges = after


# --- numpy helpers for tasks --------------------------------------------------------------

SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# as LOWER, with ASCII punctuation turned into blanks
LETTERS = np.array(
    [b if b > 127 or chr(b).isalnum() else 32 for b in LOWER.tolist()], dtype=np.uint8
)
_BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * 2 + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
PIECE_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(
    texts: list[bytes], table: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and the words before each text.

    ``table`` maps bytes before words are taken, as LOWER and LETTERS do.
    One pass over the joined bytes: a prefix sum of coded bytes times powers of an odd base
    gives each word's hash from two of its entries, so there is no loop over words.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if table is not None:
        joined = table[joined]
    gap = SPACE_BYTES[joined]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # word starts and ends by turns
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[joined] * _powers(_BASE, len(joined)), out=total[1:])
    back = _powers(_INVERSE, len(joined) + 1)
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, begins)


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each position that has as many."""
    if len(words) < size:
        return np.zeros(0, dtype=np.uint64)
    return reduce(
        lambda acc, k: mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[k:len(words) - size + 1 + k]),
        range(1, size), words[:len(words) - size + 1].copy(),
    )


def text_pieces(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch in pieces of bounded bytes; a null text is empty."""
    start, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 1
        if size >= PIECE_BYTES:
            yield ids[start:k + 1], held
            start, held, size = k + 1, [], 0
    if held:
        yield ids[start:], held


# --- arrays of many rows in one ----------------------------------------------------------

def lists_of(values: np.ndarray, group: np.ndarray, groups: int, kind: pa.DataType) -> pa.ListArray:
    """Values, sorted by group, as one list per group."""
    cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def flat_column(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate(
        [np.zeros(0, dtype=np.int64)]
        + [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]
    )


# --- an exchange of arrays ------------------------------------------------------------------

# Into how many slices a task deals out what it has at once.
FAN = 256
REFINED_VALUES = 4_000_000


def homes_of(owner: np.ndarray, slices: int) -> np.ndarray:
    return (mix(owner.view(np.uint64)) % np.uint64(slices)).astype(np.int64)


def addressed(
    home: np.ndarray, slices: int, columns: dict[str, tuple[np.ndarray, pa.DataType]], salt: int,
    fan: int = FAN,
) -> pa.Table:
    """Values with the slice each goes to, as rows for :func:`exchange`: one row per slice, or
    per range of slices if there are more than ``fan``, and none where nothing goes."""
    order = np.argsort(home, kind="stable")
    home, per = home[order], -(-slices // fan)
    met, begin = np.unique(home // per, return_index=True)
    cuts = pa.array(np.append(begin, len(home)), pa.int32())
    exact = home if per > 1 else home[:0]
    return pa.table({
        "slice": pa.array(met, pa.int32()),
        "salt": pa.array(np.full(len(met), salt % 2**20), pa.int32()),
        "homes": pa.ListArray.from_arrays(
            cuts if per > 1 else pa.array(np.zeros(len(met) + 1), pa.int32()),
            pa.array(exact, pa.int32())),
        **{name: pa.ListArray.from_arrays(cuts, pa.array(values[order], kind))
           for name, (values, kind) in columns.items()},
    })


def address_ddl(columns: str) -> str:
    return "slice int, salt int, homes array<int>, " + columns


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges of slices, sorted by range, as rows of single slices."""
    held: list[pa.RecordBatch] = []
    size = 0

    def rows() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        home = flat_column(table, "homes")
        order = np.argsort(home, kind="stable")
        met, begin = np.unique(home[order], return_index=True)
        cuts = pa.array(np.append(begin, len(home)), pa.int32())
        none = pa.ListArray.from_arrays(
            pa.array(np.zeros(len(met) + 1), pa.int32()), pa.array([], pa.int32()))
        arrays = [pa.array(met, pa.int32()), pa.array(np.zeros(len(met)), pa.int32()), none]
        for name in table.column_names[3:]:
            kind = table.schema.field(name).type.value_type
            values = flat_column(table, name)[order]
            arrays.append(pa.ListArray.from_arrays(cuts, pa.array(values, kind)))
        return pa.RecordBatch.from_arrays(arrays, names=table.column_names)

    for batch in batches:
        place = batch.column(0)
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            if held and (held[0].column(0)[0] != place[k] or size >= REFINED_VALUES):
                yield rows()
                held, size = [], 0
            held.append(row)
            size += len(row.column(2).flatten())
    if held:
        yield rows()


def exchange(
    sent: DataFrame, slices: int, gather: Callable[[pa.Table], pa.Table], schema: str,
    fan: int = FAN,
) -> DataFrame:
    """``gather`` over the rows of :func:`addressed` of each slice.

    Up to ``fan`` slices, that is one grouping. Beyond, rows go to ranges of slices first and
    are cut up there, by as many tasks per range as its slices call for; a task then has many
    rows for each of its slices at once. So a task never makes a row per slice of the whole
    table, and the rows of the first step grow with the input alone, those of the second with
    slices * (slices / fan / 8), in place of the square.
    """
    per = -(-slices // fan)
    if per > 1:
        salts = -(-per // 8)
        sent = (
            sent.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("int"))
            .repartition(shuffle_width(sent.sparkSession), "slice", "salt")
            .sortWithinPartitions("slice").mapInArrow(_refine, sent.schema)
        )
    return sent.groupBy("slice").applyInArrow(gather, schema)
