"""Order-respecting deduplication on two keys, within a batch and against a store."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.config import DEFAULT_CONFIG, EngineConfig
from broadsheet.operators.components import components
from broadsheet.session import materialize


def _known(key: str) -> Column:
    """The key as a value that is never NULL: NULL is a key like any other."""
    return F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The order values kept of rows sorted by component and order; only the keys kept of one
    component are held."""
    component, first, second = None, set(), set()
    for batch in batches:
        kept = []
        for root, order, a, b in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if root != component:
                component, first, second = root, set(), set()
            if a not in first and b not in second:
                first.add(a)
                second.add(b)
                kept.append(order)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["o"])


def _by_component(undecided: DataFrame) -> DataFrame:
    """``undecided`` pairs with ``root``: pairs that share keys, also over others, share it."""
    node = undecided.select(
        F.xxhash64(F.lit("a"), "a").alias("a"), F.xxhash64(F.lit("b"), "b").alias("b"))
    roots = components(node, "clashes").withColumnRenamed("id", "node")
    own = F.xxhash64(F.lit("a"), "a")
    return undecided.join(roots, own == roots["node"], "left").withColumn(
        "root", F.coalesce("root", own)).drop("node")


def kept_order_values(
    keys: DataFrame,
    first: str,
    second: str,
    order: str = "seq",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Order values of the rows a sequential walk keeps.

    The walk goes up in ``order`` and keeps a row if neither of its keys belongs to a
    row kept before; NULL is a key like any other. Rows that agree in both keys share their
    fate with the first of them, so one partial aggregation shrinks every group of copies to
    one row before anything is shuffled.

    If no value of ``second`` occurs with two values of ``first`` - the usual case - the
    walk keeps the first row per ``first``. Otherwise the rows that lead both of their groups
    are kept and those that share a key with them are dropped. What is left undecided are
    chains of clashes: up to ``config.walk_rows`` of them are walked over in one task, more
    by their connected components, which don't touch each other. The number of jobs grows with
    the logarithm of the longest chain, whatever its length. Within one component the walk is
    sequential by nature; it streams through the sorted rows.
    """
    spark = keys.sparkSession
    # read several times below, and its real size then guides the joins
    pairs = materialize(
        keys.select(_known(first).alias("a"), _known(second).alias("b"), F.col(order).alias("o"))
        .groupBy("a", "b").agg(F.min("o").alias("o")), "pairs",
    )
    clashes = pairs.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high"))
    if clashes.filter("low <> high").isEmpty():
        return pairs.groupBy("a").agg(F.min("o").alias(order)).select(order)

    lead_a = pairs.groupBy("a").agg(F.min("o").alias("o")).select("o")
    lead_b = pairs.groupBy("b").agg(F.min("o").alias("o")).select("o")
    leaders = lead_a.join(lead_b, "o", "left_semi")
    winners = materialize(pairs.join(leaders, "o", "left_semi"), "winners")
    undecided = materialize(
        pairs.join(winners.select("a"), "a", "left_anti")
        .join(winners.select("b"), "b", "left_anti"), "undecided",
    )
    if undecided.count() <= config.walk_rows:  # its size has just been checked
        rows = undecided.withColumn("root", F.lit(0).cast("long")).coalesce(1)
    else:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = _by_component(undecided).repartition(width, "root")
    walked = rows.sortWithinPartitions("root", "o").select("root", "o", "a", "b").mapInArrow(
        _walk, "o long")
    return winners.select("o").unionByName(walked).select(F.col("o").alias(order))


def ordered_dedup(
    df: DataFrame,
    first: str = "url",
    second: str = "article_hash",
    order: str = "seq",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Rows of ``df`` that survive the walk; only the keys are shuffled to decide."""
    kept = kept_order_values(df.select(order, first, second), first, second, order, config=config)
    return df.join(kept, order, "left_semi")


def not_in_store(
    batch: DataFrame,
    store: DataFrame,
    keys: tuple[str, ...] = ("url", "content_hash"),
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Rows of a batch of keys that match no store row in any of ``keys``.

    One equi anti join per key; a single OR condition would plan as a nested loop. Only
    the key columns of the store are read. The keys of a batch of proven small size are
    broadcast to that scan, so the store is not shuffled for it; a larger batch meets the
    store's keys in a shuffle.
    """
    batch = materialize(batch, "keys")
    sizes = batch.agg(*[F.sum(F.octet_length(k)).alias(k) for k in keys]).first()
    for key in keys:
        taken = store.select(key).filter(F.col(key).isNotNull())
        if (sizes[key] or 0) <= config.broadcast_key_bytes:
            wanted = batch.select(key).distinct()
            taken = taken.join(F.broadcast(wanted), key, "left_semi")
        batch = batch.join(taken.distinct(), key, "left_anti")
    return batch


def new_rows(
    batch: DataFrame,
    store: DataFrame | None,
    order: str = "seq",
    config: EngineConfig = DEFAULT_CONFIG,
) -> DataFrame:
    """Batch rows to insert: unknown to the store, first of their url and content hash.

    Both decisions are made on (order, url, content_hash); whole rows are shuffled once.
    The batch is read twice and should be a written table where it is costly to compute.
    """
    keys = batch.select(order, "url", "content_hash")
    if store is not None:
        keys = not_in_store(keys, store, config=config)
    kept = kept_order_values(keys, "url", "content_hash", order, config=config)
    return batch.join(kept, order, "left_semi")
