"""Incremental runs: new article files into the store, a micro-batch at a time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.config import DEFAULT_CONFIG, EngineConfig
from broadsheet.operators.dedup import kept_order_values
from broadsheet.operators.store import to_store_rows
from broadsheet.schemas import STORE
from broadsheet.session import materialize, scratch_scope
from broadsheet.sources.tables import read_if_exists
from broadsheet.streaming.keys import (
    INDEX, add_keys, index_path, keys_of, merge_full_tiers, unknown_rows,
)

_STORED = STORE.replace("id BIGINT, ", "seq BIGINT, ") + ", batch_id BIGINT"


def read_stream_store(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_exists(spark, path, _STORED)


def add_batch(
    batch: DataFrame,
    batch_id: int,
    store_path: str,
    as_of: datetime | str | Column,
    buckets: int,
    merge_every: int,
    config: EngineConfig = DEFAULT_CONFIG,
) -> None:
    """Store the unknown articles of one micro-batch as its partition, and their keys."""
    spark, index = batch.sparkSession, index_path(store_path)
    _index_old_store(spark, store_path, buckets)
    rows = materialize(to_store_rows(batch, as_of), "batch")
    narrow = rows.select("seq", "url", "content_hash")
    fresh = unknown_rows(spark, index, narrow, buckets, batch_id)
    kept = kept_order_values(fresh, "url", "content_hash", "seq", config)
    path = f"{store_path}/batch_id={batch_id}"
    rows.join(kept, "seq", "left_semi").write.mode("overwrite").parquet(path)
    add_keys(spark.read.schema(rows.schema).parquet(path), index, buckets, batch_id)
    merge_full_tiers(spark, index, merge_every, batch_id + 1)


def start_ingest(
    articles: DataFrame,
    store_path: str,
    checkpoint: str,
    as_of: datetime | str | Column,
    buckets: int = 256,
    merge_every: int = 16,
    config: EngineConfig = DEFAULT_CONFIG,
) -> StreamingQuery:
    """Store the unknown articles of a stream of scored articles and stop at its end.

    Each micro-batch owns the partition ``batch_id=N`` and overwrites it, and it compares
    with the other partitions only. So a batch that is run again after a failure leaves
    the store as it was. What the store knows is read from its key index (:mod:`.keys`), in
    the buckets that the batch's own keys fall into; the store itself is never read. Set
    ``buckets`` so that a batch of usual size meets a part of them, and keep it for the life
    of a store.
    """
    def store_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            add_batch(batch, batch_id, store_path, as_of, buckets, merge_every, config)

    return (
        articles.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _index_old_store(spark: SparkSession, store_path: str, buckets: int) -> None:
    """Give a store that was written without an index one, in a single job."""
    if read_if_exists(spark, index_path(store_path), INDEX) is None:
        known = read_stream_store(spark, store_path)
        if known is not None:
            # the batch takes the place of seq
            keys = keys_of(known.drop("seq").withColumnRenamed("batch_id", "seq"), buckets)
            keys.select("kind", "key", F.col("seq").alias("batch_id"), "bucket").repartition(
                "bucket").write.partitionBy("bucket").parquet(f"{index_path(store_path)}/tier=1")
