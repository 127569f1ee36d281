"""The keys of a growing store in hash buckets: a batch looks into its own buckets only.

The index lies beside the store's partitions, in ``_keys/tier=T/bucket=B``. A batch adds a
file to each bucket it has keys for, in tier 0. When a tier has had ``merge_every`` additions,
its files are merged into one per bucket of the next tier and it is emptied. So a key is
rewritten once per tier, whose number is the logarithm of the number of batches, and a bucket
has a bounded number of files per tier. A merge that fails half-way leaves keys twice, which
changes no answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import materialize
from broadsheet.sources.tables import read_if_exists

INDEX = "kind STRING, key STRING, batch_id BIGINT, tier INT, bucket INT"


def index_path(store_path: str) -> str:
    return f"{store_path}/_keys"  # Spark's readers skip folders that begin with an underscore


def keys_of(rows: DataFrame, buckets: int) -> DataFrame:
    """(seq, kind, key, bucket) of rows with seq, url and content_hash: two keys each."""
    pair = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(column).alias("key"))
        for kind, column in (("url", "url"), ("hash", "content_hash"))
    ])
    return rows.select("seq", F.inline(pair)).filter("key IS NOT NULL").withColumn(
        "bucket", F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int"))


def known_in(
    spark: SparkSession, path: str, keys: DataFrame, batch_id: int
) -> DataFrame | None:
    """The index's keys in the buckets that ``keys`` has, but for those of the batch itself.

    The bucket numbers, at most as many as there are buckets, become a partition filter.
    """
    index = read_if_exists(spark, path, INDEX)
    if index is None:
        return None
    touched = [r.bucket for r in keys.select("bucket").distinct().collect()]
    return index.filter(F.col("bucket").isin(touched) & (F.col("batch_id") != F.lit(batch_id)))


def unknown_rows(
    spark: SparkSession, path: str, rows: DataFrame, buckets: int, batch_id: int
) -> DataFrame:
    """Rows of (seq, url, content_hash) that the index knows by neither key."""
    keys = materialize(keys_of(rows, buckets), "batch-keys")
    known = known_in(spark, path, keys, batch_id)
    if known is None:
        return rows
    met = keys.join(known.select("kind", "key"), ["kind", "key"], "left_semi").select("seq")
    return rows.join(met.distinct(), "seq", "left_anti")


def add_keys(rows: DataFrame, path: str, buckets: int, batch_id: int, tier: int = 0) -> None:
    """Append the keys of stored rows, a file per bucket."""
    keys = keys_of(rows, buckets).select("kind", "key", F.lit(batch_id).cast("bigint").alias("batch_id"), "bucket")
    keys.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/tier={tier}")


def merge_full_tiers(spark: SparkSession, path: str, merge_every: int, additions: int) -> int:
    """Merge each tier that is full after that many ``additions``; how many were."""
    tier, merged = 0, 0
    while additions and additions % merge_every == 0:
        rows = read_if_exists(spark, f"{path}/tier={tier}", "kind STRING, key STRING, batch_id BIGINT, bucket INT")
        if rows is not None:
            kept = materialize(rows.distinct(), "merged-keys")
            kept.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode(
                "append").partitionBy("bucket").parquet(f"{path}/tier={tier + 1}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tier={tier}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            merged += 1
        tier, additions = tier + 1, additions // merge_every
    return merged
