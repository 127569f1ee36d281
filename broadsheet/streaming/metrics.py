"""Windowed per-source metrics over a stream of scored articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broadsheet.operators.metrics import metric_parts, merged_metrics
from broadsheet.sources.tables import read_if_exists, read_table


def start_windowed_metrics(
    scored: DataFrame, time: str, threshold: float, path: str, checkpoint: str,
    width: str = "6 hours", roll_every: int = 32,
) -> StreamingQuery:
    """Add the partial sums of each micro-batch to a table and stop at the stream's end.

    A batch is summed up by (window, source, category) and owns the partition
    ``batch_id=N``, which it overwrites, so running it again changes nothing. No state is
    kept: late rows of any age count, and windows that are still open are there as well.
    After every ``roll_every`` batches those before the current one are rolled up
    (:func:`roll_up`), so readers meet at most that many batches' parts and one table.
    """

    def sum_batch(batch: DataFrame, batch_id: int) -> None:
        window = F.window(time, width)
        parts = metric_parts(
            batch.withColumn("_w", window).select(
                F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("_w.end").cast("timestamp_ntz").alias("window_end"),
                F.col(time).cast("timestamp_ntz").alias("_ts"),
                "source", "category", "eu_relevance", "quality_score",
            ),
            ["window_start", "window_end", "source"], threshold, F.max("_ts").alias("last"),
        )
        parts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if batch_id and batch_id % roll_every == 0:
            roll_up(batch.sparkSession, path, batch_id)

    return (
        scored.writeStream.foreachBatch(sum_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


PARTS = (
    "window_start TIMESTAMP_NTZ, window_end TIMESTAMP_NTZ, source STRING, category STRING, "
    "n BIGINT, passed BIGINT, eu_sum DECIMAL(28,6), eu_n BIGINT, q_sum DECIMAL(28,6), q_n BIGINT, "
    "last TIMESTAMP_NTZ, batch_id BIGINT"
)


def _rolled(spark: SparkSession, path: str) -> int | None:
    """The batch up to which the newest finished roll-up goes (it counts only earlier ones)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_rolled/upto=*/_SUCCESS")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=None)


def read_parts(spark: SparkSession, path: str) -> DataFrame | None:
    """All partial sums: the newest roll-up, and the parts of batches from there on."""
    upto = _rolled(spark, path)
    parts = read_if_exists(spark, path, PARTS)
    if parts is None or upto is None:
        return parts
    rolled = read_table(spark, f"{path}/_rolled/upto={upto}", PARTS)
    return parts.filter(F.col("batch_id") >= upto).unionByName(rolled)


def roll_up(spark: SparkSession, path: str, before: int) -> None:
    """Merge the parts of all batches earlier than ``before`` into one table.

    Batches that can still be run again, the current one, stay as they are. The new roll-up
    takes effect with its ``_SUCCESS`` file; the parts it holds and the one before it go
    afterwards, and readers pass over them until then.
    """
    old = _rolled(spark, path)
    if old is not None and old >= before:
        return
    parts = read_parts(spark, path).filter(
        (F.col("batch_id") < before) | F.col("batch_id").isNull())
    keys = ["window_start", "window_end", "source", "category"]
    sums = [F.sum(c).cast(kind).alias(c) for c, kind in (
        ("n", "bigint"), ("passed", "bigint"), ("eu_sum", "decimal(28,6)"), ("eu_n", "bigint"),
        ("q_sum", "decimal(28,6)"), ("q_n", "bigint"))]
    merged = parts.groupBy(*keys).agg(*sums, F.max("last").alias("last")).withColumn(
        "batch_id", F.lit(None).cast("bigint"))
    merged.write.mode("overwrite").parquet(f"{path}/_rolled/upto={before}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [f"{path}/batch_id={k}" for k in range(old or 0, before)]
    for folder in gone + ([f"{path}/_rolled/upto={old}"] if old is not None else []):
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def windowed_metrics(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame | None:
    """Articles, relevant articles, mean scores and categories per window and source.

    ``final`` says that the latest article seen is at least ``delay`` past the window's end.
    """
    parts = read_parts(spark, path)
    if parts is None:
        return None
    latest = parts.agg(F.max("last").alias("latest"))
    merged = merged_metrics(parts, ["window_start", "window_end", "source"])
    return merged.crossJoin(F.broadcast(latest)).withColumn(  # a single row
        "final", F.col("window_end") <= F.col("latest") - F.expr(f"INTERVAL {delay}")
    ).drop("latest")
