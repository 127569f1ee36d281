"""Parquet tables and CSV files the engine reads and appends to."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.schemas import EVAL_ROW, SOURCE_METRIC, TELEMETRY

_CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
ARTICLE_CSV = (
    "id STRING, url STRING, title STRING, source STRING, category STRING, country STRING, "
    "content STRING, summary STRING, published_date STRING"
)


def read_articles_csv(spark: SparkSession, path: str, columns: str = ARTICLE_CSV) -> DataFrame:
    """A CSV export with declared columns; an empty string field is '', never NULL."""
    return spark.read.options(**_CSV).schema(columns).csv(path).na.fill("")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return read_articles_csv(spark, path, EVAL_ROW)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header; quotes are doubled so that any text survives a round trip."""
    df.write.mode(mode).options(
        header="true", quote='"', escape='"', ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false",
    ).csv(path)


def append_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Write what one run adds to a table, as the partition ``run_id=...`` that the run owns.

    Written again, it replaces itself, so a run that is repeated after a failure leaves the
    table as if it had run once. Tables are read with a schema that names ``run_id STRING``.
    """
    folder = f"{path}/run_id={quote(run_id, safe='')}"
    df.drop("run_id").write.mode("overwrite").parquet(folder)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with its declared schema; columns that old files lack read as NULL."""
    return spark.read.schema(schema).parquet(path)


def read_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return read_table(spark, path, schema) if files.exists(location) else None


def _as(df: DataFrame, schema: str) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def write_run_metrics(metrics: DataFrame, path: str, run_id: str) -> None:
    write_run(_as(metrics, SOURCE_METRIC), path, run_id)


def write_run_telemetry(calls: DataFrame, path: str, run_id: str) -> None:
    write_run(_as(calls, TELEMETRY), path, run_id)


def append_metrics(metrics: DataFrame, path: str) -> None:
    append_table(_as(metrics, SOURCE_METRIC), path)


def append_telemetry(calls: DataFrame, path: str) -> None:
    append_table(_as(calls, TELEMETRY), path)
