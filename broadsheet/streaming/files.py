"""Running file-to-file streams to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.session import scratch_path


def read_file_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the files of a table: a folder of part files, one file, or a glob.

    A path that matches nothing raises: a stream would wait there without a word.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    if len(found) == 1 and found[0].isFile() and str(found[0].getPath().getName()) == place.getName():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a glob, not a file
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all files present, into the shared folder; return what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, label + "-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
