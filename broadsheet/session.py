"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The folder that scratch goes to; by thread, as each stream runs its batches in its own.
_SCOPE = threading.local()

# What the engine relies on; a cluster's own settings for partitions and memory win.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(
    app: str = "broadsheet", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the engine's settings; keyword arguments add or override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors can reach.

    Read from ``spark.checkpoint.dir``. Only a local session that names none uses a folder of
    this machine; on a cluster each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not folder:
        if not current and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = current or tempfile.mkdtemp(prefix="broadsheet-")
    if current is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/broadsheet/{run}/{getattr(_SCOPE, 'name', '')}{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder.

    For the end of a job: frames that came out of :func:`materialize` are gone after it.
    """
    run = spark.sparkContext.applicationId
    _delete(spark, f"{shared_folder(spark)}/broadsheet/{run}")


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end, also after a failure.

    For one batch of a stream or one run: frames made inside are gone after it.
    """
    context = spark.sparkContext
    outer = getattr(_SCOPE, "name", "")
    _SCOPE.name = name = f"{outer}run-{uuid.uuid4().hex}/"
    try:
        yield
    finally:
        _SCOPE.name = outer
        path = f"{shared_folder(spark)}/broadsheet/{context.applicationId}/{name}"
        _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer splits than cores, dealt out to all cores.

    A small file with one row group would keep a single core busy with its texts. Large
    inputs have more splits than there are cores and come back as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors and lets several sinks share
    one computation.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
