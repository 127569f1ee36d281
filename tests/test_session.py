from __future__ import annotations

import os

import pytest

from broadsheet.session import drop_scratch, materialize, scratch_scope, shared_folder, spread


def test_scratch_lives_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    table = materialize(spark.range(5), "numbers")
    assert table.count() == 5 and all(folder in f for f in table.inputFiles())
    drop_scratch(spark)
    assert not os.listdir(os.path.join(folder, "broadsheet"))


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    wide = spark.range(10).repartition(9)
    assert spread(wide) is wide


def test_scratch_of_a_scope_goes_with_it_also_after_a_failure(spark):
    kept = materialize(spark.range(3), "kept")
    try:
        with scratch_scope(spark):
            inner = materialize(spark.range(4), "inner").inputFiles()[0]
            raise RuntimeError
    except RuntimeError:
        pass
    assert kept.count() == 3 and not os.path.exists(inner.removeprefix("file:").replace("///", "/"))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared_folder(Session())
