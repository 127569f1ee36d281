"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace costly columns so that later filters do not repeat them.

    The optimizer moves a filter below a projection by copying the projected expressions
    into the filter. Over several layers of keyword and score columns the copies multiply,
    in the plan and at run time. It does not do so for expressions it holds to be
    non-deterministic, so the values are wrapped in a condition on the partition id that
    is always true. Columns nobody asks for are still pruned. Filters on other columns
    stay above as well: apply those first.
    """
    always = F.spark_partition_id() >= 0
    return df.withColumns({name: F.when(always, value) for name, value in columns.items()})
