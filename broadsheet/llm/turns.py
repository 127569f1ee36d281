"""Turns of conversations in order, with running values that no single task holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import shuffle_width
from broadsheet.session import materialize

RANGE = "_range"


def in_ranges(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` written in ranges of (conv_id, order), marked by number; equal rows share one."""
    return materialize(
        rows.repartitionByRange(shuffle_width(rows.sparkSession), "conv_id", *order)
        .withColumn(RANGE, F.spark_partition_id()), label,
    )


def split_conversations(ranged: DataFrame) -> DataFrame:
    """conv_id of the conversations that lie in several ranges: at most one per range."""
    borders = ranged.groupBy(RANGE).agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    return (
        borders.withColumn("next", F.lead("lo").over(Window.orderBy(RANGE)))  # a row per range
        .where("next = hi").select(F.col("hi").alias("conv_id")).distinct()
    )


def running(
    ranged: DataFrame, order: list[str], aggregate: Callable[[Column], Column], value: Column,
    name: str,
) -> DataFrame:
    """``ranged`` with ``name``: the aggregate over this and all earlier turns of the
    conversation.

    ``aggregate`` is ``F.sum`` or ``F.bit_xor``. A conversation in one range is done by a
    window over its rows there. For those in several, what each range adds up to is carried
    into the next ones: two rows per range at most, so these are broadcast.
    """
    join = F.bit_xor if aggregate is F.bit_xor else F.sum
    rows = ranged.withColumn("_v", value)
    parts = (
        rows.join(F.broadcast(split_conversations(ranged)), "conv_id")  # one row per range
        .groupBy("conv_id", RANGE).agg(aggregate("_v").alias("_part"))
    )
    earlier = Window.partitionBy("conv_id").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", RANGE, join("_part").over(earlier).alias("_carried"))
    within = Window.partitionBy(RANGE, "conv_id").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    carry, own = F.coalesce("_carried", F.lit(0)), aggregate("_v").over(within)
    return (
        rows.join(F.broadcast(carried), ["conv_id", RANGE], "left")  # two rows per range
        .withColumn(name, own.bitwiseXOR(carry) if aggregate is F.bit_xor else own + carry)
        .drop("_v", "_carried")
    )
