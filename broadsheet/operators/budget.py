"""Token budgets: running totals over calls in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.session import materialize


def total_before(
    df: DataFrame, value: Column, group: list[str], order: list[str], out: str
) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of the same group.

    Rows are cut into ranges of (group, order) of about equal numbers, whatever the values
    are. Sums run up within each range, and what the ranges before it hold of the same group
    is added: one row per group and range. So a group of any size is spread over many tasks.
    ``order`` names a unique key within a group; give narrow rows.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.withColumn("_value", F.coalesce(value, F.lit(0)))
        .repartitionByRange(width, *group, *order)
        .withColumn("_range", F.spark_partition_id()), "ranges",
    )
    earlier = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    )
    # null-safe, as a group may be NULL
    left, right = ranged.alias("l"), starts.alias("r")
    condition = F.col("l._range") == F.col("r._range")
    for c in group:
        condition = condition & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    within = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        left.join(right, condition).select("l.*", "r._start")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_range", "_value", "_start")
    )


def usage_total(tokens_in: Column, tokens_out: Column) -> Column:
    return F.coalesce(tokens_in, F.lit(0)) + F.coalesce(tokens_out, F.lit(0))


def remaining_budget(used: Column, cap: int) -> Column:
    """Tokens left, -1 for an unlimited budget."""
    return F.lit(-1).cast("bigint") if cap == 0 else F.greatest(F.lit(0), F.lit(cap) - used)


def budget_gate(
    calls: DataFrame,
    cap: int,
    tokens: Column,
    group: list[str],
    order: list[str],
) -> DataFrame:
    """Add ``tokens_before``, ``allowed`` and ``tokens_left`` to calls in order.

    A call is allowed while the tokens of all calls before it stay below the cap; a cap
    of 0 never ends. Tokens are not negative, so once the cap is reached it stays
    reached, and it makes no difference that calls after that point count as well.
    """
    gated = total_before(calls, tokens, group, order, "tokens_before")
    allowed = F.lit(True) if cap == 0 else F.col("tokens_before") < cap
    return gated.withColumn("allowed", allowed).withColumn(
        "tokens_left", remaining_budget(F.col("tokens_before"), cap)
    )
