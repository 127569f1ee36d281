"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import materialize


def components(links: DataFrame, label: str) -> DataFrame:
    """(id, root): for every id of ``links`` (a, b) the smallest one it is linked with.

    Rounds of two aggregations over the links: first each node sends its larger neighbours to
    the smallest node it sees, then its smaller ones. Paths shrink by a factor a round, so a
    chain of n links takes about log n rounds, and less where ids are spread at random (hashes
    are). A round is a written table: a lost executor costs a re-read.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-links",
    )
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(
            F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialize(large, f"{label}-large")
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(lowest, "a").where("b <> low")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()
        )
        edges = materialize(small, f"{label}-small")
