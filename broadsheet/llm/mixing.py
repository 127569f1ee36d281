"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm.common import WORD
from broadsheet.session import materialize

BINS = 65536
UNIT = 2**52


def words_of(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the id alone, so that reruns agree."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(UNIT))


def _digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def rank_name() -> Column:
    """What a document's random number is drawn from: its id, or its text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), _digest()))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` by turns and share ``share`` of all
    sizes; a target stops at ``most`` times its source, and what is over goes to the others by
    weight. In closed form: with sources ordered by bound per weight, those that are bound
    come first, and the rest share what the bound ones leave. One row per source, not per
    document.
    """
    turn = F.array(*[F.lit(w) for w in weights])
    in_order = Window.orderBy(F.col("source").isNull(), "source")
    by_bound = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(),
                              "source")
    earlier = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = sizes.withColumn(
        "weight", F.element_at(turn, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    ).withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(share),
        "bound": F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0)),
        "left": F.sum("weight").over(everything)
                - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
    }).withColumn("level", (F.col("total") - F.col("bound")) / F.col("left"))
    free = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    # the first source that its level doesn't bind sets the level of all after it
    return rows.withColumn("rank", F.row_number().over(by_bound)).withColumn(
        "final", F.min(F.when(free.isNotNull(), F.struct("rank", "level"))).over(everything)
    ).select(
        "source", "source_size",
        F.when(F.col("rank") >= F.col("final.rank"), F.col("final.level") * F.col("weight"))
        .otherwise((most * F.col("source_size")).cast("double")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """``docs`` plus size, source_size, target, copies and taken; all its columns stay.

    A source whose target is r times its size gives floor(r) certain copies of each document.
    The rest is a fixed-size Pareto sample: with inclusion share p = r - floor(r), a document
    ranks by its random odds u / (1 - u) divided by p / (1 - p), and documents are taken in
    rank order as long as half of the next one still fits. Within a source that is the order
    of u, so sizes are summed by source and by ``BINS`` equal bins of u on the map side; only
    the rows of the one bin in which a source's sample ends are ranked one by one.

    A null text has size 0. Null sources are one source, the last. Rows that share an
    id have the same u and are ranked by size, then by a digest of their text; a row without an
    id has the u of its text. So a rerun takes the same texts. Empty tables give none. Columns of ``docs`` named like a new one are replaced.
    """
    rows = docs.withColumns({"size": words_of(F.col("text")), "_u": uniform(rank_name())})
    rows = rows.withColumn("_bin", F.floor(F.col("_u") * BINS))
    histogram = materialize(
        rows.groupBy("source", "_bin").agg(F.sum("size").alias("size")), "mix-bins"
    )
    targets = source_targets(
        histogram.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
    ).withColumn(
        "_whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0))
    ).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ends = (
        histogram.withColumn("_upto", F.sum("size").over(upto))
        .join(targets.select(F.col("source").alias("_s"), "_rest"), F.expr("source <=> _s"))
        .where(F.col("_upto") > F.col("_rest"))
        .groupBy(F.col("source").alias("_e"))
        .agg(F.min(F.struct("_bin", (F.col("_upto") - F.col("size")).alias("_before"))).alias("_end"))
    )
    # one row per source, written so that the planner knows its size before it picks the join
    cuts = materialize(
        targets.join(ends, F.expr("source <=> _e"), "left").drop("_e")
        .withColumnRenamed("source", "_s"), "mix-cuts"
    )
    # The names of a document's own columns never clash: those that are made here go first.
    marked = rows.drop("source_size", "target", "copies", "taken", "_s", "_whole", "_rest", "_end").join(
        cuts, F.expr("source <=> _s")
    )
    place = F.col("_bin") - F.coalesce(F.col("_end._bin"), F.lit(BINS))
    share_left = F.try_divide("_rest", "source_size")
    odds = F.try_divide(
        F.col("_u") / (1 - F.col("_u")), F.try_divide(share_left, 1 - share_left)
    )
    in_end = Window.partitionBy("source").orderBy(odds, "size", _digest()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    last = marked.where(place == 0).withColumn("_upto", F.sum("size").over(in_end)).withColumn(
        "_more",
        (2 * (F.col("_end._before") + F.col("_upto")) - F.col("size") <= 2 * F.col("_rest"))
        .cast("int"),
    ).drop("_upto")
    rest = marked.where(place != 0).withColumn("_more", ((place < 0) & (F.col("_rest") > 0)).cast("int"))
    return (
        rest.unionByName(last)
        .withColumn("copies", (F.col("_whole") + F.coalesce("_more", F.lit(0))).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("_u", "_bin", "_s", "_whole", "_rest", "_end", "_more")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in their own columns."""
    return (
        mix_sources(docs, **how).where("copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*docs.columns)
    )
