"""Evaluation sets and classifier metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions.text import blank, preview
from broadsheet.operators.budget import total_before
from broadsheet.schemas import EVAL_CLASSES
from broadsheet.session import materialize


def sample_key(seed: int):
    return F.md5(F.concat(F.lit(str(seed)), F.col("url")))


# hex digits of a key that make its bin: 4,096 bins
BIN_DIGITS = 3


def smallest(rows: DataFrame, order: str, wanted: DataFrame | int, group: str | None = None) -> DataFrame:
    """Of each group's rows the first ones by (``_key``, ``order``).

    ``_key`` is a hex hash. ``wanted`` says how many rows, as a number or as (group, _n).
    A histogram of the keys' first digits tells which bins are taken whole and which one is
    cut; only rows of that one are ranked, by ranges of the order, so neither a large ``_n``
    nor a large group is sorted in one place. ``rows`` should be a written table.
    """
    by = [group] if group else []
    if isinstance(wanted, int):
        wanted = rows.sparkSession.range(1).select(F.lit(wanted).cast("bigint").alias("_n"))
    binned = rows.withColumn("_bin", F.substring("_key", 1, BIN_DIGITS))
    upto = F.sum("_count").over(W.partitionBy(*by).orderBy("_bin"))  # a row per bin
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_count")).withColumn("_upto", upto)
    bins = bins.join(wanted, by) if by else bins.crossJoin(F.broadcast(wanted))  # one row
    below = F.col("_upto") - F.col("_count")
    bins = bins.filter(below < F.col("_n")).select(
        *by, "_bin", (F.col("_n") - below).alias("_need"), (F.col("_upto") > F.col("_n")).alias("_cut"))
    met = binned.join(bins, [*by, "_bin"])
    ranked = total_before(
        met.filter("_cut").select(order, *by, "_key", "_need"), F.lit(1), by, ["_key", order], "_rank")
    first = ranked.filter("_rank < _need").select(order)
    return met.filter("NOT _cut").select(rows.columns).unionByName(
        rows.join(first, order, "left_semi"))


def stratified_sample(
    articles: DataFrame,
    n: int,
    short_chars: int = 500,
    short_share: float = 0.3,
    seed: int = 42,
    order: str = "seq",
) -> DataFrame:
    """``n`` articles, proportional per source and with a minimum share of short ones.

    Every source gives max(1, its share of n) articles, chosen by a seeded hash. Too
    many are cut, missing ones are filled up from the rest, and long articles are
    swapped for short ones until the share is met or the supply ends.

    Only the keys travel, and every cut is made by :func:`smallest`, so ``n`` may be of any
    size. An article without a source is taken only to fill up.
    """
    if n < 1:
        raise ValueError("n must be positive")
    is_short = F.coalesce(F.length("content"), F.lit(0)) < short_chars
    keys = articles.select(order, "source", sample_key(seed).alias("_key"), is_short.alias("_short"))
    # the lengths of all texts are taken once
    keys = materialize(keys.withColumn("_key", F.coalesce("_key", F.lit("g"))), "sample-keys")

    sizes = keys.groupBy("source").agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total")).scalar()
    quota = F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("_size") / total, 0).cast("bigint"))
    quotas = sizes.filter("source IS NOT NULL").select("source", quota.alias("_n"))
    picked = materialize(smallest(keys, order, quotas, "source"), "sample-picked")
    found = picked.count()
    if found > n:
        taken = smallest(picked, order, n)
    else:
        rest = materialize(keys.join(picked.select(order), order, "left_anti"), "sample-rest")
        taken = picked.unionByName(smallest(rest, order, n - found)) if found < n else picked
    taken = materialize(taken, "sample-taken")

    row = taken.agg(F.count_if("_short").alias("short"), F.count_if(~F.col("_short")).alias("long")).first()
    missing = int(n * short_share // 1) - row.short
    others = materialize(
        keys.filter("_short").join(taken.select(order), order, "left_anti"), "sample-short"
    ) if missing > 0 else None
    swaps = max(0, min(missing, others.count(), row.long)) if others is not None else 0
    if swaps:
        long_ones = materialize(taken.filter("NOT _short"), "sample-long")
        taken = (
            taken.filter("_short").unionByName(smallest(long_ones, order, row.long - swaps))
            .unionByName(smallest(others, order, swaps))
        )
    # written, so that its real size decides the kind of join
    return articles.join(materialize(taken.select(order), "sample-chosen"), order, "left_semi")


def sample_remainder(articles: DataFrame, sample: DataFrame, order: str = "seq") -> DataFrame:
    """The articles that are not in the sample.

    The sample's keys are written first: their real size then decides the kind of join.
    """
    return articles.join(materialize(sample.select(order), "sample"), order, "left_anti")


def eval_rows(compared: DataFrame) -> DataFrame:
    """Rows of the evaluation set with empty columns for the human labels.

    Expects url, title, source, content, keyword_category and the model_* columns.
    """
    empty = F.lit("")
    return compared.select(
        "url",
        "title",
        "source",
        preview(F.col("content"), 200).alias("content_preview"),
        "keyword_category",
        F.col("model_category").alias("llm_category"),
        F.col("model_country").alias("llm_country"),
        F.coalesce(F.col("model_eu_relevance").cast("string"), empty).alias("llm_eu_relevance"),
        empty.alias("human_category"),
        empty.alias("human_country"),
        empty.alias("human_eu_relevance"),
        empty.alias("notes"),
    )


def labeled_only(rows: DataFrame, column: str = "human_category") -> DataFrame:
    return rows.filter(~blank(F.col(column)))


def join_labels(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Predictions with the human label of the same key."""
    return predictions.join(labels, key)


def class_metrics(
    rows: DataFrame, prediction: str, truth: str, classes: Sequence[str] = EVAL_CLASSES
) -> DataFrame:
    """Precision, recall, F1 (three decimals) and support of every class.

    One pass: the counts of all classes are aggregated side by side into one row, so a
    class that never occurs is still reported.
    """
    said, true = F.col(prediction), F.col(truth)
    counts = []
    for i, name in enumerate(classes):
        counts += [
            F.count_if((said == name) & (true == name)).alias(f"tp{i}"),
            F.count_if((said == name) & ~true.eqNullSafe(F.lit(name))).alias(f"fp{i}"),
            F.count_if((true == name) & ~said.eqNullSafe(F.lit(name))).alias(f"fn{i}"),
        ]
    per_class = F.array(*[
        F.struct(
            F.lit(name).alias("class"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
            F.col(f"fn{i}").alias("fn"),
        )
        for i, name in enumerate(classes)
    ])
    table = rows.agg(*counts).select(F.inline(per_class))
    zero = F.lit(0.0)
    table = table.withColumns(
        {
            "_p": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), zero),
            "_r": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), zero),
        }
    )
    f1 = F.coalesce(
        F.try_divide(F.lit(2.0) * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), zero
    )
    return table.select(
        "class",
        F.round("_p", 3).alias("precision"),
        F.round("_r", 3).alias("recall"),
        F.round(f1, 3).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def macro_f1(metrics: DataFrame, target: float) -> DataFrame:
    """Mean of the rounded F1 of the classes that occur, and whether it meets the target."""
    mean = F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0))
    return metrics.agg(F.round(mean, 3).alias("macro_f1")).withColumn(
        "passed", F.col("macro_f1") >= F.lit(target)
    )


def confusion_matrix(
    rows: DataFrame, prediction: str, truth: str, classes: Sequence[str] = EVAL_CLASSES
) -> DataFrame:
    """Rows are true classes, columns predicted ones; labels outside the list are left out."""
    counts = [
        F.count_if((F.col(truth) == t) & (F.col(prediction) == p)).alias(f"c{i}_{j}")
        for i, t in enumerate(classes)
        for j, p in enumerate(classes)
    ]
    lines = F.array(*[
        F.struct(
            F.lit(t).alias("truth"),
            *[F.col(f"c{i}_{j}").alias(p) for j, p in enumerate(classes)],
        )
        for i, t in enumerate(classes)
    ])
    return rows.agg(*counts).select(F.inline(lines))


def agreement(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Matching rows, all rows and the whole percentage (NULL for no rows)."""
    same = F.count_if(F.col(left) == F.col(right))
    return rows.agg(same.alias("matches"), F.count("*").alias("total")).withColumn(
        "percent", F.floor(F.try_divide(F.col("matches") * 100, F.col("total"))).cast("bigint")
    )


def label_distribution(rows: DataFrame, labelers: dict[str, str]) -> DataFrame:
    """Labels and their counts per labeler; ``labelers`` maps a name to its column."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("labeler"), F.col(column).alias("label"))
        for name, column in labelers.items()
    ])
    return (
        rows.select(F.inline(pairs)).groupBy("labeler", "label").agg(F.count("*").alias("articles"))
    )


def disagreements(rows: DataFrame, left: str, right: str, shown: int = 15,
                  order: str = "seq") -> DataFrame:
    """The first rows on which two labelers differ, each with the number not shown."""
    differ = rows.filter(~F.col(left).eqNullSafe(F.col(right)))
    total = differ.agg(F.count("*").alias("n")).scalar()
    first = differ.orderBy(order).limit(shown)
    return first.select(
        order,
        preview(F.col("title"), 50).alias("title"),
        left,
        right,
        F.greatest(F.lit(0).cast("bigint"), total - F.lit(shown)).alias("not_shown"),
    )
