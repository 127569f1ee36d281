"""I-Match fingerprints: hashes of a text's mid-frequency terms under random lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import running_total, shuffle_width, small
from broadsheet.session import materialize

BREAKS = r"[^\p{L}\p{N}]+"
# Terms in the band are in at least this share of documents and in at most that one.
LEAST_SHARE, MOST_SHARE = 0.001, 0.1
# Three granularities of 32 subsets: a term is in a subset with chance 2**-4, 2**-7, 2**-10.
LEVELS = (4, 7, 10)
SUBSETS = 32
HASH = 1 << 24
EVIDENCE = 8
# Texts with fewer terms in the band are compared by all their terms.
FEW = 16


def terms_of(text: Column) -> Column:
    """Distinct terms: runs of letters and digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), BREAKS), lambda t: t != ""))


def member(h: Column) -> Column:
    """The subsets that a term is in, by the term's hash."""
    numbered = F.sequence(F.lit(0), F.lit(SUBSETS * len(LEVELS) - 1))
    odds = F.array(*[F.lit(2**bits) for bits in LEVELS])
    return F.filter(
        numbered,
        lambda k: F.pmod(F.xxhash64(h, k), F.element_at(odds, (k / SUBSETS).cast("int") + 1)) == 0,
    )


def learn_lexicon(
    docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE
) -> DataFrame:
    """(h, nth, subset) of all terms in the band, from the document frequencies of all ``docs``.

    The band is relative to the number of documents, so the lexicon holds at most (mean
    number of distinct terms) / ``least`` terms however many documents there are.
    """
    total = docs.count()
    low, high = max(2, least * total), max(2, most * total)
    band = (
        docs.select(F.explode(terms_of(F.col("text"))).alias("term"))
        .groupBy(F.xxhash64("term").alias("h")).agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df").between(low, high)).select("h")
    )
    return materialize(
        band.select("h", F.posexplode(member(F.col("h"))).alias("nth", "subset")), "imatch-lexicon"
    )


def fingerprints(texts: DataFrame, lexicon: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys``, side, marks, n: the subset hashes of each text and how many of its terms
    they are made of. Without a lexicon all terms count.

    ``texts`` has ``keys`` and ``sides``, an array of texts; the side is a text's place in it.
    A mark is a number made of the subset and 24 bits of a hash of its terms in the text;
    sorting the distinct terms is spared by a hash that doesn't depend on their order. A text's terms lie in one task, so
    they are folded into its few marks before anything is shuffled.
    """
    terms = texts.select(*keys, F.posexplode("sides").alias("side", "text")).select(
        *keys, "side", F.explode_outer(terms_of(F.col("text"))).alias("term")
    ).select(*keys, "side", F.xxhash64("term").alias("h"))
    mark = (F.col("subset") * F.lit(HASH) + F.pmod("x", F.lit(HASH))).cast("int")
    if lexicon is None:
        met = terms.select(*keys, "side", "h", F.posexplode_outer(member(F.col("h"))).alias("nth", "subset"))
    else:
        met = terms.join(small(lexicon), "h", "left")
    return (
        met.groupBy(*keys, "side", "subset").agg(
            F.bit_xor(F.xxhash64("h")).alias("x"), F.count_if(F.col("nth") == 0).alias("n")
        )
        .groupBy(*keys, "side")
        .agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("subset").isNotNull(), mark))).alias("marks"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing subsets, 0 to 1, of two arrays of marks; null if both are empty.

    Subsets without a term of either text say nothing. Of the granularities the finest one
    with at least ``EVIDENCE`` telling subsets is read, else the coarsest.
    """
    def at(level: int) -> tuple[Column, Column]:
        low, high = level * SUBSETS * HASH, (level + 1) * SUBSETS * HASH
        mine = F.filter(a, lambda m: m.between(low, high - 1))
        theirs = F.filter(b, lambda m: m.between(low, high - 1))
        names = F.array_union(F.transform(mine, lambda m: F.shiftright(m, 24)),
                              F.transform(theirs, lambda m: F.shiftright(m, 24)))
        return F.size(F.array_intersect(mine, theirs)), F.size(names)

    (ca, na), (cb, nb), (cc, nc) = at(0), at(1), at(2)
    return (
        F.when(nc >= EVIDENCE, cc / nc).when(nb >= EVIDENCE, cb / nb).when(na > 0, ca / na)
        .when(nb > 0, cb / nb).when(nc > 0, cc / nc)
    )


def edited_sides(base: DataFrame, pairs: DataFrame) -> DataFrame:
    """rk, edited_sha256, own, edit, sides: each text of ``pairs`` and its edited text."""
    # texts are dealt out once; both joins read that exchange
    dealt = base.select("rk", "text").repartition(shuffle_width(base.sparkSession), "rk")
    heads = pairs.select("rk", "next_rk", F.floor(F.col("n") / 4).cast("int").alias("k")).join(
        dealt.select(F.col("rk").alias("next_rk"), F.col("text").alias("next_text")), "next_rk"
    ).select("rk", F.substring("next_text", F.lit(1), F.col("k")).alias("head"), "k")
    return dealt.join(heads, "rk").dropDuplicates(["rk"]).select(
        "rk",
        F.array("text", F.concat(
            F.substring("text", F.lit(1), F.length("text") - F.col("k")), F.col("head")
        )).alias("sides"),
    ).select(
        "rk", F.sha2(F.col("sides")[1], 256).alias("edited_sha256"),
        F.xxhash64(F.col("sides")[0]).alias("own"), F.xxhash64(F.col("sides")[1]).alias("edit"),
        "sides",
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text of a document is its text with the last quarter of its code points
    replaced by the first as many of the next document by doc_id (the first one after the
    last). The lexicon comes from the unedited texts. Two texts of which one has fewer than
    ``FEW`` terms in the band are compared by the subsets of all their terms, and such a text's
    fingerprint has these marks too. A text without a term in any subset has a hash of itself
    as fingerprint, and is like another only if those agree.

    A null text is empty. Equal rows count as one document and give equal rows; rows that
    share a doc_id follow each other by a hash of their texts, a null doc_id comes first. A
    single document is its own next one. An empty table gives no rows; other columns are
    ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "rk", F.xxhash64("doc_id", "text")
    )
    narrow = base.groupBy("doc_id", "rk", F.length("text").alias("n")).agg(
        F.count(F.lit(1)).alias("rows")
    ).withColumn("one", F.lit(1).cast("long"))
    placed = materialize(running_total(narrow, ["doc_id", "rk"], "one", "imatch-order"), "imatch-place")
    total = placed.count()
    after = placed.select(F.col("before").alias("next_place"), F.col("rk").alias("next_rk"))
    pairs = materialize(
        placed.withColumn("next_place", (F.col("before") + 1) % max(total, 1))
        .join(after, "next_place").select("doc_id", "rk", "n", "rows", "next_rk"), "imatch-next"
    )
    keys = ["rk", "edited_sha256", "own", "edit"]
    first = materialize(
        fingerprints(edited_sides(base, pairs), learn_lexicon(base), keys).groupBy(*keys).agg(
            F.max(F.when(F.col("side") == 0, F.col("marks"))).alias("marks"),
            F.max(F.when(F.col("side") == 1, F.col("marks"))).alias("edited"),
            F.max(F.when(F.col("side") == 0, F.col("n"))).alias("band"),
            F.max(F.when(F.col("side") == 1, F.col("n"))).alias("edited_band"),
        ), "imatch-prints",
    )
    # the second level: documents with a text of few terms in the band, and their neighbours
    few = materialize(
        first.where(F.least("band", "edited_band") < FEW).select("rk").distinct(), "imatch-few"
    )
    short = first.where(F.col("band") < FEW).select(F.col("rk").alias("next_rk"))
    wanted = materialize(
        few.unionByName(pairs.join(small(few), "rk", "left_semi").select(F.col("next_rk").alias("rk")))
        .unionByName(pairs.join(short, "next_rk", "left_semi").select("rk")).distinct(),
        "imatch-wanted",
    )
    again = materialize(pairs.join(wanted, "rk", "left_semi"), "imatch-again")
    needed = materialize(
        again.select("rk").unionByName(again.select(F.col("next_rk").alias("rk"))).distinct(),
        "imatch-needed",
    )
    second = materialize(
        fingerprints(
            edited_sides(base.join(small(needed), "rk", "left_semi"), again), None, keys
        ).groupBy("rk").agg(
            F.max(F.when(F.col("side") == 0, F.col("marks"))).alias("all_marks"),
            F.max(F.when(F.col("side") == 1, F.col("marks"))).alias("all_edited"),
        ), "imatch-second",
    )
    prints = materialize(first.join(second, "rk", "left"), "imatch-both")
    # the next document's marks travel to their reader; everything else stays by rk
    following = prints.select(F.col("rk").alias("next_rk"), F.col("marks").alias("next_marks"),
                              F.col("own").alias("next_own"), F.col("band").alias("next_band"),
                              F.col("all_marks").alias("next_all"))
    met = pairs.join(following, "next_rk").drop("next_rk")

    def printed(found: Column, whole: Column, n: Column, every: Column) -> Column:
        shown = F.when(n < FEW, F.concat(found, F.transform(every, lambda m: -m - 1))).otherwise(found)
        return F.when(
            F.size(shown) > 0, F.array_join(F.transform(shown, lambda m: F.lower(F.hex(m))), " ")
        ).otherwise(F.concat(F.lit("t"), F.lower(F.hex(whole))))

    def near(found: Column, whole: Column, n: Column, every: Column) -> Column:
        """Without marks on either side, equal texts are alike."""
        return F.coalesce(
            F.when(F.least("band", n) < FEW, likeness(F.col("all_marks"), every))
            .otherwise(likeness(F.col("marks"), found)),
            (F.col("own") == whole).cast("double"),
        )

    return (
        met.join(prints, "rk")
        .select(
            "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256",
            printed(*map(F.col, ("marks", "own", "band", "all_marks"))).alias("fingerprint"),
            printed(*map(F.col, ("edited", "edit", "edited_band", "all_edited")))
            .alias("edited_fingerprint"),
            near(*map(F.col, ("edited", "edit", "edited_band", "all_edited"))).alias("near_edited"),
            near(*map(F.col, ("next_marks", "next_own", "next_band", "next_all"))).alias("near_next"),
            F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
        ).drop("_row")
    )
