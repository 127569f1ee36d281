"""URL filter: rules by host and path, and a tree of path templates for all other urls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import ascii_lower
from broadsheet.session import materialize

# (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
# two shares differ if the square of their distance exceeds this many variances (95 %, one degree
# of freedom)
CHI_SQUARE = 3.84
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def match_rules(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``pages`` (with host and path) plus ``rule`` and ``rule_verdict``; the longest rule wins.

    A page meets only rules of its host or a parent domain: its host's suffixes are looked up
    in one map held in the plan, whose size is that of the caller's list.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.lower(), []).append((rule, slash + path, verdict))
    entry = "array<struct<rule:string,path:string,verdict:string>>"
    if not by_host:
        none = F.lit(None).cast("string")
        return pages.withColumns({"rule": none, "rule_verdict": none})
    lookup = F.map_from_arrays(
        F.array(*[F.lit(h) for h in by_host]),
        F.array(*[
            F.array(*[
                F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
                for r, p, v in found
            ]).cast(entry) for found in by_host.values()
        ]),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )
    found = F.filter(
        F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(lookup, s)),
                           lambda x: x.isNotNull())),
        lambda r: F.col("path").startswith(r.path),
    )
    best = F.array_max(F.transform(
        found, lambda r: F.struct(F.length(r.rule).alias("len"), r.rule.alias("rule"),
                                  r.verdict.alias("verdict"))
    ))
    return pages.withColumns({"rule": best.rule, "rule_verdict": best.verdict})


def shape_of(path: Column) -> Column:
    """The path with its plainly variable parts replaced: long hex ids and runs of digits."""
    return F.regexp_replace(
        F.regexp_replace(path, r"(^|/)[0-9a-fA-F-]{16,}(?=/|$)", "$1{h}"), r"[0-9]+", "{n}"
    )


def _above(s: Column | str, level: int) -> Column:
    """One string for the segments before ``level``."""
    return F.array_join(F.slice(s, 1, level), "/")


def _generalised(shapes: DataFrame, levels: list[tuple[int, DataFrame]]) -> DataFrame:
    """``shapes`` with ``*`` at the variable places found so far, in order of their levels."""
    for level, places in levels:
        shapes = shapes.withColumn("above", F.when(F.size("s") > level, _above("s", level))).join(
            places, ["host", "above"], "left"
        ).withColumn("s", F.when(
            F.col("variable"), F.transform("s", lambda x, k: F.when(k == level, "*").otherwise(x))
        ).otherwise(F.col("s"))).drop("above", "variable")
    return shapes


def _variable_levels(
    shapes: DataFrame, variable_children: int, variable_support: int
) -> list[tuple[int, DataFrame]]:
    """For each level with variable places: (level, (host, above, variable)).

    A place with fewer than ``variable_children`` shapes below it holds no variable place, so
    a level's round takes the rest only, and rounds end where there is none.
    """
    levels: list[tuple[int, DataFrame]] = []
    left, level = shapes.select("host", "n", "s"), 1
    while True:
        at = left.where(F.size("s") > level).withColumn("above", _above("s", level))
        crowded = at.groupBy("host", "above").agg(F.count(F.lit(1)).alias("c")).where(
            F.col("c") >= variable_children)
        left = materialize(at.join(crowded, ["host", "above"], "left_semi"), f"url-left-{level}")
        if left.isEmpty():
            return levels
        places = materialize(
            left.groupBy("host", "above", F.col("s")[level].alias("seg")).agg(F.sum("n").alias("n"))
            .groupBy("host", "above")
            .agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("total"))
            .where((F.col("children") >= variable_children)
                   & (F.col("total") <= variable_support * F.col("children")))
            .select("host", "above", F.lit(True).alias("variable")), f"url-places-{level}",
        )
        left = left.drop("above")
        if not places.isEmpty():
            levels.append((level, places))
            left = _generalised(left, [(level, places)])
        level += 1


def _merged(templates: DataFrame, overall: DataFrame, weight: int) -> DataFrame:
    """``templates`` with branches that look alike under one name, the last level first."""
    whole = templates.groupBy("host", "s").agg(F.count(F.lit(1)).alias("c"))
    nodes = whole.select(
        "host", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("level")
    ).select("host", "level", F.array_join(F.slice("s", F.lit(1), F.col("level")), "/").alias("above"),
             F.element_at("s", F.col("level") + 1).alias("seg"))
    branching = (
        nodes.groupBy("host", "level", "above", "seg").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("host", "level", "above").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        .groupBy("level").agg(F.count(F.lit(1)).alias("c"))
    )
    for level in sorted((r.level for r in branching.collect()), reverse=True):
        at = templates.withColumns({
            "above": F.when(F.size("s") > level, _above("s", level)),
            "branch": F.try_element_at("s", F.lit(level + 1)),
            "below": F.array_join(F.slice("s", level + 2, F.greatest(F.size("s"), F.lit(1))), "/"),
        })
        branches = at.where("above IS NOT NULL").groupBy("host", "above", "branch").agg(
            F.count_distinct(F.struct(F.size("s"), "below")).alias("k"),
            F.min("below").alias("lo"), F.max("below").alias("hi"),
            F.min(F.size("s")).alias("short"), F.sum("b").alias("bb"), F.sum("l").alias("bl"),
        )
        alike = branches.groupBy("above", "branch").agg(
            F.sum("bb").alias("ab"), F.sum("bl").alias("al"))
        branches = (
            branches.join(alike, ["above", "branch"]).crossJoin(F.broadcast(overall))  # a single row
            .withColumn("kin_p", (F.col("ab") + weight * F.col("p0")) / (F.col("al") + weight))
            .withColumn("el", F.greatest(F.col("bl") + weight, F.lit(4 * weight)))
            .withColumn("eb", F.col("bb") + (F.col("el") - F.col("bl")) * F.col("kin_p"))
        )
        shape = ["host", "above", "k", "lo", "hi", "short"]
        pooled = branches.groupBy(*shape).agg((F.sum("eb") / F.sum("el")).alias("q"))
        off = F.col("eb") - F.col("el") * F.col("q")
        spread = F.col("el") * F.col("q") * (1 - F.col("q"))
        branches = branches.join(pooled, shape).withColumn(
            "side", F.when(off * off > CHI_SQUARE * spread, F.signum(off)).otherwise(F.lit(0.0)))
        look = [*shape, "side"]
        merged = branches.groupBy(*look).agg(F.min("branch").alias("kin"))
        kin = branches.join(merged, look).where("kin <> branch").select(
            "host", "above", "branch", "kin")
        templates = materialize(
            at.join(kin, ["host", "above", "branch"], "left").withColumn("s", F.when(
                F.col("kin").isNotNull(),
                F.transform("s", lambda x, k: F.when(k == level, F.col("kin")).otherwise(x)),
            ).otherwise(F.col("s"))).drop("above", "branch", "below", "kin"), f"url-merged-{level}",
        )
    return templates


def template_purity(
    urls: DataFrame, variable_children: int = 8, variable_support: int = 2, weight: int = 4
) -> DataFrame:
    """(host, shape, template, purity): smoothed share of blocked urls in each template.

    ``urls`` has host, path and label (1 blocked, 0 allowed, null unlabelled). Per host:

    1. digits and hex ids become wildcards; rows collapse to (host, shape) with counts;
    2. level by level, a segment becomes ``*`` where its place in the tree has at least
       ``variable_children`` different values that are met ``variable_support`` times or
       less on average; a place is what generalised segments lead to;
    3. from the last level to the first, branches at one place merge if they look alike: as
       many templates below, the same first and last one, and counts of blocked urls that a
       chi-square test can't tell from those of all such branches together; the ones clearly
       above or below these form groups of their own;
    4. purity is smoothed towards the same template over all hosts, and that towards the share
       over all labelled urls; in step 3 the same branch on all hosts counts as ``weight`` urls, and
       as more where a branch has fewer than three times as many labels of its own.

    Everything after step 1 works on counts, so a host with most of the rows is no hot key.
    A level is a round of aggregations; only places that could still change take part.
    """
    shapes = (
        urls.withColumn("shape", shape_of(F.col("path"))).groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("label", F.lit(0))).alias("b"),
             F.count("label").alias("l"))
    )
    shapes = materialize(
        shapes.withColumn("s", F.split("shape", "/")).withColumn("s", F.when(
            F.size("s") > 1, F.col("s")).otherwise(F.array(F.col("s")[0], F.lit("")))), "url-shapes"
    )
    levels = _variable_levels(shapes, variable_children, variable_support)
    templates = materialize(_generalised(shapes, levels), "url-templates")
    overall = templates.agg(((F.sum("b") + 1) / (F.sum("l") + 2)).alias("p0"))
    named = _merged(templates, overall, weight).withColumn("template", F.array_join("s", "/"))
    own = named.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))
    anywhere = own.groupBy("template").agg(F.sum("b").alias("ab"), F.sum("l").alias("al"))
    purity = (
        own.join(anywhere, "template").crossJoin(F.broadcast(overall))  # a single row
        .withColumn("kin_p", (F.col("ab") + weight * F.col("p0")) / (F.col("al") + weight))
        .withColumn("purity", (F.col("b") + weight * F.col("kin_p")) / (F.col("l") + weight))
        .select("host", "template", "purity")
    )
    return named.select("host", "shape", "template").join(purity, ["host", "template"])


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, reject_at: float = 0.5
) -> DataFrame:
    """page_id, host, path, rule, template, purity, verdict for every row of ``pages``.

    A rule's verdict holds where one fits. Urls under rules are also the labelled ones from
    which :func:`template_purity` learns; every other url is blocked if its template's
    smoothed purity exceeds ``reject_at``. A null url, or one without ``://``, has an empty
    host and path and shares the template of such urls. Repeated rows give repeated results;
    an empty table gives none; other columns of ``pages`` are ignored.
    """
    parsed = match_rules(
        pages.select("page_id", host_of(F.col("url")).alias("host"),
                     path_of(F.col("url")).alias("path")),
        rules,
    )
    labelled = parsed.select(
        "host", "path",
        F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
        .alias("label"),
    )
    return (
        parsed.withColumn("shape", shape_of(F.col("path")))
        .join(template_purity(labelled), ["host", "shape"], "left")
        .select(
            "page_id", "host", "path", "rule", "template", "purity",
            F.coalesce("rule_verdict", F.when(F.col("purity") > reject_at, "block")
                       .otherwise("allow")).alias("verdict"),
        )
    )
