"""Keyword signals on article text.

Keywords are literal arrays probed with higher-order functions: one small expression
whatever the size of the list, so generated code stays far from the JVM method limit.
The text is bound once per expression (``let``): were it inlined into the lambda, it
would be lower-cased again for every keyword.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.config import RuleSet
from broadsheet.functions.text import let


def sql_text(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array_sql(words: Sequence[str]) -> str:
    return "cast(array(" + ", ".join(sql_text(w) for w in words) + ") as array<string>)"


def literal_array(words: Sequence[str]) -> Column:
    """A constant array; one SQL text builds it with a single call into the JVM."""
    return F.expr(_array_sql(words))


def search_text(title: Column, content: Column) -> Column:
    """Lower-cased title and content, padded so that ' word ' can match at the ends."""
    return F.concat(
        F.lit(" "), F.lower(F.coalesce(title, F.lit(""))),
        F.lit(" "), F.lower(F.coalesce(content, F.lit(""))), F.lit(" "),
    )


def _word_pattern(word: str) -> str:
    return r"(?<![\p{L}\p{N}])" + re.escape(word.strip()) + r"(?![\p{L}\p{N}])"


def matched(text: Column, words: Sequence[str], word_boundary: bool = False) -> Column:
    """The distinct keywords found in ``text``, in list order."""
    words = list(dict.fromkeys(words))
    if not words:
        return literal_array(words)
    if word_boundary:
        hits = [F.when(text.rlike(_word_pattern(w)), F.lit(w)) for w in words]
        return F.array_compact(F.array(*hits))
    return let(text, lambda t: F.filter(literal_array(words), lambda w: F.contains(t, w)))


def match_count(text: Column, words: Sequence[str], word_boundary: bool = False) -> Column:
    return F.size(matched(text, words, word_boundary))


def any_match(text: Column, words: Sequence[str], word_boundary: bool = False) -> Column:
    """True at the first keyword found; later ones are not probed."""
    if not words:
        return F.lit(False)
    if word_boundary:
        return text.rlike("|".join(_word_pattern(w) for w in words))
    return let(text, lambda t: F.exists(literal_array(words), lambda w: F.contains(t, w)))


def tech_relevant(text: Column, rules: RuleSet) -> Column:
    """One strong keyword, or several weak ones."""
    strong = any_match(text, rules.strong, rules.word_boundary)
    weak = match_count(text, rules.weak, rules.word_boundary) >= rules.weak_needed
    return strong | weak


def topic(text: Column, rules: RuleSet) -> Column:
    """First category with a keyword in the text, else the default category."""
    branch = None
    for name, words in rules.categories:
        hit = any_match(text, words, rules.word_boundary)
        branch = F.when(hit, name) if branch is None else branch.when(hit, name)
    default = F.lit(rules.default_category)
    return default if branch is None else branch.otherwise(default)


def region_keywords(rules: RuleSet) -> tuple[str, ...]:
    """Union of the relevance and country lists: each word is searched once per text."""
    words = list(rules.eu_keywords)
    for _, group in rules.countries:
        words.extend(group)
    return tuple(dict.fromkeys(words))


def country_of(found: Column, rules: RuleSet) -> Column:
    """First country group that shares a word with ``found``; '' if none does."""
    if not rules.countries:
        return F.lit("")
    groups = F.expr(
        "array("
        + ", ".join(
            f"named_struct('name', {sql_text(name)}, 'words', {_array_sql(words)})"
            for name, words in rules.countries
        )
        + ")"
    )
    first = F.get(F.filter(groups, lambda g: F.arrays_overlap(g["words"], found)), F.lit(0))
    return F.coalesce(first["name"], F.lit(""))


def relevance(title: Column, source: Column, found: Column, country: Column,
              rules: RuleSet) -> Column:
    """Regional relevance 0..10 from title words, text words, outlet and country."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    in_title = match_count(padded, rules.eu_keywords, rules.word_boundary)
    in_text = F.size(F.array_intersect(found, literal_array(rules.eu_keywords)))
    extra = F.greatest(in_text - in_title, F.lit(0))
    outlet = source.isin(list(rules.eu_sources)) & ((in_title > 0) | (extra > 0))
    score = (
        F.least(in_title * F.lit(2.0), F.lit(4.0))
        + F.least(extra * F.lit(0.5), F.lit(3.0))
        + F.when(outlet, F.lit(2.0)).otherwise(F.lit(0.0))
        + F.when(country != "", F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return F.least(score, F.lit(10.0))
