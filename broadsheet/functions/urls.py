"""Url resolution with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import let

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"


def _fold_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(
            part == "..",
            # the leading empty segment stands for the root and is never removed
            F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done),
        )
        .otherwise(F.concat(done, F.array(part))),
    )
    ends_as_folder = path.rlike(r"/\.{1,2}$")
    return let(
        F.array_join(folded, "/"),
        lambda joined: F.when(
            ends_as_folder & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))
        ).otherwise(joined),
    )


def _normal_path(tail: Column) -> Column:
    """Fold dots in the path part of path[?query][#fragment]."""

    def fold(tail: Column) -> Column:
        path = F.regexp_extract(tail, r"^[^?#]*", 0)
        rest = F.substring(tail, F.length(path) + 1, F.length(tail))
        return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(_fold_dots(path), rest)).otherwise(tail)

    return let(tail, fold)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on page ``base``."""
    parts = F.struct(
        base.alias("base"),
        F.regexp_extract(base, _SCHEME, 1).alias("scheme"),
        F.regexp_extract(base, _ORIGIN, 1).alias("origin"),
        F.regexp_extract(base, r"^[^#]*", 0).alias("no_fragment"),
        F.regexp_extract(base, r"^[^?#]*", 0).alias("no_query"),
    )

    def resolved(p: Column) -> Column:
        path = F.substring(p["no_query"], F.length(p["origin"]) + 1, F.length(p["no_query"]))
        folder = F.when(path.contains("/"), F.regexp_extract(path, r"^.*/", 0)).otherwise(F.lit("/"))
        return (
            F.when(href.startswith("http"), href)
            .when(href == "", p["base"])
            .when(href.startswith("//"), F.concat(p["scheme"], F.lit(":"), href))
            .when(href.rlike(_SCHEME), href)
            .when(href.startswith("/"), F.concat(p["origin"], _normal_path(href)))
            .when(href.startswith("?"), F.concat(p["no_query"], href))
            .when(href.startswith("#"), F.concat(p["no_fragment"], href))
            .otherwise(F.concat(p["origin"], _normal_path(F.concat(folder, href))))
        )

    return let(parts, resolved)
