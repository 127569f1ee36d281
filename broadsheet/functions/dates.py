"""Publication dates in the formats feeds use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from broadsheet.functions.text import let, strip

# Non-ISO layouts, tried in order after ISO; "d" and "M" also take two digits.
_LAYOUTS = (
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
    "d MMMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm", "d MMMM yyyy",
    "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy",
    "MMMM d yyyy HH:mm:ss", "MMMM d yyyy HH:mm", "MMMM d yyyy",
    "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy",
    "yyyyMMdd'T'HHmmss", "yyyyMMdd",
)

_WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_OFFSET = r"(?<=:\d{2}|:\d{2}\.\d{1,9})\s*([+-]\d{2}):?(\d{2})$"
_ZONE_NAME = r"(?i)(?<=\d)\s*(z|[a-z]{2,5})$"


def parse_date(raw: Column) -> Column:
    """UTC timestamp without zone, or NULL when no known layout fits.

    A weekday in front and a zone name behind are dropped, a numeric offset is
    subtracted, and a value without an offset is read as UTC.
    """
    text = F.regexp_replace(strip(raw), _WEEKDAY, "")
    return let(F.regexp_replace(text, r"(?<=[A-Za-z0-9]),", ""), _parse)


def _parse(text: Column) -> Column:
    hours = F.regexp_extract(text, _OFFSET, 1)
    minutes = F.regexp_extract(text, _OFFSET, 2)
    sign = F.when(hours.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    shift = F.when(
        hours != "", hours.cast("int") * 60 + sign * minutes.cast("int")
    ).otherwise(F.lit(0))
    bare = F.regexp_replace(F.regexp_replace(text, _OFFSET, ""), _ZONE_NAME, "")
    return let(bare, _parse_local) - F.make_dt_interval(mins=shift)


def _parse_local(text: Column) -> Column:
    # an ISO date has at least a month and a day
    iso = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("timestamp_ntz"))
    other = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _LAYOUTS]
    return F.coalesce(iso, *other)
