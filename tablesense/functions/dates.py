"""Dates written as text: sixteen formats, tried in a column's own order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from tablesense import values as V
from tablesense.functions.text import strip

#: What each field may hold, and the letters Spark reads it with.
_FIELDS = {
    "%Y": (r"\d{4}", "yyyy"), "%y": (r"\d{2}", "yyyy"), "%m": ("(?:1[0-2]|0?[1-9])", "M"),
    "%d": (r"(?:3[01]|[12]\d|0?[1-9])", "d"), "%H": (r"(?:2[0-3]|[01]?\d)", "H"), "%M": (r"[0-5]?\d", "m"),
    "%S": (r"[0-5]?\d", "s"), "%b": ("(?i:" + "|".join(m[:3] for m in V.MONTHS) + ")", "MMM"),
    "%B": ("(?i:" + "|".join(V.MONTHS) + ")", "MMMM"),
}
#: A cheap test every format satisfies; most text never reaches a parser.
_DATE_LIKE = r"^(\d{1,4}[-/.\s]|[A-Za-z]{3}\s+\d)"


def _guard(name: str) -> str:
    """The whole-text pattern of a format; what fits it is a date but for days past month end."""
    parts = re.split(r"(%[A-Za-z]| )", name)
    return "^" + "".join(_FIELDS[p][0] if p in _FIELDS else r"\s+" if p == " " else re.escape(p) for p in parts) + "$"


def _pattern(name: str) -> str:
    return reduce(lambda text, f: text.replace(f, _FIELDS[f][1]), _FIELDS, name)


def parse_with(text: Column, name: str) -> Column:
    """Parse trimmed text under one format; null when it does not fit."""
    ready = text
    if name.endswith("%y"):
        # Two digits mean 1969 to 2068; Spark would read every one as 20xx.
        year = F.right(text, F.lit(2))
        century = F.when(year >= str(V.TWO_DIGIT_YEAR_PIVOT), "19").otherwise("20")
        ready = F.concat(text.substr(F.lit(1), F.length(text) - 2), century, year)
    elif " " in name:
        ready = F.regexp_replace(text, r"\s+", " ")
    return F.when(text.rlike(_guard(name)), F.try_to_timestamp(ready, F.lit(_pattern(name))).cast("timestamp_ntz"))


def parse_trimmed(text: Column, formats: tuple[str, ...] = V.DATE_FORMAT_NAMES) -> Column:
    """First format that fits trimmed text, in the order given."""
    if not formats:
        return F.lit(None).cast("timestamp_ntz")
    return F.when(text.rlike(_DATE_LIKE), F.coalesce(*[parse_with(text, f) for f in formats]))


def parse_date(c: Column, formats: tuple[str, ...] = V.DATE_FORMAT_NAMES) -> Column:
    return parse_trimmed(strip(c), formats)


def matching_formats(text: Column) -> Column:
    """The positions (0 to 15) of every format that explains trimmed text."""
    hits = F.array_compact(F.array(*[
        F.when(parse_with(text, name).isNotNull(), F.lit(i)) for i, name in enumerate(V.DATE_FORMAT_NAMES)]))
    return F.when(text.rlike(_DATE_LIKE), hits).otherwise(F.array().cast("array<int>"))


def format_date(c: Column, formats: tuple[str, ...], target: str = "yyyy-MM-dd") -> Column:
    return F.date_format(parse_date(c, formats), target)
