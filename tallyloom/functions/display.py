"""How times, counts and ratios are shown. What is null shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import rupees

#: The dash, and characters kept of ids, summaries, long summaries, errors and traces.
DASH = "—"
KEPT = {"id": 8, "summary": 200, "long_summary": 500, "error": 4000, "trace": 8000}


def _or_dash(text: Column) -> Column:
    return F.coalesce(text, F.lit(DASH))


def shortened(text: Column, kind: str) -> Column:
    """As many characters as are kept of that kind; null stays null."""
    return F.left(text, F.lit(KEPT[kind]))


def padded(text: Column, width: int) -> Column:
    """Spaces behind, up to a width; longer texts stay whole."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), " ")


def _nearest(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def time_apart(then: Column, now: Column) -> Column:
    """Seconds below 45, then minutes, hours from 1 h and days from 1 d, each to the nearest; `in` for what is ahead."""
    delta = _nearest((F.unix_micros(then) - F.unix_micros(now)) / 1_000_000)
    size = F.abs(delta)
    unit = lambda n, name: F.concat(_nearest(size / n).cast("string"), F.lit(name))
    body = F.when(size < 45, unit(1, "s")).when(size < 3600, unit(60, "m")).when(size < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))
    return _or_dash(F.when(delta > 0, F.concat(F.lit("in "), body)).otherwise(F.concat(body, F.lit(" ago"))))


def time_spent(seconds: Column) -> Column:
    """Seconds with one decimal, from a minute on minutes and seconds."""
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), _nearest(seconds % 60).cast("string"), F.lit("s"))
    return _or_dash(F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s"))).when(seconds.isNotNull(), long))


def percent_text(value: Column, digits: int = 2) -> Column:
    """What is a percentage already; halves go up."""
    return _or_dash(F.when(value.isNotNull(), F.concat(F.format_string(f"%.{digits}f", value.cast("double")), F.lit("%"))))


def ratio_text(value: Column, digits: int = 2) -> Column:
    """A ratio as a percentage."""
    return percent_text(value * 100, digits)


def count_text(value: Column) -> Column:
    """A whole number with Indian grouping."""
    return _or_dash(F.concat(F.when(value < 0, "-").otherwise(""), F.regexp_replace(rupees(value * 100), r"\.\d\d$", "")))
