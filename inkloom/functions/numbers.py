"""Counts written for people, read and written exactly (decimals, no floats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_count(text: Column) -> Column:
    """'1.2万', '8,634', '3k', '1亿' as a whole number; 0 where unreadable."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[ ,]", "")
    number = F.regexp_extract(s, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([万亿kKwWmM]?)$", 1).try_cast("decimal(20,6)")
    unit = F.lower(F.regexp_extract(s, r"^([0-9]*\.?[0-9]+|[0-9]+\.)([万亿kKwWmM]?)$", 2))
    times = F.when(unit.isin("万", "w"), 10000).when(unit == "k", 1000).when(unit == "m", 1_000_000).when(unit == "亿", 100_000_000).otherwise(1)
    return F.coalesce(F.floor(number * times).cast("long"), F.lit(0).cast("long"))


def show_count(n: Column) -> Column:
    """10000 and more in units of 万 with one decimal, a zero decimal dropped."""
    tenths = F.round(n.cast("decimal(20,0)") / 1000, 0).cast("long")
    big = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(F.lit("")), F.lit("万"))
    return F.when(n >= 10000, big).otherwise(n.cast("string"))


def parse_votes(label: Column) -> Column:
    """First number of a vote button, 万 resolved; 0 without a number, NULL without a button."""
    number = F.regexp_extract(label, r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("decimal(20,4)")
    value = F.round(number * F.when(label.contains("万"), 10000).otherwise(1), 0).cast("long")
    return F.when(label.isNotNull(), F.coalesce(value, F.lit(0).cast("long")))


def declared_count(tab: Column) -> Column:
    """Trailing count of a tab label ('文章 1.2万'); NULL without a number or with none before the point."""
    number = F.regexp_extract(tab, r"([0-9][0-9,]*(?:\.[0-9]+)?)[ ]*([万kK]?)$", 1)
    unit = F.lower(F.regexp_extract(tab, r"([0-9][0-9,]*(?:\.[0-9]+)?)[ ]*([万kK]?)$", 2))
    value = F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(20,4)")
    return F.when(value >= 1, F.floor(value * F.when(unit == "万", 10000).when(unit == "k", 1000).otherwise(1)).cast("long"))


# Percent at which each phase of a task begins, and the span of the listing.
LISTING_SPAN, WAITING, EXPORTING, MERGING, DONE = 75, 78, 82, 86, 100


def progress_percent(phase: Column, i: Column, n: Column) -> Column:
    """Percent of a task: listing counts items up to 75, then waiting, exporting (from 82 to 86 by formats), merging (to 99 by batches), done.

    A phase without items is at its beginning; unknown phases are 0.
    """
    share = F.when(n > 0, F.least(F.greatest(i / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    span = lambda a, b: F.floor(F.lit(a) + share * (b - a))
    return (
        F.when(phase == "listing", span(0, LISTING_SPAN)).when(phase == "waiting", F.lit(WAITING)).when(phase == "exporting", span(EXPORTING, MERGING)).when(phase == "merging", span(MERGING, DONE - 1)).when(phase == "done", F.lit(DONE)).otherwise(0)
    ).cast("int")
