"""Rows of other shapes brought into that of an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.dates import show_epoch
from inkloom.functions.text import trim_ws


def drop_private(df: DataFrame) -> DataFrame:
    """Without the columns that begin with '_', which are the collector's own."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def first_text(*columns: str) -> Column:
    """The first of some columns that holds more than white space, trimmed; NULL if none does."""
    return F.coalesce(*[F.nullif(trim_ws(F.col(c)), F.lit("")) for c in columns])


def article_rows(df: DataFrame, *, key: str, names: dict[str, list[str]], counters: dict[str, str], time: str, epoch: str | None = None) -> DataFrame:
    """``(key, names..., publish_time, counters)``: columns of a listing under an article's names.

    ``names`` gives for each of them the columns to take it from, best first.
    The time is ``time``, or ``epoch`` (seconds as text) as it is shown.
    ``counters`` are put in a map, NULL ones as 0; private columns go.
    """
    shown = F.coalesce(first_text(time), show_epoch(trim_ws(F.col(epoch)))) if epoch else first_text(time)
    counted = F.map_from_arrays(F.array(*[F.lit(n) for n in counters]), F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in counters.values()]))
    return drop_private(df).select(key, *[first_text(*columns).alias(n) for n, columns in names.items()], shown.alias("publish_time"), counted.alias("counters"))


def appended(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` and, behind it, the rows of ``new`` whose key it has not; of a new key the first by all columns."""
    fresh = new.join(existing.select(key).distinct(), key, "left_anti").select(*existing.columns)
    first = fresh.groupBy(key).agg(F.min(F.struct(*existing.columns)).alias("__row"))
    return existing.unionByName(first.select("__row.*"))
