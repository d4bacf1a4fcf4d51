"""Paged listings: where paging stops, what is missing, and whether a listing is whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.batches import numbered


def paged(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with the ``page`` (from 1) of ``size`` items they stand on in the listing of their ``by``."""
    return numbered(rows, order, "__at", by=[by]).withColumn("page", F.floor((F.col("__at") - 1) / size).cast("long") + 1).drop("__at")


def stopped(pages: DataFrame, by: str, item: str, least_items: int, max_page: int) -> DataFrame:
    """``(by, page, n_items, n_new, is_last)`` of the pages that paging reaches.

    ``pages`` has by, page and item.  Paging ends with the first page that has
    fewer than ``least_items`` items, shows nothing that an earlier page did
    not, or is ``max_page``; what lies behind it is never seen.
    """
    first = pages.groupBy(by, item).agg(F.min("page").alias("page"))
    new = first.groupBy(by, "page").agg(F.count(F.lit(1)).alias("n_new"))
    counted = pages.groupBy(by, "page").agg(F.count(F.lit(1)).alias("n_items")).join(new, [by, "page"], "left").na.fill(0, ["n_new"])
    ends = (F.col("n_items") < least_items) | (F.col("n_new") == 0) | (F.col("page") >= max_page)
    last = counted.filter(ends).groupBy(by).agg(F.min("page").alias("__last"))
    joined = counted.join(last, by, "left").filter(F.col("__last").isNull() | (F.col("page") <= F.col("__last")))
    return joined.select(by, "page", "n_items", "n_new", F.coalesce(F.col("page") == F.col("__last"), F.lit(False)).alias("is_last"))


def missed(seen: DataFrame, by: str, page: str = "page") -> DataFrame:
    """``(by, page)``: pages between 1 and the last one seen that were not, to be asked for again."""
    spans = seen.groupBy(by).agg(F.max(page).cast("long").alias("__max"))
    wanted = spans.select(by, F.explode(F.sequence(F.lit(1).cast("long"), "__max")).alias(page))
    return wanted.join(seen.select(by, F.col(page).cast("long").alias(page)).distinct(), [by, page], "left_anti")


def cursors(pages: DataFrame, by: str, key: str) -> DataFrame:
    """``(by, page, cursor, next_cursor)`` of a listing in descending ``key``: each page begins below the least key of the one before."""
    least = pages.groupBy(by, "page").agg(F.min(key).alias("next_cursor"))
    # one row a page, so the window holds a listing's pages, not its items
    before = F.lag("next_cursor").over(Window.partitionBy(by).orderBy("page"))
    return least.select(by, "page", before.alias("cursor"), "next_cursor")
