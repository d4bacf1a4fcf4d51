"""A keyed article cache: validity, latest rows, upsert, delete, hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import trim_ws
from inkloom.operators.dedup import first_wins

# Marks of failed fetches in bodies, of a bare repost, and of undecoded or hidden text.
FAILURE_MARKS = ("抓取失败", "内容获取异常")
REPOST = "转发微博"
ESCAPES = (r"\x0a", r"\x26")
HIDDEN = "visibility: hidden"


def _md() -> Column:
    return F.coalesce("content_markdown", F.lit(""))


def _no_failure_mark() -> Column:
    out = F.lit(True)
    for mark in FAILURE_MARKS:
        out = out & ~_md().contains(mark)
    return out


def _has_images(json: bool) -> Column:
    if json:
        return ~F.coalesce("images_json", F.lit("")).isin("", "[]")
    return F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0


def is_stale() -> Column:
    """Undecoded escapes, hidden markup, a line end in the author, or a bare repost without images."""
    escaped = _md().contains(ESCAPES[0]) | _md().contains(ESCAPES[1])
    repost = (F.coalesce("platform", F.lit("")) == "weibo") & (F.trim(_md()) == REPOST) & ~_has_images(json=True)
    return escaped | F.coalesce("content_html", F.lit("")).contains(HIDDEN) | F.coalesce("author", F.lit("")).contains("\n") | repost


def is_valid() -> Column:
    """Not stale, with a body or images, and no mark of a failed fetch."""
    return ~is_stale() & ((trim_ws(_md()) != "") | _has_images(json=True)) & _no_failure_mark()


def is_success() -> Column:
    """The one success predicate: not failed, with a body or images, no failure mark."""
    return ~F.coalesce("is_failed", F.lit(False)) & ((trim_ws(_md()) != "") | _has_images(json=False)) & _no_failure_mark()


def latest(rows: DataFrame, key: Column, newest_by: list[str]) -> DataFrame:
    """The last write of each key."""
    return first_wins(rows, [key], [F.col(c).desc() for c in newest_by])


def upsert(old: DataFrame, new: DataFrame, key: Column, newest_by: list[str]) -> DataFrame:
    """Both tables with the last write of each key."""
    return latest(old.unionByName(new), key, newest_by)


def delete(rows: DataFrame, gone: DataFrame, key: Column, gone_key: Column) -> DataFrame:
    """Rows whose key is not in ``gone``."""
    return rows.withColumn("__key", key).join(gone.select(gone_key.alias("__key")), "__key", "left_anti").drop("__key")


def hit_or_miss(work: DataFrame, valid: DataFrame, key: Column, valid_key: Column) -> DataFrame:
    """``work`` with ``is_hit``: whether a valid cached row has its key."""
    hits = valid.select(valid_key.alias("__key")).distinct().withColumn("__hit", F.lit(True))
    return work.withColumn("__key", key).join(hits, "__key", "left").withColumn("is_hit", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")
