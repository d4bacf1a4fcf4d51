"""Majority votes with first-seen ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Author names that stand for no author.
PLACEHOLDER_AUTHORS = ("互联网博主", "微信公众号", "未知", "", "未知博主", "Blogger")


def top_value(rows: DataFrame, value: str, order: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent value (of each ``by`` group), of equals the first seen: ``(by..., value, n, n_values)``.

    Counted by value first, so a hot group is pre-aggregated before it meets.
    """
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    best = F.max_by(F.struct(F.col(value).alias("value"), F.col("__n").alias("n")), F.struct(F.col("__n"), -F.col("__first")))
    return counts.groupBy(*by).agg(best.alias("__b"), F.count(F.lit(1)).alias("n_values")).select(*by, "__b.value", "__b.n", "n_values")
