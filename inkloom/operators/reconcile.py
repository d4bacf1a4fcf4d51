"""Declared against actual counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the declared count below which a listing is warned of.
LEAST_SHARE = 0.75


def declared_vs_actual(declared: DataFrame, found: DataFrame, key: str, count_col: str, least_share: float = LEAST_SHARE, limit: int | None = None) -> DataFrame:
    """``(key, declared, actual, verdict, is_warned)``; no or zero declaration is 'unknown'.

    With ``limit``, the most rows that were asked for of a key, a listing that
    reached it is 'limited' where more were declared, and is not warned of.
    """
    d = declared.groupBy(key).agg(F.max(count_col).alias("declared"))
    a = found.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    both = d.join(a, key)
    limited = (F.col("actual") >= limit) & (F.col("declared") > limit) if limit else F.lit(False)
    if limit:
        both = both.withColumn("actual", F.least("actual", F.lit(limit).cast("long")))
    verdict = F.when(F.coalesce("declared", F.lit(0)) == 0, "unknown").when(limited, "limited").when(F.col("actual") == F.col("declared"), "equal").when(F.col("actual") < F.col("declared"), "short").otherwise("over")
    warned = F.coalesce(~limited & (F.col("declared") > 0) & (F.col("actual") < least_share * F.col("declared")), F.lit(False))
    return both.select(key, "declared", "actual", verdict.alias("verdict"), warned.alias("is_warned"))


def completeness_by_type(declared: DataFrame, found: DataFrame, keys: list[str], count_col: str, least_share: float = LEAST_SHARE) -> DataFrame:
    """``(keys, declared, actual, is_short)``: declared counts by owner and type against what was found; nothing found counts as 0."""
    d = declared.groupBy(*keys).agg(F.max(count_col).cast("long").alias("declared")).filter("declared > 0")
    a = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = d.join(a, keys, "left").na.fill(0, ["actual"])
    return both.select(*keys, "declared", "actual", (F.col("actual") < F.col("declared") * least_share).alias("is_short"))
