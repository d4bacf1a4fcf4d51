"""Joins that keep hot keys from landing in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds at least one row in HOT_PART of all rows, so there
#: are at most HOT_PART hot keys, whatever the size of the data.
HOT_PART = 1000


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def salted_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    sizes: DataFrame,
    spread: Column,
    how: str = "left",
    fanout: int = 16,
    count_col: str = "n",
) -> DataFrame:
    """Join ``facts`` with a lookup table of unique ``keys``, hot keys spread over ``fanout`` tasks.

    ``sizes`` has the number of fact rows per key.  Keys with at least
    1/HOT_PART of all rows (at most HOT_PART keys, so a bounded broadcast) are
    salted: their fact rows get one of ``fanout`` salts from ``spread`` and
    their lookup row is repeated for each salt.  Keys compare null-safe.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    total = sizes.agg(F.sum(count_col).alias("total")).head()[0] or 0
    hot_from = max(2, -(-total // HOT_PART))
    hot = sizes.filter(F.col(count_col) >= hot_from).select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.lit(True).alias("__hot"))
    drop = [f"__h_{k}" for k in keys]
    zero = F.lit(0).cast("long")
    salts = F.array(*[F.lit(i).cast("long") for i in range(fanout)])
    left = facts.join(F.broadcast(hot), _same(keys, "__h_"), "left").drop(*drop)
    left = left.withColumn("__salt", F.when(F.col("__hot"), F.pmod(spread, F.lit(fanout))).otherwise(zero)).drop("__hot")
    right = lookup.join(F.broadcast(hot), _same(keys, "__h_"), "left").drop(*drop)
    right = right.withColumn("__k_salt", F.explode(F.when(F.col("__hot"), salts).otherwise(F.array(zero)))).drop("__hot")
    right = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(right, (F.col("__salt") == F.col("__k_salt")) & _same(keys, "__k_"), how)
    return joined.drop("__salt", "__k_salt", *[f"__k_{k}" for k in keys])
