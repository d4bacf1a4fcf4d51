"""Order-preserving deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``; NULL keys are one key.

    A ranked filter of 1, so each task keeps only its best row before the
    shuffle (group limit), and a hot key moves one row a task.
    """
    named = {f"__k{i}": F.col(k) if isinstance(k, str) else k for i, k in enumerate(keys)}
    w = Window.partitionBy(*named).orderBy(*order)
    return df.withColumns(named).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", *named)


def union_first_wins(frames: list[DataFrame], keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Union of channels, earlier ones first, then ``first_wins``; adds ``channel`` from 1."""
    ranked = [f.withColumn("channel", F.lit(i)) for i, f in enumerate(frames, 1)]
    union = ranked[0]
    for f in ranked[1:]:
        union = union.unionByName(f)
    return first_wins(union, keys, ["channel", *order])


def exact_classes(df: DataFrame, value: str, id_col: str) -> DataFrame:
    """``(hash, first, n)`` of each distinct value: only hashes travel, never the values."""
    return df.groupBy(F.sha2(F.coalesce(value, F.lit("\0null")), 256).alias("hash")).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("n"))
