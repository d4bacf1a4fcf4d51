"""Positions, slices, batches and runs.

A number over all rows without one task holding them: rows are range-sorted,
each partition counts its rows, and only those counts (one a partition) meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.session import written


def numbered(df: DataFrame, order: list[Column | str], name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with dense positions from 1 in ``order``, over all rows or within each ``by`` group.

    A group of any size is spread over the partitions of the sort.  The sorted
    rows are written once, so the partition of a row cannot change between
    counting and numbering.
    """
    by = by or []
    groups = {f"__g{i}": F.col(c) for i, c in enumerate(by)}
    parted = written(df.orderBy(*by, *order).withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id(), **groups}), "numbered")
    keys = ["__part", *groups]
    counts = parted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"__b{k}") for k in keys], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__b__part")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__b{g}"))
    ranked = parted.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy("__in")))
    joined = ranked.join(before if by else F.broadcast(before), on)
    return joined.withColumn(name, (F.col("__before") + F.col("__rn")).cast("long")).drop(*keys, *[f"__b{k}" for k in keys], "__in", "__before", "__rn")


def range_slice(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (from 1) in ``order``; beyond the end there are none.

    The rows are cut by their positions, so a slice of any size stays spread.
    """
    return numbered(df, [order], "__position").filter(F.col("__position").between(max(start, 1), end)).drop("__position")


def units(df: DataFrame, unit: str, order: list[Column | str], above: int, size: int) -> DataFrame:
    """Position ``rn`` in each unit and ``part``: units of more than ``above`` rows in parts of ``size``."""
    totals = df.groupBy(F.col(unit).alias("__u")).agg(F.count(F.lit(1)).alias("__total"))
    rows = numbered(df, order, "rn", by=[unit]).join(totals, F.col(unit).eqNullSafe(F.col("__u")))
    return rows.withColumn("part", F.when(F.col("__total") > above, F.floor((F.col("rn") - 1) / size)).otherwise(F.lit(0).cast("long"))).drop("__u", "__total")


def collision_names(df: DataFrame, folder: list[str], name: str, order: list[Column | str]) -> DataFrame:
    """``name`` with ' (1)', ' (2)' from its second use in a folder."""
    return numbered(df, order, "__use", by=[*folder, name]).withColumn("name", F.concat(name, F.when(F.col("__use") > 1, F.concat(F.lit(" ("), (F.col("__use") - 1).cast("string"), F.lit(")"))).otherwise(F.lit("")))).drop("__use")


def longest_runs(df: DataFrame, key: str, order: list[Column | str], condition: Column) -> DataFrame:
    """``(key, longest)``: the longest run of rows that meet ``condition``, where there is any; a key of any size is spread."""
    flagged = numbered(df.withColumn("__c", condition), order, "__all", by=[key])
    own = numbered(flagged.filter("__c").select(key, "__all"), ["__all"], "__own", by=[key])
    runs = own.groupBy(key, (F.col("__all") - F.col("__own")).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    return runs.groupBy(key).agg(F.max("__n").alias("longest"))
