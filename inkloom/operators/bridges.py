"""Joins over bridge tables and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators.dedup import first_wins


def first_category(rows: DataFrame, bridge: DataFrame, key: str, category: str, order: list[Column | str], default: str) -> DataFrame:
    """``rows`` with one ``category``: the bridge's first by ``order``, or ``default``."""
    one = first_wins(bridge, [key], order).select(F.col(key).alias("__k"), F.col(category).alias("__c"))
    joined = rows.join(one, rows[key] == F.col("__k"), "left")
    return joined.withColumn("category", F.coalesce("__c", F.lit(default))).drop("__k", "__c")


def all_categories(rows: DataFrame, bridge: DataFrame, key: str, category: str, sep: str = "、") -> DataFrame:
    """``rows`` with ``categories``: all different ones of the key, sorted, in one string."""
    lists = bridge.groupBy(F.col(key).alias("__k")).agg(F.array_join(F.sort_array(F.collect_set(category)), sep).alias("__c"))
    joined = rows.join(lists, rows[key] == F.col("__k"), "left")
    return joined.withColumn("categories", F.coalesce("__c", F.lit(""))).drop("__k", "__c")


#: Characters a contained text is looked up by in the texts that may hold it.
GRAM = 3


def contains_either_way(queries: DataFrame, names: DataFrame, query: str, name: str, max_names: int) -> DataFrame:
    """Pairs where one text holds the other, in any case; NULL and empty texts match nothing.

    Up to ``max_names`` names are broadcast.  More are joined by shuffle: a
    contained text by its beginning, the texts that may hold it by each run of
    so many characters, and what meets is then compared in full.
    """
    queries, names = queries.filter(F.col(query) != ""), names.filter(F.col(name) != "")
    q, n = F.lower(query), F.lower(name)
    if names.limit(max_names + 1).count() <= max_names:
        return queries.join(F.broadcast(names), q.contains(n) | n.contains(q))
    found = _held(queries, names, query, name).unionByName(_held(names, queries, name, query))
    pairs = found.select(F.col(query).alias("__q"), F.col(name).alias("__n")).distinct()
    held = queries.join(pairs, queries[query] == F.col("__q")).drop("__q")
    return held.join(names, F.col("__n") == names[name]).drop("__n")


def _held(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b)`` where text ``a`` is in text ``b``."""
    low = F.lower(b)

    def grams(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(low, i, size))

    keys = F.array_distinct(F.flatten(F.array(*[grams(k) for k in range(1, GRAM + 1)])))
    asked = inner.select(a, F.substring(F.lower(a), 1, GRAM).alias("__key")).distinct()
    shown = outer.select(b).distinct().select(b, F.explode(keys).alias("__key"))
    return asked.join(shown, "__key").filter(F.lower(b).contains(F.lower(a))).select(a, b)
