"""Field extraction by rule tables: (platform, field, priority, pattern)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import squeeze


@dataclass(frozen=True)
class Rule:
    """A pattern whose first group is the field's value on pages of ``platform`` ('*': on all)."""

    platform: str
    field: str
    priority: int
    pattern: str


def extract(df: DataFrame, rules: Iterable[Rule], html_col: str, platform_col: str) -> DataFrame:
    """``df`` with a column for each field: the first rule by priority that finds text; tags are dropped.

    The rules become one expression a field, so pages are read once.
    """
    by_field: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=lambda r: (r.priority, r.platform == "*")):
        by_field.setdefault(r.field, []).append(r)

    def value(r: Rule) -> Column:
        found = F.nullif(squeeze(F.regexp_replace(F.regexp_extract(html_col, r.pattern, 1), "<[^>]*>", "")), F.lit(""))
        return found if r.platform == "*" else F.when(F.col(platform_col) == r.platform, found)

    return df.withColumns({field: F.coalesce(*[value(r) for r in group]) for field, group in by_field.items()})
