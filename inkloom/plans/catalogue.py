"""A registry of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkloom.functions.text import WS
from inkloom.session import table

Tables = Callable[[str], DataFrame]


class Catalogue:
    """Queries by name; ``add`` registers a function of the table reader."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(f: Callable[[Tables], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: table(spark, sf_dir, name))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def sql_canonical(x: str) -> str:
    u = f"regexp_replace(regexp_replace(regexp_replace({sql_trim(x)}, '^([A-Za-z]+:)?//', ''), '[?#].*$', ''), '/+$', '')"
    return f"(lower(split_part({u}, '/', 1)) || substr({u}, length(split_part({u}, '/', 1)) + 1))"
