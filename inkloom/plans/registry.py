"""All queries of the core library and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkloom.plans import flagship as flagship_plan
from inkloom.plans import details, flows, htmlplans, listings, problems, relational, rendering, texts

_MODULES = [texts, relational, rendering, htmlplans, flows, details, listings]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.C.queries.items()} | problems.QUERIES | {"flagship_catalogue": flagship}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.C.sql.items()} | problems.SQL | {"flagship_catalogue": flagship_plan.catalogue_sql()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_plan.catalogue(spark, sf_dir)
