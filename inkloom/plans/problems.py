"""Queries of the general data problems (those not about training text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators.timestamps import TimestampDictionary, normalise_times
from inkloom.session import fresh_path, table

#: Zone in which the collector writes ``cached_at``.
COLLECTOR_ZONE = "Asia/Shanghai"
#: Setting that names a shared folder in which the dictionary of times is kept from run to run.
DICTIONARY_CONF = "spark.inkloom.timeDictionary"


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "site")
    kept = spark.conf.get(DICTIONARY_CONF, None)
    dictionary = TimestampDictionary(spark, kept).open() if kept else TimestampDictionary(spark, fresh_path(spark, "time-dictionary"))
    cached = F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp("cached_at", F.lit("yyyy-MM-dd HH:mm:ss")), COLLECTOR_ZONE))
    parts = []
    for name, reference in (("article_cache", cached), ("article_item", F.unix_seconds(F.col("fetched_at").cast("timestamp")))):
        times = normalise_times(
            table(spark, sf_dir, name), sites, dictionary, id_col="row_id", time_col="publish_time", url_col="url", reference=reference
        )
        parts.append(times.select(F.lit(name).alias("tbl"), "row_id", "utc_sec"))
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of article_cache and article_item whose publish_time names one instant."""
    return _times(spark, sf_dir).filter(F.col("utc_sec").isNotNull())


def p1_unknown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many times of each table were and were not resolved."""
    return (
        _times(spark, sf_dir)
        .groupBy("tbl")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("utc_sec").alias("n_instants"), F.count_if(F.col("utc_sec").isNull()).alias("n_unknown"))
    )


QUERIES = {"p1_found": p1_found, "p1_unknown_counts": p1_unknown_counts}
SQL: dict[str, str] = {}
