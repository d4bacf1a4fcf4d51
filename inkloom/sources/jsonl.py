"""Relayed captures as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators.dedup import first_wins

RELAY_SCHEMA = "url string, title string, raw_html string, is_failed boolean, error_reason string, status_code int, _corrupt_record string"


def read_relay(spark: SparkSession, path: str) -> DataFrame:
    """Captures of a folder, the first line of each URL; lines that are no JSON and rows without URL are skipped.

    Files are split by Spark (gzip by file); the line order within the folder
    is that of file and position.
    """
    rows = spark.read.schema(RELAY_SCHEMA).option("mode", "PERMISSIVE").json(path)
    # a file's parts by where they begin, and in a part (one task) the order of its rows
    rows = rows.withColumns({"__file": F.col("_metadata.file_path"), "__part": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    good = rows.filter(F.col("_corrupt_record").isNull() & (F.trim("url") != ""))
    return first_wins(good, [F.trim("url")], ["__file", "__part", "__at"]).drop("__file", "__part", "__at", "_corrupt_record")


def usable(rows: DataFrame) -> DataFrame:
    """Captures with a page that did not fail."""
    return rows.filter((F.coalesce("raw_html", F.lit("")) != "") & ~F.coalesce("is_failed", F.lit(False)))


def append_relay(rows: DataFrame, path: str) -> None:
    """Append captures, compressed."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    """Physical lines of a folder of captures."""
    return spark.read.text(path).count()
