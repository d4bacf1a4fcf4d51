"""Writers of export formats: partitioned, one task a part, no driver involved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sections(rows: DataFrame, path: str, section: str, unit: list[str], order: str) -> None:
    """Sections as text files in a folder for each unit, in order within a file."""
    parted = rows.select(*unit, order, F.col(section).alias("value")).repartition(*unit).sortWithinPartitions(*unit, order)
    parted.drop(order).write.mode("overwrite").partitionBy(*unit).option("lineSep", "\n\n").text(path)


def write_links(rows: DataFrame, path: str) -> None:
    """Link list as tab-separated values, blank links left out."""
    rows.filter(F.trim("url") != "").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, unit: list[str] | None = None, max_rows: int = 100_000) -> None:
    """Rows as JSON lines, at most ``max_rows`` a file."""
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", max_rows)
    (writer.partitionBy(*unit) if unit else writer).json(path)
