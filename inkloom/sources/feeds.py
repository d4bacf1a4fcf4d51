"""Feeds and state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = "struct<title: string, id: string, link: struct<_href: string>, updated: string>"


def atom_entries(xml: Column) -> Column:
    """Entries of an Atom feed held in a column, in order."""
    feed = F.from_xml(xml, f"struct<entry: array<{ENTRY_SCHEMA}>>")
    return feed["entry"]


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all feed files of a folder: title, link, updated."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema("title string, id string, link struct<_href: string>, updated string").load(path)
    return rows.select("title", F.coalesce("link._href", "id").alias("link"), "updated")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON state files, one document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder: name, size, time; hidden ones left out, by name in lower case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    named = files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return named.filter(~F.startswith("name", F.lit("."))).orderBy(F.lower("name"), "path")
