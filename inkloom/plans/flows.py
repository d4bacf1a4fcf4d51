"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.plans.catalogue import Catalogue
from inkloom.session import fresh_path, table
from inkloom.sources import feeds, jsonl, sinks
from inkloom.streaming import progress

C = Catalogue()


def _add(sql: str | None = None):
    """Register a query that needs the session itself."""

    def register(f):
        C.queries[f.__name__] = f
        if sql:
            C.sql[f.__name__] = sql
        return f

    return register


@_add(
    """SELECT trim(url) AS url, min_by(title, row_id) AS title, bool_or(true) AS is_read FROM (SELECT * FROM article_cache WHERE trim(url) <> '' AND coalesce(content_html, '') <> '') GROUP BY 1"""
)
def relay_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written as JSON lines and read back, the first of each URL."""
    path = fresh_path(spark, "relay")
    rows = table(spark, sf_dir, "article_cache").orderBy("row_id").select(
        F.trim("url").alias("url"), "title", F.col("content_html").alias("raw_html"), F.lit(False).alias("is_failed"), F.lit(None).cast("string").alias("error_reason"), F.lit(200).alias("status_code")
    )
    jsonl.append_relay(rows.filter("raw_html <> ''"), path)
    return jsonl.usable(jsonl.read_relay(spark, path)).select("url", "title", F.lit(True).alias("is_read"))


@_add("SELECT count(*) AS n_lines FROM article_cache")
def relay_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical lines of a relay folder."""
    path = fresh_path(spark, "relay-lines")
    jsonl.append_relay(table(spark, sf_dir, "article_cache").select("url", "title"), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


@_add(
    """SELECT platform, format, count(*) AS n_articles FROM article_cache, (VALUES ('json'), ('text')) f(format) WHERE platform IS NOT NULL GROUP BY ALL"""
)
def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each platform written as text and JSON folders, and counted from what was written."""
    rows = table(spark, sf_dir, "article_cache").filter("platform is not null")
    text, docs = fresh_path(spark, "archive-text"), fresh_path(spark, "archive-json")
    named = rows.select("platform", "row_id", F.concat(F.lit("# "), F.regexp_replace(F.coalesce("title", F.lit("")), r"\s+", " ")).alias("section"))
    sinks.write_sections(named, text, "section", ["platform"], "row_id")
    sinks.write_json(rows.select("platform", "row_id", "title", "url"), docs, ["platform"])
    written_text = spark.read.option("lineSep", "\n\n").text(text).filter(F.startswith("value", F.lit("# "))).groupBy(F.col("platform").cast("string").alias("platform")).agg(F.count(F.lit(1)).alias("n_articles"))
    written_json = spark.read.schema("row_id long, title string, url string, platform string").json(docs).groupBy("platform").agg(F.count(F.lit(1)).alias("n_articles"))
    both = written_text.withColumn("format", F.lit("text")).unionByName(written_json.withColumn("format", F.lit("json")))
    return both.select("platform", "format", "n_articles")


@_add("SELECT album_id, title, url AS link FROM (SELECT *, row_number() OVER (PARTITION BY album_id ORDER BY title, url) AS rn FROM album WHERE title IS NOT NULL AND url IS NOT NULL) WHERE rn = 1")
def atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of Atom feeds."""
    first = table(spark, sf_dir, "album").filter("title is not null and url is not null").groupBy("album_id").agg(F.min(F.struct("title", "url")).alias("a"))
    entry = F.concat(F.lit("<feed><entry><title>"), "a.title", F.lit('</title><link href="'), F.replace("a.url", F.lit("&"), F.lit("&amp;")), F.lit('"/></entry></feed>'))
    e = first.select("album_id", F.explode(feeds.atom_entries(entry)).alias("e"))
    return e.select("album_id", "e.title", F.col("e.link._href").alias("link"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the table may be a file or a folder


def _finish(df: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there and return what it wrote."""
    spark = df.sparkSession
    out, state = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    if mode == "append":
        df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@_add("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest frame of each key from a stream."""
    return _finish(progress.conflated(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"), "complete", "latest")


@_add("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of a stream."""
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return _finish(progress.distinct_stream(rows, ["user_id", "event_type"], "at", "1 day").select("user_id", "event_type"), "append", "distinct")


@_add("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream by type."""
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    w = _finish(progress.windowed(rows, "at", "1 day", "1 hour", None, ["event_type"], "value"), "complete", "windows")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@_add("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each key kept by an idempotent batch writer."""
    rows = _events(spark, sf_dir)
    out, state = fresh_path(spark, "upsert"), fresh_path(spark, "upsert-state")
    query = rows.writeStream.foreachBatch(progress.keyed_upsert(out, F.col("user_id"), ["ts", "event_id"])).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return progress.read_upserted(spark, out).select("user_id", "event_id")
