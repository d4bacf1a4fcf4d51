"""The article pipeline from cached rows to an ordered catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import noise, text, urls
from inkloom.operators import batches, cache, dedup, votes
from inkloom.plans import render
from inkloom.session import table


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each distinct, usable article, numbered within its platform.

    Canonical address, first-wins dedup, validity, noise filter, content type,
    the platform's most frequent author,
    file name and catalogue line.
    """
    rows = table(spark, sf_dir, "article_cache")
    # texts end here, before any shuffle: what follows travels without bodies
    rows = rows.filter(cache.is_valid()).select(
        "row_id", "platform", "author", "publish_time", "url", "cached_at", urls.canonical_url(F.col("url")).alias("address"), text.undouble(F.col("title")).alias("title"),
        text.content_type(F.col("content_type"), F.col("title")).alias("kind"), F.length(noise.filter_noise(F.col("content_markdown"))).alias("n_chars"),
    )
    rows = dedup.first_wins(rows, ["address"], [F.col("cached_at").desc(), "row_id"])
    top = votes.top_value(rows.filter(~F.col("author").isin(*votes.PLACEHOLDER_AUTHORS)), "author", "row_id", by=["platform"])
    rows = rows.join(top.select("platform", F.col("value").alias("top_author")), "platform", "left")
    rows = batches.units(rows, "platform", ["row_id"], above=800, size=500)
    return rows.select(
        "platform", "part", "rn", "row_id", "address", "kind", "top_author", "n_chars",
        F.concat(F.format_string("%02d", "rn"), F.lit("_"), text.safe_filename(F.col("title"), limit=45), F.lit(".md")).alias("file_name"),
        render.manifest_line(F.col("rn")).alias("line"),
    )


def catalogue_sql() -> str:
    """The same for DuckDB, from the equivalents of its steps."""
    from inkloom.plans.catalogue import sql_canonical, sql_trim
    from inkloom.plans.relational import _PLACEHOLDERS, _VALID
    from inkloom.plans.rendering import _SAFE, noise_sql
    from inkloom.plans.texts import _HALF, _T, _TYPE

    title = f"CASE WHEN length({_T}) % 2 = 1 AND substr({_T}, {_HALF} + 1, 1) = ' ' AND substr({_T}, 1, {_HALF}) = substr({_T}, {_HALF} + 2, {_HALF}) THEN substr({_T}, 1, {_HALF}) ELSE {_T} END"
    return f"""WITH noise AS ({noise_sql()}),
    v AS (SELECT row_id, platform, author, publish_time, url, cached_at, {sql_canonical('url')} AS address, {title} AS title, {_TYPE} AS kind FROM article_cache WHERE {_VALID}),
    d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY address ORDER BY cached_at DESC NULLS LAST, row_id) = 1),
    a AS (SELECT platform, author, count(*) AS n, min(row_id) AS first FROM d WHERE author NOT IN {_PLACEHOLDERS} GROUP BY ALL),
    t AS (SELECT platform, author AS top_author FROM a QUALIFY row_number() OVER (PARTITION BY platform ORDER BY n DESC, first) = 1),
    n AS (SELECT d.*, row_number() OVER (PARTITION BY platform ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY platform) AS size FROM d)
    SELECT n.platform, CAST(CASE WHEN size > 800 THEN (rn - 1) // 500 ELSE 0 END AS BIGINT) AS part, rn, n.row_id, address, kind, top_author, length(filtered) AS n_chars, printf('%02d', rn) || '_' || substr({_SAFE}, 1, 45) || '.md' AS file_name,
    rn || '. ' || coalesce(title, '') || CASE WHEN nullif({sql_trim('publish_time')}, '') IS NOT NULL THEN ' (' || {sql_trim('publish_time')} || ')' ELSE '' END || ' - ' || trim(coalesce(url, '')) AS line
    FROM n LEFT JOIN t USING (platform) JOIN noise ON noise.row_id = n.row_id"""
