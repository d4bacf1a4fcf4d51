"""Queries of page parsing and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import htmlclean, pagemeta
from inkloom.plans.catalogue import Catalogue, sql_squeeze, sql_trim

C = Catalogue()
add = C.add

_H1, _TT = r"(?is)<h1[^>]*>(.*?)</h1>", r"(?is)<title[^>]*>(.*?)</title>"


def _bare(p: str) -> str:
    return sql_squeeze(f"regexp_replace(regexp_extract(content_html, '{p}', 1), '<[^>]*>', '', 'g')")


@add(
    f"""SELECT row_id, coalesce(nullif({sql_trim(r"regexp_extract(content_html, '(?i)<meta[^>]+property=" + '"og:title"' + r"[^>]+content=" + '"([^"]*)"' + r"', 1)")}, ''), nullif({_bare(_H1)}, ''), nullif({sql_trim(f"split_part(split_part({_bare(_TT)}, ' - ', 1), ' | ', 1)")}, '')) AS title,
    nullif(regexp_extract(content_html, '<p class="meta">([^<·]*) ·', 1), '') AS byline FROM article_cache"""
)
def page_title_meta(t) -> DataFrame:
    """Title of each page (meta, first heading, title element) and the author of its byline."""
    html = F.col("content_html")
    return t("article_cache").select("row_id", pagemeta.page_title(html).alias("title"), F.nullif(F.regexp_extract(html, '<p class="meta">([^<·]*) ·', 1), F.lit("")).alias("byline"))


@add("SELECT row_id, content_html LIKE '%noscript%' AND content_html NOT LIKE '%<article%' AS is_taken_down FROM article_cache WHERE content_html IS NOT NULL")
def takedown_flags(t) -> DataFrame:
    """Pages with both signatures of a taken-down article."""
    html = F.col("content_html")
    return t("article_cache").filter(html.isNotNull()).select("row_id", (html.contains("noscript") & ~html.contains("<article")).alias("is_taken_down"))


@add(
    r"""SELECT row_id, regexp_replace(regexp_replace(content_html, '(?i)visibility\s*:\s*hidden\s*;?', '', 'g'), '(?i)opacity\s*:\s*0([^.0-9]|$)', '\1', 'g') AS shown FROM article_cache"""
)
def hidden_styles_stripped(t) -> DataFrame:
    """Pages without hiding styles; a fraction such as 0.5 is left alone."""
    return t("article_cache").select("row_id", pagemeta.strip_hidden(F.col("content_html")).alias("shown"))


@add(
    """WITH p AS (SELECT row_id, unnest(regexp_extract_all(content_html, 'href="/p/([0-9]+)"', 1)) AS id, unnest(range(1, len(regexp_extract_all(content_html, 'href="/p/([0-9]+)"', 1)) + 1)) AS i FROM article_cache)
    SELECT row_id, id, CAST(min(i) AS BIGINT) AS first_at FROM p GROUP BY ALL"""
)
def linked_ids(t) -> DataFrame:
    """Ids of the articles each page links to, at their first place."""
    one = t("article_cache").select("row_id", F.posexplode(F.regexp_extract_all("content_html", F.lit('href="/p/([0-9]+)"'), F.lit(1))).alias("i", "id"))
    return one.groupBy("row_id", "id").agg(F.min(F.col("i") + 1).cast("long").alias("first_at"))


@add(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"""
)
def tolerant_lists(t) -> DataFrame:
    """Lists delivered as an array, under 'list', or as a single object."""
    kind = F.col("event_id") % 3
    doc = F.when(kind == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(kind == 1, F.concat(F.lit('{"list": ['), "props", F.lit("]}"))).otherwise(F.col("props"))
    items = t("events").select("event_id", F.explode(pagemeta.tolerant_items(doc)).alias("item"))
    return items.select("event_id", F.get_json_object("item", "$.k").cast("long").alias("k"))


@add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def embedded_json(t) -> DataFrame:
    """JSON objects behind a marker in a script."""
    script = F.concat(F.lit('<script>var a = "}"; window.__STATE__ = '), "props", F.lit("; run({});</script>"))
    rows = t("events").select("event_id", script.alias("script"))
    found = pagemeta.json_after(rows, id_col="event_id", text_col="script", marker="window.__STATE__ =")
    return found.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"))


@add(
    """SELECT row_id, CASE WHEN contains(content_html, 'class="pg"') THEN 'div' WHEN contains(content_html, '<article') THEN 'article' WHEN contains(content_html, '<main') THEN 'main' ELSE 'page' END AS container FROM article_cache"""
)
def containers(t) -> DataFrame:
    """Kind of element that holds a page's content."""
    html = F.col("content_html")
    kind = F.when(html.contains('class="pg"'), "div").when(html.contains("<article"), "article").when(html.contains("<main"), "main").otherwise("page")
    return t("article_cache").select("row_id", kind.alias("container"))


@add()
def html_clean_markdown(t) -> DataFrame:
    """Clean HTML, Markdown and images of every page."""
    return htmlclean.clean_pages(t("article_cache"), id_col="row_id", html_col="content_html", title_col="title")


@add("""SELECT row_id, '<meta charset="utf-8">' || title AS decoded FROM article_cache""")
def charset_decoded(t) -> DataFrame:
    """Pages decoded from bytes by the charset they name."""
    raw = F.encode(F.concat(F.lit('<meta charset="utf-8">'), "title"), "UTF-8")
    return pagemeta.decode_sniffed(t("article_cache").withColumn("raw", raw), id_col="row_id", raw_col="raw")
