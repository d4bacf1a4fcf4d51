"""Queries of listings: paging, completeness, addresses, titles of posts, merged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import markdown, numbers, text, urls
from inkloom.operators import batches, paging, reconcile, shape
from inkloom.plans import render
from inkloom.plans.catalogue import Catalogue, sql_trim
from inkloom.plans.rendering import _ORIGIN, _STATS, _TAGS, _body

C = Catalogue()
add = C.add

_PAGED = "p AS (SELECT author, url, (row_number() OVER (PARTITION BY author ORDER BY ord) - 1) // 20 + 1 AS page FROM list_meta WHERE author <> '')"


@add(
    f"""WITH {_PAGED}, f AS (SELECT author, url, min(page) AS page FROM p GROUP BY ALL), w AS (SELECT author, page, count(*) AS n_new FROM f GROUP BY ALL),
    c AS (SELECT author, page, count(*) AS n_items, coalesce(any_value(n_new), 0) AS n_new FROM p LEFT JOIN w USING (author, page) GROUP BY ALL),
    l AS (SELECT author, min(page) AS last FROM c WHERE n_items < 10 OR n_new = 0 OR page >= 500 GROUP BY ALL)
    SELECT author, page, n_items, CAST(n_new AS BIGINT) AS n_new, coalesce(page = last, false) AS is_last FROM c LEFT JOIN l USING (author) WHERE last IS NULL OR page <= last"""
)
def paged_listing(t) -> DataFrame:
    """Pages of twenty of each author's listing, up to where paging stops (fewer than ten items, nothing new, page 500)."""
    rows = t("list_meta").filter("author <> ''").select("author", "url", "ord")
    return paging.stopped(paging.paged(rows, "author", ["ord"], 20), "author", "url", 10, 500)


@add(
    """WITH m AS (SELECT event_type, user_id AS page FROM events), s AS (SELECT event_type, max(page) AS last FROM m GROUP BY ALL),
    w AS (SELECT event_type, unnest(range(1, last + 1)) AS page FROM s) SELECT event_type, page FROM w WHERE (event_type, page) NOT IN (SELECT (event_type, page) FROM m)"""
)
def missed_pages(t) -> DataFrame:
    """Numbers of each series that were never seen, to be asked for again."""
    return paging.missed(t("events").select("event_type", F.col("user_id").alias("page")), "event_type")


@add(
    """WITH p AS (SELECT author, ord, (row_number() OVER (PARTITION BY author ORDER BY ord DESC) - 1) // 20 + 1 AS page FROM list_meta WHERE author <> ''),
    l AS (SELECT author, page, min(ord) AS next_cursor FROM p GROUP BY ALL) SELECT author, page, lag(next_cursor) OVER (PARTITION BY author ORDER BY page) AS cursor, next_cursor FROM l"""
)
def keyset_cursors(t) -> DataFrame:
    """Cursors of each author's listing from the newest item on, twenty a page."""
    rows = t("list_meta").filter("author <> ''").select("author", F.col("ord"), (-F.col("ord")).alias("__down"))
    return paging.cursors(paging.paged(rows, "author", ["__down"], 20), "author", "ord")


@add(
    """WITH d AS (SELECT album_id, max(article_count) AS declared FROM album GROUP BY 1), a AS (SELECT album_id, count(*) AS found FROM album GROUP BY 1)
    SELECT album_id, declared, least(found, 2) AS actual, CASE WHEN coalesce(declared, 0) = 0 THEN 'unknown' WHEN found >= 2 AND declared > 2 THEN 'limited' WHEN least(found, 2) = declared THEN 'equal' WHEN least(found, 2) < declared THEN 'short' ELSE 'over' END AS verdict,
    coalesce(NOT (found >= 2 AND declared > 2) AND declared > 0 AND least(found, 2) < 0.75 * declared, false) AS is_warned FROM d JOIN a USING (album_id)"""
)
def limited_listings(t) -> DataFrame:
    """Declared against counted articles where at most two of an album were asked for."""
    return reconcile.declared_vs_actual(t("album"), t("album"), "album_id", "article_count", limit=2)


@add(
    """WITH d AS (SELECT author, content_type, count(DISTINCT url) AS declared FROM list_meta WHERE author <> '' AND content_type <> '' GROUP BY ALL),
    a AS (SELECT author, content_type, count(*) AS actual FROM article_cache GROUP BY ALL)
    SELECT author, content_type, declared, coalesce(actual, 0) AS actual, coalesce(actual, 0) < 0.75 * declared AS is_short FROM d LEFT JOIN a USING (author, content_type)"""
)
def completeness_by_type(t) -> DataFrame:
    """Listed against cached articles of each author and type."""
    keys = ["author", "content_type"]
    declared = t("list_meta").filter("author <> '' and content_type <> ''").groupBy(*keys).agg(F.count_distinct("url").alias("declared"))
    return reconcile.completeness_by_type(declared, t("article_cache"), keys, "declared")


@add(
    """SELECT count(*) FILTER (content_type = 'answer') AS answers, count(*) FILTER (content_type = 'pin') AS pins, count(*) AS total, max(fetched_at) AS updated_at FROM article_item WHERE NOT coalesce(is_failed, false)"""
)
def filtered_totals(t) -> DataFrame:
    """Sizes of filtered lists and of the whole."""
    kept = t("article_item").filter(~F.coalesce("is_failed", F.lit(False)))
    of = lambda kind: F.count_if(F.col("content_type") == kind)
    return kept.agg(of("answer").alias("answers"), of("pin").alias("pins"), F.count(F.lit(1)).alias("total"), F.max("fetched_at").alias("updated_at"))


@add(
    r"""WITH u AS (SELECT DISTINCT regexp_extract(trim(url), '^https?://([^/]+)/', 1) AS folder, regexp_extract(trim(url), '^https?://[^/]+/([^/?]+)', 1) AS name, regexp_matches(trim(url), '^https?://[^/]+/[^/?]+/') AS is_dir FROM article_cache)
    SELECT folder, name, is_dir, row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, lower(name), name) AS position FROM u WHERE folder <> '' AND name <> '' AND NOT starts_with(name, '.')"""
)
def directory_order(t) -> DataFrame:
    """Entries of each host's first level, folders first, then by name; hidden ones left out."""
    u = F.trim("url")
    entries = t("article_cache").select(
        F.regexp_extract(u, "^https?://([^/]+)/", 1).alias("folder"), F.regexp_extract(u, "^https?://[^/]+/([^/?]+)", 1).alias("name"), u.rlike("^https?://[^/]+/[^/?]+/").alias("is_dir")
    ).distinct()
    kept = entries.filter((F.col("folder") != "") & (F.col("name") != "") & ~F.startswith("name", F.lit(".")))
    return batches.numbered(kept, [F.col("is_dir").desc(), F.lower("name"), "name"], "position", by=["folder"])


_BARE_URL = "regexp_replace(trim(url), '^(?:[a-z]+:)?//', '')"


@add(
    rf"""WITH p AS (SELECT ord, trim(url) AS u, regexp_replace(lower(regexp_extract({_BARE_URL}, '^([^/?#]+)', 1)), '^(?:www|m)\.', '') AS host,
    regexp_extract({_BARE_URL}, '^[^/?#]+/(?:(?:p|post|article|read)(?:/|\?id=))?[a-z]?([0-9]+)(?:\.html)?/?(?:[&?#].*)?$', 1) AS n FROM list_meta)
    SELECT ord, CASE WHEN host <> '' AND n <> '' THEN 'https://' || host || '/p/' || n ELSE u END AS address FROM p"""
)
def id_urls(t) -> DataFrame:
    """Addresses rebuilt from the article's number, mobile and main hosts united."""
    return t("list_meta").select("ord", urls.id_url(F.col("url")).alias("address"))


_PLAIN_LINE = sql_trim("split_part(coalesce(content_markdown, ''), chr(10), 1)")


@add(
    f"""WITH p AS (SELECT row_id, id, content_type, nullif({_PLAIN_LINE}, '') AS own, nullif({sql_trim('title')}, '') AS card, comments[1].nick_name AS who, {sql_trim("regexp_replace(coalesce(comments[1].content, ''), '<[^>]*>', '', 'g')")} AS what, CASE WHEN row_id % 5 = 0 THEN category END AS ot FROM article_item),
    t AS (SELECT row_id, CASE WHEN who IS NOT NULL THEN CASE WHEN nullif({sql_trim('ot')}, '') IS NOT NULL THEN '转发@' || who || ': ' || ot WHEN own IS NOT NULL AND own <> '转发微博' THEN own || ' // 转发@' || who || ': ' || substr(what, 1, 22) ELSE '转发@' || who || ': ' || substr(what, 1, 25) END
      WHEN content_type = 'article' AND card IS NOT NULL THEN card ELSE coalesce(own, card, '微博_' || id) END AS x FROM p)
    SELECT row_id, CASE WHEN length(x) > 40 THEN substr(x, 1, 38) || '...' ELSE x END AS title FROM t"""
)
def post_titles(t) -> DataFrame:
    """Titles of posts; the first comment stands for what a post quotes."""
    first = F.try_element_at("comments", F.lit(1))
    origin_title = F.when(F.col("row_id") % 5 == 0, F.col("category"))
    line = F.split_part(F.coalesce("content_markdown", F.lit("")), F.lit("\n"), F.lit(1))
    made = text.post_title(line, F.col("title"), F.col("content_type") == "article", first["nick_name"], origin_title, first["content"], F.col("id"))
    return t("article_item").select("row_id", made.alias("title"))


@add(
    """WITH h AS (SELECT DISTINCT CAST(cached_at AS VARCHAR)[1:10] AS day FROM article_cache) SELECT row_id, strftime(fetched_at, '%Y-%m-%d') AS batch FROM article_item WHERE strftime(fetched_at, '%Y-%m-%d') NOT IN (SELECT day FROM h WHERE day IS NOT NULL)"""
)
def batches_not_cached(t) -> DataFrame:
    """Items of daily batches of which nothing was cached."""
    done = t("article_cache").select(F.substring("cached_at", 1, 10).alias("batch")).filter("batch is not null").distinct()
    return t("article_item").select("row_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("batch")).filter("batch is not null").join(done, "batch", "left_anti").select("row_id", "batch")


_CONTENTS = f"""'- [' || rn || '. ' || replace(replace(coalesce(title, ''), '[', '\\['), ']', '\\]') || '](#' || anchor || ')' || CASE WHEN nullif({sql_trim('publish_time')}, '') IS NOT NULL THEN ' `(' || {sql_trim('publish_time')} || ')`' ELSE '' END"""


@add(
    rf"""WITH {_body('article_item')},
    n AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY row_id) AS q FROM article_item),
    r AS (SELECT n.*, body, (q - 1) // 200 AS part, (q - 1) % 200 + 1 AS rn FROM n LEFT JOIN b ON b.row_id = n.row_id),
    k AS (SELECT *, lower(regexp_replace(regexp_replace(rn || '-' || coalesce(title, ''), '[^\p{{L}}\p{{N}}_\-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS anchor FROM r),
    s AS (SELECT platform, part, rn, {_CONTENTS} AS line, concat_ws(chr(10) || chr(10), '<a id="' || anchor || '"></a>', '## ' || rn || '. ' || coalesce(title, ''), CASE WHEN {_TAGS} <> '' THEN '**标签**：' || {_TAGS} END, '**原文**：' || {_ORIGIN},
      CASE WHEN coalesce(url, '') <> '' THEN '**链接**：' || trim(url) END, '---', nullif(coalesce(body, ''), ''), CASE WHEN {_STATS} <> '' THEN '> ' || {_STATS} END, '> end') AS section FROM k)
    SELECT platform, CAST(part AS BIGINT) AS part, count(*) AS n_articles, md5(concat_ws(chr(10) || chr(10), '# ' || coalesce(platform, '') || ' (' || count(*) || ')', string_agg(line, chr(10) ORDER BY rn), '---', string_agg(section, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn))) AS document_md5 FROM s GROUP BY platform, part"""
)
def merged_documents(t) -> DataFrame:
    """Merged Markdown of each platform, 200 articles a document: contents, sections, counters, foot."""
    rows = batches.units(t("article_item").drop("comments"), "platform", ["row_id"], above=0, size=200)
    # comments of this table are covered by comment_threads; merged documents of it are made without
    rows = rows.withColumn("comments", F.lit(None).cast(t("article_item").schema["comments"].dataType)).withColumn("number", (F.col("rn") - 1) % 200 + 1)
    head = F.concat(F.lit("# "), F.coalesce("platform", F.lit("")))
    made = render.merged_markdown(rows, ["platform", "part"], "number", head, "> end")
    return made.select("platform", "part", "n_articles", F.md5("document").alias("document_md5"))


@add(
    """WITH p AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    q AS (SELECT *, CASE event_type WHEN 'view' THEN 'listing' WHEN 'click' THEN 'exporting' WHEN 'cart' THEN 'merging' WHEN 'purchase' THEN 'done' ELSE 'waiting' END AS phase FROM p)
    SELECT event_id, CAST(CASE phase WHEN 'listing' THEN floor(i / n * 75) WHEN 'waiting' THEN 78 WHEN 'exporting' THEN floor(82 + i / n * 4) WHEN 'merging' THEN floor(86 + i / n * 13) ELSE 100 END AS INTEGER) AS percent FROM q"""
)
def progress_percents(t) -> DataFrame:
    """Percent of each frame of a task: events stand for frames, their types for phases."""
    e = t("events").select("event_id", "event_type", "user_id", "ts")
    totals = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = batches.numbered(e, ["ts", "event_id"], "i", by=["user_id"]).join(totals, "user_id")
    kind = F.col("event_type")
    phase = F.when(kind == "view", "listing").when(kind == "click", "exporting").when(kind == "cart", "merging").when(kind == "purchase", "done").otherwise("waiting")
    return rows.select("event_id", numbers.progress_percent(phase, F.col("i"), F.col("n")).alias("percent"))


@add(
    r"""WITH l AS (SELECT row_id, unnest(string_split(replace(content_markdown, chr(13) || chr(10), chr(10)), chr(10))) AS line, unnest(range(1, len(string_split(content_markdown, chr(10))) + 1)) AS i FROM article_cache),
    f AS (SELECT *, sum(CASE WHEN starts_with(trim(line, ' ' || chr(9) || chr(13)), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY i) AS fences FROM l)
    SELECT row_id, CAST(length(regexp_extract(trim(line, ' ' || chr(9) || chr(13)), '^(#{1,6})[ 	]', 1)) AS INTEGER) AS level, count(*) AS n FROM f WHERE fences % 2 = 0 AND regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '^#{1,6}[ 	]+\S') GROUP BY ALL"""
)
def markdown_headings(t) -> DataFrame:
    """Headings of each Markdown body by level, code left out, from its blocks."""
    found = markdown.markdown_blocks(t("article_cache"), id_col="row_id", text_col="content_markdown").filter("kind = 'heading'")
    return found.groupBy("row_id", "level").agg(F.count(F.lit(1)).alias("n"))


@add(
    f"""SELECT ord, nullif({sql_trim('id')}, '') AS id, coalesce(nullif({sql_trim('title')}, ''), nullif({sql_trim('excerpt')}, '')) AS title, nullif({sql_trim('url')}, '') AS url,
    coalesce(nullif({sql_trim('publish_time')}, ''), CASE WHEN create_time IS NULL THEN '' WHEN regexp_full_match({sql_trim('create_time')}, '[0-9]{{10}}') THEN strftime(make_timestamp((CAST({sql_trim('create_time')} AS BIGINT) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END) AS publish_time,
    coalesce(read_num, 0) AS reads, coalesce(like_count, 0) AS likes, coalesce(comment_count, 0) AS comments FROM list_meta"""
)
def article_rows(t) -> DataFrame:
    """Listed rows in the shape of articles, counters from a map."""
    rows = t("list_meta").withColumn("_collector", F.lit("x"))
    counters = {"reads": "read_num", "likes": "like_count", "comments": "comment_count"}
    made = shape.article_rows(rows, key="ord", names={"id": ["id"], "title": ["title", "excerpt"], "url": ["url"]}, counters=counters, time="publish_time", epoch="create_time")
    return made.select("ord", "id", "title", "url", "publish_time", *[F.col("counters")[c].alias(c) for c in counters])


@add(
    """WITH e AS (SELECT album_id, title, url FROM album WHERE article_count IS NOT NULL), n AS (SELECT album_id, min((title, url)) AS r FROM album WHERE article_count IS NULL AND album_id NOT IN (SELECT album_id FROM e) GROUP BY album_id)
    SELECT album_id, title, url FROM e UNION ALL SELECT album_id, r[1], r[2] FROM n"""
)
def albums_appended(t) -> DataFrame:
    """Counted albums and behind them those that were only seen without a count, by id."""
    cols = ["album_id", "title", "url"]
    return shape.appended(t("album").filter("article_count is not null").select(*cols), t("album").filter("article_count is null").select(*cols), "album_id")


@add(
    """SELECT platform, CAST(part AS BIGINT) AS part, count(*) AS n_articles, CAST(min(row_id) AS VARCHAR) AS first_id, CAST(max(row_id) AS VARCHAR) AS last_id FROM (SELECT row_id, platform, (row_number() OVER (PARTITION BY platform ORDER BY row_id) - 1) // 200 AS part FROM article_cache) GROUP BY ALL"""
)
def site_documents(t) -> DataFrame:
    """Articles of each platform serialised as one JSON list for 200 of them, read back by position."""
    rows = batches.units(t("article_cache").select("row_id", "platform", "title", "author", "publish_time", "url"), "platform", ["row_id"], above=0, size=200)
    one = F.struct(F.col("row_id").alias("id"), "title", "author", "publish_time", F.trim("url").alias("url"))
    lists = rows.groupBy("platform", "part").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("json"))
    n = F.json_array_length("json")
    last = F.element_at(F.from_json("json", "array<struct<id: string>>"), -1)["id"]
    return lists.select("platform", "part", n.cast("long").alias("n_articles"), F.get_json_object("json", "$[0].id").alias("first_id"), last.alias("last_id"))
