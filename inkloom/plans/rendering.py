"""Queries of the renderers and nested-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import markdown, noise, text
from inkloom.operators import batches
from inkloom.plans import render
from inkloom.plans.catalogue import Catalogue, sql_trim
from inkloom.plans.texts import _LEADS, _NAMES, _SHOWN

C = Catalogue()
add = C.add

_STAT = ", ".join(
    f"CASE WHEN {c} > 0 THEN '{label} ' || {f'CAST({c} AS VARCHAR)' if c == 'comment_count' else _SHOWN.format(n=c)} END" for c, label in render.COUNTERS.items()
)
_STATS = f"concat_ws(' · ', {_STAT})"
_ORIGIN = f"concat_ws('  ·  ', CASE WHEN coalesce({sql_trim('platform')}, '') = '' THEN '{text.UNNAMED_PLATFORM}' ELSE CASE lower({sql_trim('platform')}) {_NAMES} ELSE {sql_trim('platform')} END END, nullif({sql_trim('author')}, ''), nullif({sql_trim('publish_time')}, ''))"
_TAGS = f"array_to_string(list_transform(list_filter(tags, lambda x: {sql_trim('x')} <> ''), lambda x: '#' || regexp_replace({sql_trim('x')}, '^#+', '')), '   ')"


def _body(source: str) -> str:
    return f"""l AS (SELECT row_id, title, unnest(string_split(coalesce(content_markdown, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(content_markdown, ''), chr(10))) + 1)) AS i FROM {source}),
    f AS (SELECT row_id, min(i) AS first FROM l WHERE NOT {_LEADS} GROUP BY row_id),
    b AS (SELECT l.row_id, {sql_trim("string_agg(line, chr(10) ORDER BY i)")} AS body FROM l JOIN f USING (row_id) WHERE i >= first GROUP BY l.row_id)"""


@add(
    f"""WITH {_body('article_item')} SELECT a.row_id, concat_ws(chr(10) || chr(10), '## ' || a.row_id || '. ' || coalesce(a.title, ''), CASE WHEN {_TAGS} <> '' THEN '**标签**：' || {_TAGS} END, '**原文**：' || {_ORIGIN},
    CASE WHEN coalesce(url, '') <> '' THEN '**链接**：' || trim(url) END, '---', nullif(coalesce(body, ''), ''), CASE WHEN {_STATS} <> '' THEN '> ' || {_STATS} END) AS section
    FROM article_item a LEFT JOIN b ON b.row_id = a.row_id"""
)
def markdown_sections(t) -> DataFrame:
    """Articles as Markdown sections."""
    return t("article_item").select("row_id", render.markdown_section(F.col("row_id")).alias("section"))


_PLAIN = sql_trim(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(body, ''), '!\[[^\]\n]*\]\([^)\n]*\)', '', 'g'), '\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '#{1,6}[ \t]*', '', 'g'), '[`*_~]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


@add(
    f"""WITH {_body('article_cache')} SELECT a.row_id, concat_ws(chr(10) || chr(10), a.row_id || '. ' || coalesce(a.title, ''), nullif({_ORIGIN}, ''), nullif({_PLAIN}, ''), '{"=" * 20}') AS section
    FROM article_cache a LEFT JOIN b ON b.row_id = a.row_id"""
)
def text_sections(t) -> DataFrame:
    """Articles as plain text sections."""
    return t("article_cache").select("row_id", render.text_section(F.col("row_id")).alias("section"))


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@add(
    f"""SELECT row_id, md5('<article id="a' || row_id || '"><h2>' || {_esc("coalesce(title, '')")} || '</h2><p>' || {_esc(_ORIGIN)} || '</p><div>' || coalesce(content_html, '') || '</div></article>') AS card_md5 FROM article_cache"""
)
def html_cards(t) -> DataFrame:
    """Articles as HTML cards, by their hashes."""
    return t("article_cache").select("row_id", F.md5(render.html_card(F.col("row_id"))).alias("card_md5"))


def _yaml(name: str, c: str) -> str:
    return f"""'{name}: "' || replace(replace(coalesce({c}, ''), '\\', '\\\\'), '"', '\\"') || '"'"""


@add(f"SELECT row_id, concat_ws(chr(10), '---', {_yaml('title', 'title')}, {_yaml('author', 'author')}, {_yaml('date', 'publish_time')}, {_yaml('url', 'url')}, '---') AS head FROM article_cache")
def front_matters(t) -> DataFrame:
    """YAML heads of articles."""
    return t("article_cache").select("row_id", render.front_matter().alias("head"))


_SAFE = "CASE WHEN {c} = '' THEN 'untitled' ELSE coalesce({c}, 'untitled') END".format(c=sql_trim("regexp_replace(title, '[\\\\/:*?\"<>|]', '_', 'g')"))


@add(
    f"""SELECT row_id, rn, printf('%02d', rn) || '_' || substr({_SAFE}, 1, 45) || '.md' AS file_name, rn || '. ' || coalesce(title, '') || CASE WHEN nullif({sql_trim('publish_time')}, '') IS NOT NULL THEN ' (' || {sql_trim('publish_time')} || ')' ELSE '' END
    || ' - ' || trim(coalesce(url, '')) AS line FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY row_id) AS rn FROM article_cache)"""
)
def export_manifest(t) -> DataFrame:
    """File name and catalogue line of each article in its platform."""
    rows = batches.numbered(t("article_cache").select("row_id", "platform", "title", "publish_time", "url"), ["row_id"], "rn", by=["platform"])
    name = F.concat(F.format_string("%02d", "rn"), F.lit("_"), text.safe_filename(F.col("title"), limit=45), F.lit(".md"))
    return rows.select("row_id", "rn", name.alias("file_name"), render.manifest_line(F.col("rn")).alias("line"))


@add("SELECT ord, ord || chr(9) || coalesce(title, '') || chr(9) || coalesce(publish_time, '') || chr(9) || trim(url) AS line FROM list_meta WHERE trim(url) <> ''")
def link_list_tsv(t) -> DataFrame:
    """Link list lines."""
    rows = t("list_meta").filter("trim(url) <> ''")
    return rows.select("ord", F.concat_ws("\t", F.col("ord").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("publish_time", F.lit("")), F.trim("url")).alias("line"))


@add(
    """SELECT row_id, row_number() OVER (PARTITION BY platform ORDER BY row_id) AS number, coalesce(title, '') AS title, coalesce(publish_time, '') AS publish_time, CASE WHEN NOT coalesce(is_failed, false) THEN '成功' ELSE coalesce(nullif(error_reason, ''), '失败') END AS status,
    CASE WHEN is_original THEN '原创' ELSE '非原创' END AS original, coalesce(summary, '') AS summary, coalesce(url, '') AS url FROM article_item"""
)
def sheet_rows(t) -> DataFrame:
    """Rows of the spreadsheet export: number in the platform, title, time, status with its reason, originality, summary, address."""
    cols = ["row_id", "platform", "title", "publish_time", "is_failed", "error_reason", "is_original", "summary", "url"]
    rows = batches.numbered(t("article_item").select(*cols), ["row_id"], "number", by=["platform"])
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    status = F.when(~F.coalesce("is_failed", F.lit(False)), "成功").otherwise(F.coalesce(F.nullif("error_reason", F.lit("")), F.lit("失败")))
    return rows.select("row_id", "number", blank("title"), blank("publish_time"), status.alias("status"), F.when(F.col("is_original"), "原创").otherwise("非原创").alias("original"), blank("summary"), blank("url"))


@add(
    """SELECT row_id, CAST(json_extract_string(j, '$.id') AS VARCHAR) AS id, json_extract_string(j, '$.title') AS title, CAST(json_extract(j, '$.images') AS VARCHAR) <> 'null' AS has_images
    FROM (SELECT row_id, to_json({'id': id, 'title': title, 'images': images}) AS j FROM article_item)"""
)
def json_rows(t) -> DataFrame:
    """Articles serialised as JSON and read back."""
    j = F.to_json(F.struct("id", "title", "images"), {"ignoreNullFields": "false"})
    rows = t("article_item").select("row_id", F.from_json(j, "id string, title string, images array<string>").alias("j"))
    return rows.select("row_id", "j.id", "j.title", F.col("j.images").isNotNull().alias("has_images"))


_FLAT = "replace(coalesce({x}, ''), chr(10), ' ')"


@add(
    f"""SELECT row_id, array_to_string(list_transform(comments, lambda c: concat_ws(chr(10), '> - **' || coalesce(c.nick_name, '用户') || '**' || CASE WHEN coalesce(c.ip_region, '') <> '' THEN ' [' || c.ip_region || ']' ELSE '' END
    || CASE WHEN coalesce(c.like_num, 0) > 0 THEN ' +' || c.like_num ELSE '' END || '：' || {_FLAT.format(x='c.content')},
    array_to_string(list_transform(c.replies, lambda r: '>   - ↳ **' || coalesce(r.nick_name, '作者') || '回复**：' || {_FLAT.format(x='r.content')}), chr(10)))), chr(10)) AS thread FROM article_item"""
)
def comment_threads(t) -> DataFrame:
    """Comments with replies, rendered."""
    return t("article_item").select("row_id", render.comment_lines().alias("thread"))


@add(
    """WITH c AS (SELECT row_id, unnest(comments) AS c FROM article_item), r AS (SELECT row_id, c.nick_name AS nick, coalesce(c.like_num, 0) AS likes, coalesce(c.is_elected, false) AS elected, len(coalesce(c.replies, [])) AS n FROM c)
    SELECT row_id, count(*) AS n_comments, CAST(sum(n) AS BIGINT) AS n_replies, CAST(sum(likes) AS BIGINT) AS likes, count(*) FILTER (elected) AS n_elected FROM r GROUP BY row_id"""
)
def comment_totals(t) -> DataFrame:
    """Comments, replies and likes of each article."""
    c = t("article_item").select("row_id", F.explode("comments").alias("c"))
    n = F.size(F.coalesce("c.replies", F.array().cast(c.schema["c"].dataType["replies"].dataType)))
    return c.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(n).cast("long").alias("n_replies"), F.sum(F.coalesce("c.like_num", F.lit(0))).cast("long").alias("likes"), F.count_if(F.coalesce("c.is_elected", F.lit(False))).alias("n_elected")
    )


@add(
    """SELECT row_id, 0 AS pos, title, 'https://host.example/' || id AS link FROM article_item WHERE id IS NOT NULL
    UNION ALL SELECT row_id, i, img, 'https://host.example' || '/sub/' || i FROM (SELECT row_id, unnest(images) AS img, unnest(range(1, len(images) + 1)) AS i FROM article_item WHERE id IS NOT NULL)"""
)
def message_list_flatten(t) -> DataFrame:
    """Head and sub-articles of message lists, in order, links made absolute."""
    subs = F.transform(F.coalesce("images", F.array().cast("array<string>")), lambda x, i: F.struct(x.alias("title"), F.concat(F.lit("/sub/"), (i + 1).cast("string")).alias("content_url")))
    message = F.to_json(F.struct(F.struct("title", F.concat(F.lit("/"), "id").alias("content_url"), subs.alias("multi_app_msg_item_list")).alias("app_msg_ext_info")))
    rows = t("article_item").filter("id is not null").select("row_id", message.alias("m"))
    schema = "app_msg_ext_info struct<title: string, content_url: string, multi_app_msg_item_list: array<struct<title: string, content_url: string>>>"
    info = F.from_json("m", schema)["app_msg_ext_info"]
    items = F.concat(F.array(F.struct(info["title"].alias("title"), info["content_url"].alias("content_url"))), F.coalesce(info["multi_app_msg_item_list"], F.array().cast("array<struct<title: string, content_url: string>>")))
    flat = rows.select("row_id", F.posexplode(items).alias("pos", "item"))
    return flat.select("row_id", F.col("pos").cast("long").alias("pos"), "item.title", F.concat(F.lit("https://host.example"), "item.content_url").alias("link"))


_R = noise.RULES
_BARE = sql_trim("line")


def _q(p: str) -> str:
    return p.replace("'", "''")


def noise_sql() -> str:
    return f"""WITH l AS (SELECT row_id, unnest(string_split(coalesce(content_markdown, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(content_markdown, ''), chr(10))))) AS i FROM article_cache),
    s AS (SELECT row_id, min(i) AS stop FROM l WHERE regexp_matches({_BARE}, '{_q(_R.stop_pattern)}') GROUP BY row_id),
    k AS (SELECT l.row_id, {sql_trim("regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g')")} AS kept FROM l LEFT JOIN s USING (row_id)
      WHERE (stop IS NULL OR i < stop) AND ({_BARE} = '' OR NOT (regexp_matches({_BARE}, '{_q(_R.drop_pattern)}') OR (length({_BARE}) < {_R.short} AND regexp_matches({_BARE}, '{_q(_R.word_pattern)}')))) GROUP BY l.row_id)
    SELECT a.row_id, coalesce(kept, '') AS filtered FROM article_cache a LEFT JOIN k ON k.row_id = a.row_id"""


@add(noise_sql())
def noise_filter_lines(t) -> DataFrame:
    """Bodies without promotional lines."""
    return t("article_cache").select("row_id", noise.filter_noise(F.col("content_markdown")).alias("filtered"))


@add()
def markdown_blocks(t) -> DataFrame:
    """Blocks of all Markdown bodies."""
    return markdown.markdown_blocks(t("article_cache"), id_col="row_id", text_col="content_markdown")


@add(
    """SELECT platform, CAST(part AS BIGINT) AS part, count(*) AS n_articles, md5(string_agg(row_id || '. ' || coalesce(title, ''), chr(10) || chr(10) ORDER BY row_id)) AS document_md5
    FROM (SELECT *, (row_number() OVER (PARTITION BY platform ORDER BY row_id) - 1) // 200 AS part FROM article_cache) GROUP BY ALL"""
)
def unit_documents(t) -> DataFrame:
    """Merged catalogues of each platform, 200 articles a document."""
    rows = batches.units(t("article_cache").select("row_id", "platform", "title"), "platform", ["row_id"], above=0, size=200)
    rows = rows.select("platform", "part", "row_id", F.concat(F.col("row_id").cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))).alias("section"))
    return render.unit_documents(rows, ["platform", "part"], "row_id", "section").select("platform", "part", "n_articles", F.md5("document").alias("document_md5"))
