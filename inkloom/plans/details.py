"""Queries of smaller operators: routing, rules, scripts, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import dates, numbers, pagemeta, rules, text
from inkloom.operators import votes
from inkloom.plans.catalogue import Catalogue, sql_squeeze, sql_trim

C = Catalogue()
add = C.add


@add(
    """SELECT ord, CASE WHEN len(regexp_extract_all(x, 'https?://')) > 1 THEN 'multi' WHEN contains(x, 'album') THEN 'album' WHEN regexp_matches(x, 'https?://') THEN 'single' WHEN regexp_full_match(x, '[A-Za-z0-9+/=]{8,}') THEN 'account' ELSE 'name' END AS route
    FROM (SELECT ord, CASE ord % 5 WHEN 0 THEN url WHEN 1 THEN url || ' ' || url WHEN 2 THEN 'https://h.example/album?id=' || ord WHEN 3 THEN md5(coalesce(title, '')) ELSE coalesce(author, '') END AS x FROM list_meta)"""
)
def routed_targets(t) -> DataFrame:
    """What kind of input a target text is."""
    k = F.col("ord") % 5
    x = F.when(k == 0, F.col("url")).when(k == 1, F.concat_ws(" ", "url", "url")).when(k == 2, F.concat(F.lit("https://h.example/album?id="), F.col("ord").cast("string"))).when(k == 3, F.md5(F.coalesce("title", F.lit("")))).otherwise(F.coalesce("author", F.lit("")))
    rows = t("list_meta").select("ord", x.alias("x"))
    n = F.size(F.regexp_extract_all("x", F.lit("https?://"), F.lit(0)))
    route = F.when(n > 1, "multi").when(F.col("x").contains("album"), "album").when(n == 1, "single").when(F.col("x").rlike(r"\A[A-Za-z0-9+/=]{8,}\z"), "account").otherwise("name")
    return rows.select("ord", route.alias("route"))


@add(
    """SELECT platform, author, count(*) AS n, min_by(title, row_id) AS first_title, max(cached_at) AS last_cached, count(*) FILTER (coalesce(content_markdown, '') <> '') AS n_complete FROM article_cache WHERE author <> '' GROUP BY ALL"""
)
def account_listing(t) -> DataFrame:
    """Accounts of the cache."""
    return t("article_cache").filter("author <> ''").groupBy("platform", "author").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("title", "row_id").alias("first_title"), F.max("cached_at").alias("last_cached"), F.count_if(F.coalesce("content_markdown", F.lit("")) != "").alias("n_complete")
    )


#: Where pages of each platform hold their fields; '*' where no rule of the platform finds any.
RULES = (
    rules.Rule("*", "headline", 1, r"(?is)<h1[^>]*>(.*?)</h1>"),
    rules.Rule("*", "headline", 2, r"(?is)<title[^>]*>(.*?)</title>"),
    *[rules.Rule(p, "byline", 1, r'(?is)<p class="meta">([^<·]*)·') for p in ("zhihu", "juejin", "csdn", "cnblogs", "wechat", "jianshu", "sohu", "weibo", "baijiahao", "51cto", "sina")],
    rules.Rule("*", "byline", 2, r'(?is)<p class="meta">([^<]*)</p>'),
    rules.Rule("*", "shown_time", 1, r'(?is)<p class="meta">[^<·]*·([^<·]*)'),
    rules.Rule("*", "shown_time", 2, r'(?is)<(?:time|em)[^>]*>(.*?)</'),
    rules.Rule("*", "trail", 1, r'(?is)<p class="crumb">(.*?)</p>'),
    rules.Rule("*", "lead", 1, r'(?is)<div class="post-body">\s*(?:<[^>]*>\s*)*([^<]+)'),
    rules.Rule("*", "lead", 2, r'(?is)<div class="pg">\s*(?:<[^>]*>\s*)*([^<]+)'),
    rules.Rule("*", "lead", 3, r"(?is)<article[^>]*>\s*(?:<[^>]*>\s*)*([^<]+)"),
    rules.Rule("*", "lead", 4, r"(?is)<main[^>]*>\s*(?:<[^>]*>\s*)*([^<]+)"),
    rules.Rule("*", "lead", 5, r"(?is)<p[^>]*>([^<]+)"),
)
FIELDS = ("headline", "byline", "shown_time", "trail", "lead")


def _rule_sql(p: str) -> str:
    return f"nullif({sql_squeeze(f'''regexp_replace(regexp_extract(content_html, '{p}', 1), '<[^>]*>', '', 'g')''')}, '')"


def _field_sql(field: str) -> str:
    own = sorted((r for r in RULES if r.field == field), key=lambda r: (r.priority, r.platform == "*"))
    return "coalesce(" + ", ".join(_rule_sql(r.pattern) if r.platform == "*" else f"CASE WHEN platform = '{r.platform}' THEN {_rule_sql(r.pattern)} END" for r in own) + f", NULL) AS {field}"


@add(f"SELECT row_id, {', '.join(map(_field_sql, FIELDS))} FROM article_cache")
def fields_by_rules(t) -> DataFrame:
    """Page fields by a rule table of all platforms."""
    return rules.extract(t("article_cache"), RULES, "content_html", "platform").select("row_id", *FIELDS)


@add("SELECT row_id, read_num AS reads, coalesce(like_count, 0) AS likes, coalesce(is_original, false) AS is_original FROM article_item WHERE read_num IS NOT NULL")
def script_counters(t) -> DataFrame:
    """Counters read from page scripts."""
    script = F.concat(F.lit("var read_num = '"), F.col("read_num").cast("string"), F.lit("'; like_count: "), F.coalesce(F.col("like_count").cast("string"), F.lit('""')), F.lit("; copyright_stat = "), F.when(F.col("is_original"), "1").otherwise("0"), F.lit(";"))
    rows = t("article_item").filter("read_num is not null").select("row_id", pagemeta.engagement(script).alias("e"))
    return rows.select("row_id", F.col("e.read_num").alias("reads"), F.col("e.like_count").alias("likes"), "e.is_original")


_Q = "'"


@add(f"SELECT row_id, regexp_replace(regexp_replace(content_html, '{pagemeta.LAYOUT_STYLES.replace(_Q, _Q * 2)}', '', 'g'), '{pagemeta.LAYOUT_CLASSES.replace(_Q, _Q * 2)}', '\\1', 'g') AS flat FROM article_cache")
def layout_styles_stripped(t) -> DataFrame:
    """Pages without styles that break the flow."""
    return t("article_cache").select("row_id", pagemeta.strip_layout(F.col("content_html")).alias("flat"))


@add(r"""SELECT row_id, regexp_matches(content_html, '<a[^>]*>[^<]{0,4}(?:全文|展开|Read more|Continue reading)[^<]{0,4}</a>\s*(?:</[a-z]+>\s*)*$') AS is_cut, regexp_matches(rtrim(content_html), '</a>\s*(?:</[a-z]+>\s*)*$') AS ends_linked FROM article_cache WHERE content_html IS NOT NULL""")
def truncated_texts(t) -> DataFrame:
    """Pages that end in a link to their full version, and those that end in any link."""
    html = F.col("content_html")
    return t("article_cache").filter(html.isNotNull()).select("row_id", pagemeta.is_truncated(html).alias("is_cut"), F.rtrim(html).rlike(r"</a>\s*(?:</[a-z]+>\s*)*\z").alias("ends_linked"))


@add("SELECT ord, replace(replace('<a href=\"' || replace(url || '&x=1', '&', '&amp;') || '\">' || url || '&x=1', replace(url || '&x=1', '&', '&amp;'), 'L'), url || '&x=1', 'L') AS html FROM list_meta WHERE url <> ''")
def url_variants_replaced(t) -> DataFrame:
    """A URL replaced in both ways it is written."""
    u = F.concat("url", F.lit("&x=1"))
    page = F.concat(F.lit('<a href="'), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit('">'), u)
    return t("list_meta").filter("url <> ''").select("ord", pagemeta.replace_variants(page, u, F.lit("L")).alias("html"))


@add("SELECT row_id, '<h2>' || title || '</h2>' || array_to_string(list_transform(images, lambda x: '<img src=\"' || x || '\">'), '') || '<p>' || coalesce(summary, '') || '</p>' AS html FROM article_item WHERE title IS NOT NULL AND images IS NOT NULL")
def sections_assembled(t) -> DataFrame:
    """Typed sections as HTML."""
    part = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    sections = F.concat(F.array(part("heading", F.col("title"))), F.transform("images", lambda x: part("image", x)), F.array(part("text", F.coalesce("summary", F.lit("")))))
    return t("article_item").filter("title is not null and images is not null").select("row_id", pagemeta.sections_html(sections).alias("html"))


_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace(title, '\\n', chr(10)), '\\r', chr(13)), '\\t', chr(9)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', chr(160)), '&amp;', '&')"


@add(f"SELECT row_id, {sql_trim(_UNESCAPED)} AS decoded FROM article_cache")
def escapes_decoded(t) -> DataFrame:
    """Script escapes and references of titles resolved."""
    return pagemeta.decode_escapes(t("article_cache"), id_col="row_id", text_col="title")


@add(
    f"""SELECT row_id, CASE WHEN regexp_matches({sql_trim('publish_time')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') THEN substr({sql_trim('publish_time')}, 1, 10) || ' ' || substr({sql_trim('publish_time')}, 12, 8)
    WHEN regexp_full_match({sql_trim('publish_time')}, '[0-9]{{10}}') THEN strftime(make_timestamp((CAST({sql_trim('publish_time')} AS BIGINT) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE {sql_trim('publish_time')} END AS shown FROM article_item"""
)
def datetimes_shown(t) -> DataFrame:
    """ISO and epoch times as they are shown."""
    return t("article_item").select("row_id", dates.show_datetime(F.col("publish_time")).alias("shown"))


@add("SELECT ord, CASE WHEN read_num >= 1 THEN CAST(read_num AS BIGINT) * CASE WHEN ord % 2 = 0 THEN 10000 ELSE 1 END END AS declared FROM list_meta")
def declared_counts(t) -> DataFrame:
    """Counts of tab labels."""
    label = F.concat(F.lit("文章 "), F.col("read_num").cast("string"), F.when(F.col("ord") % 2 == 0, F.lit("万")).otherwise(F.lit("")))
    return t("list_meta").select("ord", numbers.declared_count(label).alias("declared"))


@add(
    """WITH m AS (SELECT img, min(row_id) AS name FROM (SELECT row_id, unnest(images) AS img FROM article_item WHERE row_id % 2 = 0) GROUP BY img),
    i AS (SELECT row_id, unnest(images) AS img, unnest(range(1, len(images) + 1)) AS i FROM article_item)
    SELECT row_id, i, coalesce('local/' || name || '.img', img) AS src FROM i LEFT JOIN m USING (img)"""
)
def images_relinked(t) -> DataFrame:
    """Images of articles replaced by stored copies where there are any."""
    one = t("article_item").select("row_id", F.posexplode("images").alias("p", "img"))
    stored = t("article_item").filter("row_id % 2 = 0").select("row_id", F.explode("images").alias("img")).groupBy("img").agg(F.min("row_id").alias("name"))
    src = F.coalesce(F.concat(F.lit("local/"), F.col("name").cast("string"), F.lit(".img")), "img")
    return one.join(stored, "img", "left").select("row_id", (F.col("p") + 1).cast("long").alias("i"), src.alias("src"))


@add("SELECT row_id, i, tags[i] AS tag, images[i] AS img FROM (SELECT row_id, tags, images, unnest(range(1, greatest(len(tags), len(images)) + 1)) AS i FROM article_item WHERE tags IS NOT NULL AND images IS NOT NULL)")
def positional_zip(t) -> DataFrame:
    """Two lists side by side, by position."""
    z = t("article_item").filter("tags is not null and images is not null").select("row_id", F.posexplode(F.arrays_zip("tags", "images")).alias("p", "z"))
    return z.select("row_id", (F.col("p") + 1).cast("long").alias("i"), F.col("z.tags").alias("tag"), F.col("z.images").alias("img"))


@add("SELECT row_id, array_to_string(list_sort(list_distinct(list_intersect(tags, ['数据库', '随笔', '教程', 'notes']))), ',') AS kept FROM article_item WHERE tags IS NOT NULL")
def tags_intersected(t) -> DataFrame:
    """Tags that a given set holds."""
    known = F.array(*[F.lit(x) for x in ("数据库", "随笔", "教程", "notes")])
    return t("article_item").filter("tags is not null").select("row_id", F.array_join(F.sort_array(F.array_intersect("tags", known)), ",").alias("kept"))


@add(
    """WITH l AS (SELECT row_id, unnest(regexp_extract_all(content_html, '<a href="([^"]*)">[^<]+</a>', 1)) AS href, unnest(regexp_extract_all(content_html, '<a href="[^"]*">([^<]+)</a>', 1)) AS label FROM article_cache)
    SELECT row_id, href, label FROM l WHERE regexp_matches(href, '^/(?:p|t)/') AND length(label) > 2 AND NOT regexp_full_match(label, '[0-9]+') AND label NOT IN ('登录', '注册', '下载客户端')"""
)
def article_links(t) -> DataFrame:
    """Links of pages that lead to articles."""
    html = F.col("content_html")
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit('<a href="([^"]*)">[^<]+</a>'), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit('<a href="[^"]*">([^<]+)</a>'), F.lit(1)).alias("label"))
    links = t("article_cache").select("row_id", F.inline(pairs).alias("href", "label"))
    return links.filter(F.col("href").rlike("^/(?:p|t)/") & (F.length("label") > 2) & ~F.col("label").rlike(r"\A[0-9]+\z") & ~F.col("label").isin("登录", "注册", "下载客户端"))


@add("SELECT album_id, biz, coalesce(length(biz) >= 8 AND regexp_full_match(biz, '[A-Za-z0-9+/_=-]+'), false) AS is_valid FROM album")
def account_ids(t) -> DataFrame:
    """Account ids of the right form."""
    ok = F.coalesce((F.length("biz") >= 8) & F.col("biz").rlike(r"\A[A-Za-z0-9+/_=-]+\z"), F.lit(False))
    return t("album").select("album_id", "biz", ok.alias("is_valid"))


@add("SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def unhandled_batches(t) -> DataFrame:
    """Rows of batches that were not handled before."""
    e = t("events")
    return e.join(e.filter("event_type = 'purchase'").select("user_id").distinct(), "user_id", "left_anti").select("event_id")


@add(
    """SELECT row_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS images FROM (SELECT row_id, list_concat(coalesce(regexp_extract_all(content_markdown, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1), []), coalesce(regexp_extract_all(content_html, '<img[^>]+src="([^"]+)"', 1), [])) AS x FROM article_cache)"""
)
def images_of_articles(t) -> DataFrame:
    """Images of each article, each once, in order."""
    md = F.regexp_extract_all(F.coalesce("content_markdown", F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    page = F.regexp_extract_all(F.coalesce("content_html", F.lit("")), F.lit('<img[^>]+src="([^"]+)"'), F.lit(1))
    return t("article_cache").select("row_id", F.array_join(F.array_distinct(F.concat(md, page)), " ").alias("images"))


@add("SELECT row_id, CASE WHEN author IS NOT NULL AND author NOT IN ('互联网博主', '微信公众号', '未知', '', '未知博主', 'Blogger') AND NOT starts_with(title, '[' || author || ']') THEN '[' || author || ']' || title ELSE title END AS title FROM article_cache WHERE title IS NOT NULL")
def author_prefixes(t) -> DataFrame:
    """Titles marked with their author, once."""
    once = text.prefix_author(F.col("title"), F.col("author"), votes.PLACEHOLDER_AUTHORS)
    return t("article_cache").filter("title is not null").select("row_id", text.prefix_author(once, F.col("author"), votes.PLACEHOLDER_AUTHORS).alias("title"))
