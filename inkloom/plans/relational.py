"""Queries of the relational core: dedup, filters, joins, votes, groups, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text, urls
from inkloom.operators import batches, bridges, cache, dedup, reconcile, votes
from inkloom.plans.catalogue import Catalogue, sql_canonical, sql_trim

C = Catalogue()
add = C.add
_KEY = sql_canonical("url")


@add(f"SELECT ord, url FROM (SELECT ord, url, row_number() OVER (PARTITION BY {_KEY} ORDER BY ord) AS rn FROM list_meta) WHERE rn = 1")
def dedup_first_url(t) -> DataFrame:
    """First article of each address."""
    return dedup.first_wins(t("list_meta"), [urls.canonical_url(F.col("url"))], ["ord"]).select("ord", "url")


@add("SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text")
def dedup_exact_text(t) -> DataFrame:
    """First document of each exact text, with its copies."""
    return dedup.exact_classes(t("documents"), "text", "doc_id").select(F.col("first").alias("doc_id"), F.col("n").alias("n_copies"))


@add(
    f"""WITH u AS (SELECT url, 1 AS channel, row_id AS pos FROM article_cache UNION ALL SELECT url, 2, row_id FROM article_item UNION ALL SELECT url, 3, ord FROM list_meta),
    r AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY channel, pos) AS rn FROM u) SELECT channel, pos FROM r WHERE rn = 1"""
)
def dedup_across_channels(t) -> DataFrame:
    """Union of three channels, the first channel's article wins."""
    parts = [("article_cache", "row_id"), ("article_item", "row_id"), ("list_meta", "ord")]
    frames = [t(name).select("url", F.col(pos).alias("pos")) for name, pos in parts]
    return dedup.union_first_wins(frames, [urls.canonical_url(F.col("url"))], ["pos"]).select("channel", "pos")


@add(
    f"""SELECT canonical, max_by(ord, ord) AS last_ord, min(ord) AS first_ord, max_by(title, ord) AS title
    FROM (SELECT *, {_KEY} AS canonical FROM list_meta) GROUP BY canonical"""
)
def dedup_last_card(t) -> DataFrame:
    """The last card of an address at the place of the first."""
    rows = t("list_meta").withColumn("canonical", urls.canonical_url(F.col("url")))
    return rows.groupBy("canonical").agg(F.max("ord").alias("last_ord"), F.min("ord").alias("first_ord"), F.max_by("title", "ord").alias("title"))


@add("SELECT row_id, url FROM (SELECT row_id, url, row_number() OVER (PARTITION BY trim(url) ORDER BY cached_at DESC, row_id DESC) AS rn FROM article_cache) WHERE rn = 1")
def cache_latest(t) -> DataFrame:
    """The cache keyed by trimmed URL: the last write counts."""
    return cache.latest(t("article_cache"), F.trim("url"), ["cached_at", "row_id"]).select("row_id", "url")


@add(
    """WITH n AS (SELECT row_id, url, strftime(fetched_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS wrote, 1 AS new FROM article_item),
    u AS (SELECT row_id, url, cached_at AS wrote, 0 AS new FROM article_cache UNION ALL SELECT * FROM n)
    SELECT row_id, new FROM (SELECT *, row_number() OVER (PARTITION BY trim(url) ORDER BY wrote DESC, new DESC, row_id DESC) AS rn FROM u) WHERE rn = 1"""
)
def cache_upsert(t) -> DataFrame:
    """New rows written into the cache by URL."""
    at = F.date_format(F.col("fetched_at").cast("timestamp") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm:ss")
    new = t("article_item").select("row_id", "url", at.alias("at"), F.lit(1).alias("new"))
    old = t("article_cache").select("row_id", "url", F.col("cached_at").alias("at"), F.lit(0).alias("new"))
    return cache.upsert(old, new, F.trim("url"), ["at", "new", "row_id"]).select("row_id", "new")


@add("SELECT row_id FROM article_cache a WHERE NOT EXISTS (SELECT 1 FROM column_bridge b WHERE trim(b.url) = trim(a.url))")
def cache_delete(t) -> DataFrame:
    """The cache without the rows of given URLs."""
    return cache.delete(t("article_cache"), t("column_bridge"), F.trim("url"), F.trim("url")).select("row_id")


_STALE = r"""(coalesce(contains(content_markdown, '\x0a') OR contains(content_markdown, '\x26'), false) OR coalesce(contains(content_html, 'visibility: hidden'), false) OR coalesce(contains(author, chr(10)), false)
  OR (platform = 'weibo' AND trim(coalesce(content_markdown, '')) = '转发微博' AND coalesce(images_json, '') IN ('', '[]')))"""
_WS_MD = sql_trim("coalesce(content_markdown, '')")
_VALID = f"(NOT {_STALE} AND ({_WS_MD} <> '' OR coalesce(images_json, '') NOT IN ('', '[]')) AND NOT contains(coalesce(content_markdown, ''), '抓取失败') AND NOT contains(coalesce(content_markdown, ''), '内容获取异常'))"


@add(f"SELECT row_id, {_STALE} AS is_stale, {_VALID} AS is_valid FROM article_cache")
def cache_validity(t) -> DataFrame:
    """Which cached rows are stale, and which can be used."""
    return t("article_cache").select("row_id", cache.is_stale().alias("is_stale"), cache.is_valid().alias("is_valid"))


@add(
    f"""WITH c AS (SELECT DISTINCT trim(url) AS url FROM article_cache WHERE {_VALID})
    SELECT ord, c.url IS NOT NULL AS is_hit FROM list_meta l LEFT JOIN c ON c.url = trim(l.url)"""
)
def cache_hit_miss(t) -> DataFrame:
    """A worklist split into cache hits and work."""
    valid = t("article_cache").filter(cache.is_valid())
    return cache.hit_or_miss(t("list_meta"), valid, F.trim("url"), F.trim("url")).select("ord", "is_hit")


@add("SELECT l.ord, a.row_id, a.category FROM list_meta l JOIN article_cache a ON trim(l.url) = trim(a.url)")
def cache_lookup(t) -> DataFrame:
    """Cached rows of a worklist by trimmed URL."""
    a = t("article_cache").select("row_id", "category", F.trim("url").alias("k"))
    return t("list_meta").select("ord", F.trim("url").alias("k")).join(a, "k").select("ord", "row_id", "category")


_OK = f"(NOT coalesce(is_failed, false) AND ({_WS_MD} <> '' OR len(coalesce(images, [])) > 0) AND NOT contains(coalesce(content_markdown, ''), '抓取失败') AND NOT contains(coalesce(content_markdown, ''), '内容获取异常'))"


@add(
    f"""SELECT row_id, CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS status, CAST(len(coalesce(images, [])) AS BIGINT) AS n_images, CAST(length({_WS_MD}) AS BIGINT) AS n_chars,
    CASE WHEN {_OK} THEN NULL ELSE coalesce(nullif({sql_trim('error_reason')}, ''), 'unknown') END AS reason FROM article_item"""
)
def status_projection(t) -> DataFrame:
    """Status row of each article."""
    ok = cache.is_success()
    md = text.trim_ws(F.coalesce("content_markdown", F.lit("")))
    return t("article_item").select(
        "row_id", F.when(ok, "success").otherwise("failed").alias("status"), F.size(F.coalesce("images", F.array().cast("array<string>"))).cast("long").alias("n_images"), F.length(md).cast("long").alias("n_chars"),
        F.when(~ok, F.coalesce(F.nullif(text.trim_ws(F.col("error_reason")), F.lit("")), F.lit("unknown"))).alias("reason"),
    )


@add(f"SELECT count(*) FILTER ({_OK}) AS n_success, count(*) FILTER (NOT {_OK}) AS n_failed FROM article_item")
def success_counts(t) -> DataFrame:
    """Successes and failures in one pass."""
    ok = cache.is_success()
    return t("article_item").agg(F.count_if(ok).alias("n_success"), F.count_if(~ok).alias("n_failed"))


@add(
    """SELECT row_id, url LIKE 'http%' AS is_http, regexp_full_match(id, '[A-Za-z0-9_-]{6,64}') AS has_id,
    length(trim(title)) > 0 AND length(title) <= 120 AND NOT contains(title, chr(10)) AND NOT regexp_matches(title, '^(?:19|20)[0-9]{2}[-/年]') AND title NOT IN ('登录', '注册', '首页') AS has_title,
    contains(lower(title), 'dex') AS is_found FROM article_item"""
)
def row_predicates(t) -> DataFrame:
    """Checks of address, id and title, and the title search."""
    title = F.col("title")
    sane = (F.length(F.trim(title)) > 0) & (F.length(title) <= 120) & ~title.contains("\n") & ~title.rlike("^(?:19|20)[0-9]{2}[-/年]") & ~title.isin("登录", "注册", "首页")
    return t("article_item").select(
        "row_id", F.startswith("url", F.lit("http")).alias("is_http"), F.col("id").rlike(r"\A[A-Za-z0-9_-]{6,64}\z").alias("has_id"), sane.alias("has_title"), F.lower(title).contains("dex").alias("is_found")
    )


@add(
    """SELECT row_id, i, img FROM (SELECT row_id, unnest(images) AS img, unnest(range(1, len(images) + 1)) AS i FROM article_item)
    WHERE NOT (contains(lower(img), 'avatar') OR contains(lower(img), 'icon') OR contains(lower(img), 'qrcode') OR contains(lower(img), 'logo'))"""
)
def image_noise_dropped(t) -> DataFrame:
    """Images without avatars, icons and codes."""
    one = t("article_item").select("row_id", F.posexplode("images").alias("p", "img"))
    noise = F.lower("img").rlike("avatar|icon|qrcode|logo")
    return one.filter(~noise).select("row_id", (F.col("p") + 1).cast("long").alias("i"), "img")


_NAMES = "lower(replace(site_name, ' ', ''))"


@add(
    f"""WITH s AS (SELECT DISTINCT site_name FROM site), q AS (SELECT DISTINCT column_title AS q FROM column_bridge WHERE column_title <> '' UNION SELECT left(site_name, 2) FROM s)
    SELECT q, min(site_name) AS site_name FROM q JOIN s ON contains(lower(site_name), lower(q)) OR contains(lower(q), lower(site_name)) GROUP BY q"""
)
def fuzzy_name_match(t) -> DataFrame:
    """Names that hold a query or are held by it; the first by name."""
    s = t("site").select("site_name").distinct()
    q = t("column_bridge").filter("column_title <> ''").select(F.col("column_title").alias("q")).union(s.select(F.left("site_name", F.lit(2)).alias("q"))).distinct()
    return bridges.contains_either_way(q, s, "q", "site_name", max_names=10_000).groupBy("q").agg(F.min("site_name").alias("site_name"))


# ---- joins
@add(
    """WITH b AS (SELECT url, column_title, row_number() OVER (PARTITION BY url ORDER BY n, column_title) AS rn
      FROM (SELECT trim(url) AS url, trim(column_title) AS column_title, count(*) AS n FROM column_bridge WHERE trim(column_title) <> '' GROUP BY ALL))
    SELECT a.row_id, coalesce(b.column_title, '未分类') AS category FROM article_cache a LEFT JOIN b ON b.url = trim(a.url) AND rn = 1"""
)
def category_first_wins(t) -> DataFrame:
    """One category for each article, the rarest listed first."""
    b = t("column_bridge").select(F.trim("url").alias("k"), F.trim("column_title").alias("column_title")).filter("column_title <> ''").groupBy("k", "column_title").agg(F.count(F.lit(1)).alias("n"))
    return bridges.first_category(t("article_cache").withColumn("k", F.trim("url")), b, "k", "column_title", ["n", "column_title"], "未分类").select("row_id", "category")


_CB = sql_canonical("url")


@add(
    f"""WITH b AS (SELECT {_CB} AS k, array_to_string(list_sort(list_distinct(list(trim(column_title)))), '、') AS cols FROM column_bridge WHERE trim(column_title) <> '' GROUP BY 1)
    SELECT ord, coalesce(b.cols, '') AS columns FROM list_meta l LEFT JOIN b ON b.k = {sql_canonical('l.url')}"""
)
def column_bridge_join(t) -> DataFrame:
    """All columns of each article on one line."""
    b = t("column_bridge").select(urls.canonical_url(F.col("url")).alias("k"), F.trim("column_title").alias("c")).filter("c <> ''")
    return bridges.all_categories(t("list_meta").withColumn("k", urls.canonical_url(F.col("url"))), b, "k", "c").select("ord", F.col("categories").alias("columns"))


@add(
    f"""SELECT k, min(column_title) AS column_title FROM (SELECT {_CB} AS k, trim(column_title) AS column_title FROM column_bridge)
    WHERE k NOT IN (SELECT {_CB} FROM list_meta WHERE url IS NOT NULL) GROUP BY k"""
)
def missing_appended(t) -> DataFrame:
    """Addresses of the bridge that no list has."""
    b = t("column_bridge").select(urls.canonical_url(F.col("url")).alias("k"), F.trim("column_title").alias("column_title"))
    seen = t("list_meta").select(urls.canonical_url(F.col("url")).alias("k"))
    return b.join(seen, "k", "left_anti").groupBy("k").agg(F.min("column_title").alias("column_title"))


@add(
    """WITH r AS (SELECT trim(url) AS k, min_by(author, row_id) AS author, min_by(publish_time, row_id) AS publish_time FROM article_item GROUP BY 1)
    SELECT a.row_id, coalesce(nullif(a.author, ''), r.author) AS author, coalesce(nullif(a.publish_time, ''), r.publish_time) AS publish_time FROM article_cache a LEFT JOIN r ON r.k = trim(a.url)"""
)
def relay_coalesce(t) -> DataFrame:
    """Empty fields filled from relayed rows of the same URL."""
    relay = t("article_item").groupBy(F.trim("url").alias("k")).agg(F.min_by("author", "row_id").alias("r_author"), F.min_by("publish_time", "row_id").alias("r_time"))
    a = t("article_cache").join(relay, F.trim("url") == F.col("k"), "left")
    return a.select("row_id", F.coalesce(F.nullif("author", F.lit("")), "r_author").alias("author"), F.coalesce(F.nullif("publish_time", F.lit("")), "r_time").alias("publish_time"))


@add(
    """WITH m AS (SELECT trim(url) AS k, max_by(nullif(content_type, ''), ord) AS ct, max_by(nullif(column_title, ''), ord) AS col FROM list_meta GROUP BY 1)
    SELECT a.row_id, coalesce(m.ct, a.content_type) AS content_type, coalesce(m.col, a.column_title) AS column_title FROM article_cache a LEFT JOIN m ON m.k = trim(a.url)"""
)
def metadata_override(t) -> DataFrame:
    """List metadata over article metadata, by URL."""
    m = t("list_meta").groupBy(F.trim("url").alias("k")).agg(*[F.max_by(c, F.when(F.col(c) != "", F.col("ord"))).alias(n) for c, n in (("content_type", "ct"), ("column_title", "col"))])
    a = t("article_cache").join(m, F.trim("url") == F.col("k"), "left")
    return a.select("row_id", F.coalesce("ct", "content_type").alias("content_type"), F.coalesce("col", "column_title").alias("column_title"))


@add("SELECT album_id, min(title) AS title, max(coalesce(article_count, 0)) AS article_count, count(*) AS n_seen FROM album GROUP BY album_id")
def album_catalogue(t) -> DataFrame:
    """Albums by id."""
    return t("album").groupBy("album_id").agg(F.min("title").alias("title"), F.max(F.coalesce("article_count", F.lit(0))).alias("article_count"), F.count(F.lit(1)).alias("n_seen"))


@add(
    """WITH n AS (SELECT trim(author) AS author, max(seen_at) AS seen FROM list_meta WHERE trim(author) <> '' GROUP BY 1), o AS (SELECT trim(author) AS author, min(try_cast(cached_at AS TIMESTAMP)) AS seen FROM article_cache WHERE trim(author) <> '' GROUP BY 1),
    u AS (SELECT author, seen, 'new' AS origin FROM n UNION ALL SELECT author, seen, 'old' FROM o WHERE author NOT IN (SELECT author FROM n)) SELECT author, origin FROM u ORDER BY seen DESC NULLS LAST, author LIMIT 100"""
)
def recent_accounts(t) -> DataFrame:
    """Account history: replaced by key, newest hundred."""
    new = t("list_meta").filter("trim(author) <> ''").groupBy(F.trim("author").alias("author")).agg(F.max(F.col("seen_at").cast("timestamp")).alias("at")).withColumn("origin", F.lit("new"))
    old = t("article_cache").filter("trim(author) <> ''").groupBy(F.trim("author").alias("author")).agg(F.min(F.try_to_timestamp("cached_at")).alias("at")).withColumn("origin", F.lit("old"))
    both = new.unionByName(old.join(new.select("author"), "author", "left_anti"))
    return both.orderBy(F.col("at").desc_nulls_last(), "author").limit(100).select("author", "origin")


# ---- votes and groups
_PLACEHOLDERS = "('互联网博主', '微信公众号', '未知', '', '未知博主', 'Blogger')"


@add(
    f"""WITH v AS (SELECT author, count(*) AS n, min(ord) AS first FROM list_meta WHERE author NOT IN {_PLACEHOLDERS} GROUP BY author)
    SELECT arg_max(author, (n, -first)) || CASE WHEN count(*) > 1 THEN '等' ELSE '' END AS author, max(n) AS n FROM v"""
)
def top_author(t) -> DataFrame:
    """Most frequent author; of equals the first seen."""
    top = votes.top_value(t("list_meta").filter(~F.col("author").isin(*votes.PLACEHOLDER_AUTHORS)), "author", "ord")
    return top.select(F.concat("value", F.when(F.col("n_values") > 1, F.lit("等")).otherwise(F.lit(""))).alias("author"), "n")


@add(
    """WITH v AS (SELECT platform, category, count(*) AS n, min(row_id) AS first FROM article_cache WHERE trim(category) <> '' GROUP BY ALL)
    SELECT platform, category, n FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, first) AS rn FROM v) WHERE rn = 1"""
)
def top_category_by_platform(t) -> DataFrame:
    """Most frequent category of each platform."""
    top = votes.top_value(t("article_cache").filter("trim(category) <> ''"), "category", "row_id", by=["platform"])
    return top.select("platform", F.col("value").alias("category"), "n")


@add(f"SELECT platform, count(*) AS n, count(*) FILTER ({_KEY} IS NOT NULL) AS n_urls, min(row_id) AS first_row FROM article_cache GROUP BY platform")
def counts_by_platform(t) -> DataFrame:
    """Rows of each platform in first-seen order."""
    return t("article_cache").groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count("url").alias("n_urls"), F.min("row_id").alias("first_row"))


_KIND = "CASE WHEN nullif(content_type, '') = 'column_article' THEN 'article' ELSE coalesce(nullif(content_type, ''), CASE " + " ".join(f"WHEN starts_with(title, '{p}') THEN '{v}'" for p, v in text.TITLE_TYPES.items()) + " END, 'article') END"


@add(f"WITH k AS (SELECT {_KIND} AS kind FROM list_meta) SELECT count(*) FILTER (kind = 'article') AS n_articles, count(*) FILTER (kind = 'answer') AS n_answers, count(*) FILTER (kind = 'pin') AS n_pins, count(*) AS n FROM k")
def type_counts(t) -> DataFrame:
    """Articles, answers and pins in one pass."""
    kind = text.content_type(F.col("content_type"), F.col("title"))
    return t("list_meta").select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("article", "answer", "pin")], F.count(F.lit(1)).alias("n"))


@add("SELECT count(DISTINCT trim(c)) AS n_columns FROM (SELECT unnest(string_split(column_title, '、')) AS c FROM list_meta) WHERE trim(c) <> ''")
def distinct_columns(t) -> DataFrame:
    """Different columns named in lists."""
    c = t("list_meta").select(F.explode(F.split("column_title", "、")).alias("c")).select(F.trim("c").alias("c"))
    return c.filter("c <> ''").agg(F.count_distinct("c").alias("n_columns"))


@add("SELECT platform, count(DISTINCT category) = 1 AND bool_and(coalesce(trim(category), '') <> '') AS is_single FROM article_cache GROUP BY platform")
def single_category(t) -> DataFrame:
    """Platforms whose articles all have one category."""
    return t("article_cache").groupBy("platform").agg(((F.count_distinct("category") == 1) & F.bool_and(F.coalesce(F.trim("category"), F.lit("")) != "")).alias("is_single"))


@add("SELECT count(DISTINCT img) AS n_images FROM (SELECT unnest(images) AS img FROM article_item UNION ALL SELECT unnest(regexp_extract_all(content_markdown, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1)) FROM article_cache UNION ALL SELECT unnest(regexp_extract_all(content_html, '<img[^>]+src=\"([^\"]+)\"', 1)) FROM article_cache)")
def distinct_images(t) -> DataFrame:
    """Different images of lists, Markdown and pages."""
    c = t("article_cache")
    one = t("article_item").select(F.explode("images").alias("img"))
    two = c.select(F.explode(F.regexp_extract_all("content_markdown", F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))).alias("img"))
    three = c.select(F.explode(F.regexp_extract_all("content_html", F.lit('<img[^>]+src="([^"]+)"'), F.lit(1))).alias("img"))
    return one.union(two).union(three).agg(F.count_distinct("img").alias("n_images"))


@add(
    """WITH d AS (SELECT album_id, max(article_count) AS declared FROM album GROUP BY 1), a AS (SELECT album_id, count(*) AS actual FROM album GROUP BY 1)
    SELECT album_id, declared, actual, CASE WHEN declared IS NULL OR declared = 0 THEN 'unknown' WHEN actual = declared THEN 'equal' WHEN actual < declared THEN 'short' ELSE 'over' END AS verdict,
    coalesce(declared > 0 AND actual < 0.75 * declared, false) AS is_warned FROM d JOIN a USING (album_id)"""
)
def declared_vs_actual(t) -> DataFrame:
    """Declared against counted articles of each album."""
    return reconcile.declared_vs_actual(t("album"), t("album"), "album_id", "article_count")


@add(
    "SELECT min(seen_at) AS first_seen, max(seen_at) AS last_seen, max(seen_at) < TIMESTAMP '2026-01-01' AS may_stop FROM list_meta"
)
def page_date_range(t) -> DataFrame:
    """Span of a page's dates and whether paging may stop."""
    return t("list_meta").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), (F.max("seen_at") < F.lit("2026-01-01").cast("timestamp_ntz")).alias("may_stop"))


# ---- slices, orders, batches
@add("SELECT ord FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM list_meta) WHERE rn BETWEEN 11 AND 60")
def range_slice(t) -> DataFrame:
    """Articles 11 to 60 of a list."""
    return batches.range_slice(t("list_meta"), "ord", 11, 60).select("ord")


@add("SELECT ord, CAST(rn AS BIGINT) AS rn, CAST((rn - 1) // 500 AS BIGINT) AS batch_no, CAST((rn - 1) // 150 + 1 AS BIGINT) AS volume, printf('%02d', rn) AS shown FROM (SELECT ord, row_number() OVER (ORDER BY ord) AS rn FROM list_meta)")
def batch_units(t) -> DataFrame:
    """Batches of 500, volumes of 150 and shown numbers of a list."""
    rows = batches.numbered(t("list_meta").select("ord"), ["ord"], "rn")
    rn = F.col("rn")
    return rows.select("ord", rn.alias("rn"), F.floor((rn - 1) / 500).alias("batch_no"), (F.floor((rn - 1) / 150) + 1).alias("volume"), F.format_string("%02d", rn).alias("shown"))


@add(
    """WITH g AS (SELECT row_id, coalesce(nullif(trim(split_part(column_title, '、', 1)), ''), '未分组') AS unit FROM article_cache),
    n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY row_id) AS rn, count(*) OVER (PARTITION BY unit) AS size FROM g)
    SELECT row_id, unit, CAST(CASE WHEN size > 80 THEN (rn - 1) // 50 ELSE 0 END AS BIGINT) AS part, CAST(rn AS BIGINT) AS rn FROM n"""
)
def export_units(t) -> DataFrame:
    """Groups by first column, large ones in parts."""
    unit = F.coalesce(F.nullif(F.trim(F.split_part("column_title", F.lit("、"), F.lit(1))), F.lit("")), F.lit("未分组"))
    return batches.units(t("article_cache").select("row_id", unit.alias("unit")), "unit", ["row_id"], above=80, size=50).select("row_id", "unit", "part", "rn")


@add("SELECT row_id, title || CASE WHEN rn > 1 THEN ' (' || (rn - 1) || ')' ELSE '' END AS name FROM (SELECT row_id, title, row_number() OVER (PARTITION BY platform, title ORDER BY row_id) AS rn FROM article_cache)")
def collision_suffixes(t) -> DataFrame:
    """Names that repeat in a folder get a number."""
    return batches.collision_names(t("article_cache"), ["platform"], "title", ["row_id"]).select("row_id", "name")


@add("SELECT row_id, like_count, rn FROM (SELECT row_id, like_count, row_number() OVER (ORDER BY coalesce(nullif(like_count, 0), -1) DESC, row_id) AS rn FROM article_item) WHERE rn <= 50")
def top_voted(t) -> DataFrame:
    """Fifty most liked, none and zero last, stable."""
    top = t("article_item").select("row_id", "like_count").orderBy(F.coalesce(F.nullif("like_count", F.lit(0)), F.lit(-1)).desc(), "row_id").limit(50)
    return batches.numbered(top, [F.coalesce(F.nullif("like_count", F.lit(0)), F.lit(-1)).desc(), "row_id"], "rn").select("row_id", "like_count", "rn")


@add(
    """WITH g AS (SELECT coalesce(nullif(trim(category), ''), '未分类') AS name, count(*) AS n FROM article_cache GROUP BY 1), m AS (SELECT site_name AS name, min(host) AS pos FROM site GROUP BY 1)
    SELECT name, n, row_number() OVER (ORDER BY name = '未分类', pos NULLS LAST, name) AS position FROM g LEFT JOIN m USING (name)"""
)
def group_order(t) -> DataFrame:
    """Groups by menu place, then name, the unnamed one last."""
    g = t("article_cache").groupBy(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("未分类")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    m = t("site").groupBy(F.col("site_name").alias("name")).agg(F.min("host").alias("pos"))
    return batches.numbered(g.join(F.broadcast(m), "name", "left"), [F.col("name") == "未分类", F.col("pos").asc_nulls_last(), "name"], "position").select("name", "n", "position")


@add("SELECT url FROM (SELECT DISTINCT trim(url) AS url FROM article_cache INTERSECT SELECT DISTINCT trim(url) FROM article_item EXCEPT SELECT trim(url) FROM column_bridge)")
def set_operations(t) -> DataFrame:
    """Addresses in cache and items but in no column."""
    u = lambda name: t(name).select(F.trim("url").alias("url"))
    return u("article_cache").intersect(u("article_item")).subtract(u("column_bridge"))


@add(
    """WITH e AS (SELECT user_id, ts, event_id, value <= 20 AS empty FROM events),
    g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, empty ORDER BY ts, event_id) AS grp FROM e)
    SELECT user_id, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM g WHERE empty GROUP BY ALL) GROUP BY user_id"""
)
def consecutive_empty_runs(t) -> DataFrame:
    """Longest run of empty rounds of each user."""
    return batches.longest_runs(t("events"), "user_id", ["ts", "event_id"], F.col("value") <= 20)


@add("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_state_per_key(t) -> DataFrame:
    """Latest event of each user."""
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))
