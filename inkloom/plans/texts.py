"""Queries of the row-wise text, URL, number and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import dates, numbers, text, urls
from inkloom.plans.catalogue import Catalogue, sql_canonical, sql_squeeze, sql_trim

C = Catalogue()
add = C.add
_T = sql_squeeze("title")
_HALF = f"CAST((length({_T}) - 1) // 2 AS INTEGER)"


@add(
    f"""SELECT ord, CASE WHEN length({_T}) % 2 = 1 AND substr({_T}, {_HALF} + 1, 1) = ' ' AND substr({_T}, 1, {_HALF}) = substr({_T}, {_HALF} + 2, {_HALF})
    THEN substr({_T}, 1, {_HALF}) ELSE {_T} END AS title FROM list_meta"""
)
def title_undoubled(t) -> DataFrame:
    """Titles written twice become one."""
    return t("list_meta").select("ord", text.undouble(F.col("title")).alias("title"))


_RES = "[\\\\/:*?\"<>|]"


def _safe(x: str, default: str) -> str:
    c = sql_trim(f"regexp_replace({x}, '{_RES}', '_', 'g')")
    return f"CASE WHEN {c} = '' THEN '{default}' ELSE coalesce({c}, '{default}') END"


@add(f"SELECT row_id, substr({_safe('title', 'untitled')}, 1, 45) AS file_name FROM article_item")
def safe_file_names(t) -> DataFrame:
    """File names from titles."""
    return t("article_item").select("row_id", text.safe_filename(F.col("title"), limit=45).alias("file_name"))


@add(
    f"""SELECT row_id, concat_ws('_', CASE WHEN {sql_trim('category')} <> '' THEN {_safe('category', 'untitled')} END, {_safe('author', 'author')}, {_safe('platform', 'platform')}) AS prefix
    FROM article_cache"""
)
def file_prefixes(t) -> DataFrame:
    """Prefix of an article's export files."""
    return t("article_cache").select("row_id", text.file_prefix(F.col("category"), F.col("author"), F.col("platform")).alias("prefix"))


@add(
    r"""SELECT ord, lower(regexp_replace(regexp_replace(ord || '-' || coalesce(title, ''), '[^\p{L}\p{N}_\-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS anchor,
    replace(replace(coalesce(title, ''), '[', '\['), ']', '\]') AS label FROM list_meta"""
)
def anchors(t) -> DataFrame:
    """Contents entries: link target and escaped label."""
    title = F.coalesce("title", F.lit(""))
    return t("list_meta").select("ord", text.anchor(F.concat_ws("-", "ord", title)).alias("anchor"), text.escape_brackets(title).alias("label"))


@add(
    """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped,
    '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM documents"""
)
def escaped_and_quoted(t) -> DataFrame:
    """Texts escaped for HTML and quoted for Markdown."""
    return t("documents").select("doc_id", text.escape_html(F.col("text")).alias("escaped"), text.quote_lines(F.col("text")).alias("quoted"))


_LEADS = (
    f"({sql_trim('line')} = '' OR coalesce(lower({sql_trim(f'''regexp_replace({sql_trim('line')}, '^#+[ \t]*', '')''')}) = lower({sql_trim('title')}), false)"
    f" OR coalesce(title <> '' AND starts_with({sql_trim('line')}, title), false))"
)


@add(
    f"""WITH l AS (SELECT row_id, title, unnest(string_split(coalesce(content_markdown, ''), chr(10))) AS line,
      unnest(range(1, len(string_split(coalesce(content_markdown, ''), chr(10))) + 1)) AS i FROM article_cache),
    f AS (SELECT row_id, min(i) AS first FROM l WHERE NOT {_LEADS} GROUP BY row_id),
    b AS (SELECT l.row_id, string_agg(line, chr(10) ORDER BY i) AS body FROM l JOIN f USING (row_id) WHERE i >= first GROUP BY l.row_id)
    SELECT a.row_id, coalesce({sql_trim('body')}, '') AS body FROM article_cache a LEFT JOIN b USING (row_id)"""
)
def leading_title_stripped(t) -> DataFrame:
    """Bodies without the title they begin with."""
    return t("article_cache").select("row_id", text.strip_leading_title(F.col("content_markdown"), F.col("title")).alias("body"))


_PLAIN = sql_trim(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content_markdown, '!\[[^\]\n]*\]\([^)\n]*\)', '', 'g'), '\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '#{1,6}[ \t]*', '', 'g'), '[`*_~]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)


@add(f"SELECT row_id, {_PLAIN} AS plain FROM article_cache")
def markdown_plain_text(t) -> DataFrame:
    """Plain text of Markdown bodies."""
    return t("article_cache").select("row_id", text.markdown_to_text(F.col("content_markdown")).alias("plain"))


@add(
    f"""SELECT row_id, array_to_string(list_transform(list_filter(tags, lambda x: {sql_trim('x')} <> ''), lambda x: '#' || regexp_replace({sql_trim('x')}, '^#+', '')), '   ') AS tag_line
    FROM article_item"""
)
def tag_lines(t) -> DataFrame:
    """Tags on one line."""
    return t("article_item").select("row_id", text.tag_line(F.col("tags")).alias("tag_line"))


@add(
    """SELECT row_id, CASE WHEN length(summary) > 60 THEN substr(summary, 1, 60) || '...' ELSE summary END AS short_summary,
    CASE WHEN length(title) > 40 THEN substr(title, 1, 38) || '...' ELSE title END AS short_title FROM article_cache"""
)
def shortened(t) -> DataFrame:
    """Summaries and titles cut to their limits."""
    return t("article_cache").select("row_id", text.shorten(F.col("summary"), 60).alias("short_summary"), text.shorten(F.col("title"), 40, keep=38).alias("short_title"))


@add(
    rf"""SELECT row_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(content_html, '(?i)<br[ \t]*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), chr(10)),
    lambda x: {sql_trim('x')}), lambda x: x <> '')[1] AS first_line, CAST(length(regexp_replace(content_html, '<[^>]+>', '', 'g')) AS BIGINT) AS n_text FROM article_cache"""
)
def first_lines(t) -> DataFrame:
    """First line of each page and the length of its text."""
    html = F.col("content_html")
    return t("article_cache").select("row_id", text.first_line(html).alias("first_line"), text.text_length(html).cast("long").alias("n_text"))


@add(
    f"""SELECT s.host, a.row_id, {sql_trim("split_part(split_part(regexp_replace(a.title || ' - ' || s.site_name, '(?:_博客| - 官网).*$', ''), ' - ', 1), ' | ', 1)")} AS title
    FROM article_cache a JOIN site s ON s.host = lower(regexp_extract(trim(a.url), '://([^/?#]+)', 1))"""
)
def site_suffix_stripped(t) -> DataFrame:
    """Page titles without the site's name."""
    a, s = t("article_cache"), t("site")
    joined = a.join(F.broadcast(s), s["host"] == F.lower(F.regexp_extract(F.trim("url"), "://([^/?#]+)", 1)))
    return joined.select("host", "row_id", text.strip_site_suffix(F.concat("title", F.lit(" - "), "site_name"), ["_博客", " - 官网"]).alias("title"))


@add(
    f"""SELECT row_id, {sql_trim(r"regexp_replace(author, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")} AS author FROM article_cache"""
)
def controls_stripped(t) -> DataFrame:
    """Authors without control characters."""
    return t("article_cache").select("row_id", text.strip_controls(F.col("author")).alias("author"))


_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.PLATFORM_NAMES.items())


@add(f"SELECT host, CASE WHEN coalesce({sql_trim('platform')}, '') = '' THEN '{text.UNNAMED_PLATFORM}' ELSE CASE lower({sql_trim('platform')}) {_NAMES} ELSE {sql_trim('platform')} END END AS shown FROM site")
def platform_names(t) -> DataFrame:
    """Shown names of platforms."""
    return t("site").select("host", text.platform_name(F.col("platform")).alias("shown"))


_BY_TITLE = " ".join(f"WHEN starts_with(title, '{p}') THEN '{v}'" for p, v in text.TITLE_TYPES.items())
_PREFIXES = "|".join(sorted(text.TITLE_TYPES, key=len, reverse=True))
_TYPE = f"CASE WHEN nullif(content_type, '') = 'column_article' THEN 'article' ELSE coalesce(nullif(content_type, ''), CASE {_BY_TITLE} END, 'article') END"


@add(f"SELECT ord, {_TYPE} AS kind, regexp_replace(title, '^(?:{_PREFIXES})', '') AS bare_title FROM list_meta")
def content_types(t) -> DataFrame:
    """Content types by given value or title prefix, and titles without it."""
    return t("list_meta").select("ord", text.content_type(F.col("content_type"), F.col("title")).alias("kind"), text.strip_title_type(F.col("title")).alias("bare_title"))


@add("SELECT c_custkey, CASE WHEN length(c_name) > 6 THEN left(c_name, 3) || '****' || right(c_name, 3) ELSE c_name END AS masked FROM customer")
def masked_names(t) -> DataFrame:
    """Names with their middle hidden."""
    return t("customer").select("c_custkey", text.mask(F.col("c_name")).alias("masked"))


@add("SELECT p_partkey, CAST(list_sum(list_transform(string_split(p_name, ''), lambda x: CAST(ascii(x) AS BIGINT))) % 6 AS BIGINT) AS bucket FROM part")
def name_buckets(t) -> DataFrame:
    """Deterministic buckets of names."""
    return t("part").select("p_partkey", text.bucket_of(F.col("p_name"), 6).alias("bucket"))


@add(
    f"""WITH l AS (SELECT row_id, unnest(string_split(content_markdown, chr(10))) AS line, unnest(range(1, len(string_split(content_markdown, chr(10))) + 1)) AS line_no FROM article_cache)
    SELECT row_id, CAST(line_no AS BIGINT) AS line_no, array_to_string(list_transform(string_split(regexp_replace({sql_trim('line')}, '^\\||\\|$', '', 'g'), '|'), lambda x: {sql_trim('x')}), chr(9)) AS cells
    FROM l WHERE starts_with({sql_trim('line')}, '|') AND NOT regexp_matches({sql_trim('line')}, '^\\|?[-:| ]+\\|?$')"""
)
def table_rows(t) -> DataFrame:
    """Cells of all table rows in Markdown bodies."""
    lines = t("article_cache").select("row_id", F.posexplode(F.split("content_markdown", "\n")).alias("i", "line"))
    rows = lines.select("row_id", (F.col("i") + 1).cast("long").alias("line_no"), text.table_cells(F.col("line")).alias("c")).filter(F.col("c").isNotNull())
    return rows.select("row_id", "line_no", F.array_join("c", "\t").alias("cells"))


@add(
    f"""SELECT row_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
    FROM (SELECT row_id, string_split({sql_squeeze("coalesce(author, '') || ' ' || coalesce(author, '')")}, ' ') AS w FROM article_cache)"""
)
def distinct_author_words(t) -> DataFrame:
    """Words of an author's name, each once, in order."""
    twice = F.concat_ws(" ", F.coalesce("author", F.lit("")), F.coalesce("author", F.lit("")))
    return t("article_cache").select("row_id", text.distinct_words(twice).alias("words"))


# ---- numbers
_SHOWN = """CASE WHEN {n} >= 10000 THEN CAST(CAST(round(CAST({n} AS DECIMAL(20,0)) / 1000, 0) AS BIGINT) // 10 AS VARCHAR) ||
    CASE WHEN CAST(round(CAST({n} AS DECIMAL(20,0)) / 1000, 0) AS BIGINT) % 10 <> 0 THEN '.' || CAST(CAST(round(CAST({n} AS DECIMAL(20,0)) / 1000, 0) AS BIGINT) % 10 AS VARCHAR) ELSE '' END || '万'
    ELSE CAST({n} AS VARCHAR) END"""


@add(f"SELECT row_id, {_SHOWN.format(n='read_num')} AS shown_reads, {_SHOWN.format(n='like_count')} AS shown_likes FROM article_item")
def shown_counts(t) -> DataFrame:
    """Counters as they are shown."""
    return t("article_item").select("row_id", numbers.show_count(F.col("read_num")).alias("shown_reads"), numbers.show_count(F.col("like_count")).alias("shown_likes"))


@add(
    """WITH w AS (SELECT ord, CASE WHEN ord % 4 = 0 THEN CAST(read_num AS VARCHAR) || '万' WHEN ord % 4 = 1 THEN CAST(read_num AS VARCHAR) || 'k' WHEN ord % 4 = 2 THEN ' ' || CAST(read_num AS VARCHAR) || ',000' ELSE 'n' || CAST(read_num AS VARCHAR) END AS s FROM list_meta)
    SELECT ord, CASE WHEN s IS NULL THEN 0 WHEN ord % 4 = 0 THEN CAST(regexp_extract(s, '[0-9]+') AS BIGINT) * 10000 WHEN ord % 4 = 1 THEN CAST(regexp_extract(s, '[0-9]+') AS BIGINT) * 1000
    WHEN ord % 4 = 2 THEN CAST(replace(trim(s), ',', '') AS BIGINT) ELSE 0 END AS n FROM w"""
)
def parsed_counts(t) -> DataFrame:
    """Counts read from how people write them."""
    n = F.col("read_num").cast("string")
    s = F.when(F.col("ord") % 4 == 0, F.concat(n, F.lit("万"))).when(F.col("ord") % 4 == 1, F.concat(n, F.lit("k"))).when(F.col("ord") % 4 == 2, F.concat(F.lit(" "), n, F.lit(",000"))).otherwise(F.concat(F.lit("n"), n))
    return t("list_meta").select("ord", numbers.parse_count(s).alias("n"))


@add(
    """SELECT row_id, CASE WHEN like_count IS NOT NULL THEN CAST(like_count AS BIGINT) * CASE WHEN row_id % 2 = 0 THEN 10000 ELSE 1 END ELSE NULL END AS votes FROM article_item"""
)
def parsed_votes(t) -> DataFrame:
    """Votes read from button labels."""
    label = F.when(F.col("like_count").isNotNull(), F.concat(F.lit("赞同 "), F.col("like_count").cast("string"), F.when(F.col("row_id") % 2 == 0, F.lit(" 万")).otherwise(F.lit(""))))
    return t("article_item").select("row_id", numbers.parse_votes(label).alias("votes"))


# ---- URLs
@add(
    f"""WITH u AS (SELECT ord, unnest(regexp_extract_all(coalesce(title, '') || ' ' || url || '; ' || url || '。', 'https?://[^\\s,"''<>]+')) AS x,
      unnest(range(1, len(regexp_extract_all(coalesce(title, '') || ' ' || url || '; ' || url || '。', 'https?://[^\\s,"''<>]+')) + 1)) AS i FROM list_meta),
    c AS (SELECT regexp_replace(x, '[.,;，；。]+$', '') AS url, ord * 10 + i AS pos FROM u)
    SELECT url, CAST(min(pos) AS BIGINT) AS first_at FROM c GROUP BY url"""
)
def url_list(t) -> DataFrame:
    """URLs found in free text, each at its first place."""
    free = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "url", F.lit("; "), "url", F.lit("。"))
    found = t("list_meta").select("ord", F.posexplode(urls.urls_in(free)).alias("i", "url"))
    return found.groupBy("url").agg(F.min(F.col("ord") * 10 + F.col("i") + 1).cast("long").alias("first_at"))


_HOSTS = " ".join(f"WHEN contains(lower(x), '{h}') THEN '{p}'" for h, p in urls.PLATFORM_HOSTS)


@add(
    f"""WITH u AS (SELECT ord, CASE WHEN ord % 7 = 0 THEN replace(trim(url), '.blogs.example', '.com') || ' ' || trim(url) ELSE replace(trim(url), '.blogs.example', '.com') END AS x FROM list_meta)
    SELECT ord, CASE WHEN len(regexp_extract_all(x, 'https?://[^\\s,"''<>]+')) > 1 THEN 'custom_urls' {_HOSTS} ELSE 'custom_urls' END AS platform FROM u"""
)
def detected_platforms(t) -> DataFrame:
    """Platform of each target text."""
    one = F.replace(F.trim("url"), F.lit(".blogs.example"), F.lit(".com"))
    x = F.when(F.col("ord") % 7 == 0, F.concat_ws(" ", one, F.trim("url"))).otherwise(one)
    return t("list_meta").select("ord", urls.detect_platform(x).alias("platform"))


@add(f"SELECT ord, {sql_canonical('url')} AS canonical, split_part({sql_trim('url')}, '?', 1) AS bare FROM list_meta")
def canonical_urls(t) -> DataFrame:
    """The key of each address, and the address without query."""
    return t("list_meta").select("ord", urls.canonical_url(F.col("url")).alias("canonical"), urls.without_query(F.col("url")).alias("bare"))


@add(
    """WITH h AS (SELECT row_id, unnest(regexp_extract_all(content_html, 'href="([^"]*)"', 1)) AS x FROM article_cache)
    SELECT row_id, CASE WHEN starts_with(x, '//') THEN 'https:' || x WHEN starts_with(x, '/') THEN 'https://site.example' || x ELSE x END AS link, count(*) AS n FROM h GROUP BY ALL"""
)
def absolute_links(t) -> DataFrame:
    """Links of each page, made absolute."""
    links = t("article_cache").select("row_id", F.explode(F.regexp_extract_all("content_html", F.lit('href="([^"]*)"'), F.lit(1))).alias("x"))
    return links.groupBy("row_id", urls.absolute(F.col("x"), "https://site.example").alias("link")).agg(F.count(F.lit(1)).alias("n"))


@add(
    """SELECT row_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN starts_with(x, '//') THEN 'https:' || x ELSE x END,
    '[?&]x-oss-process=image/watermark[^&#]*', '', 'g'), '[?&]watermark[^&#]*', '', 'g'), '[?&]imageMogr2/watermark[^&#]*', '', 'g'), '[?&]source=[^&#]*', '', 'g'),
    '(zhimg\\.com)/[0-9a-zA-Z_-]+/(v2-[0-9a-fA-F]+)', '\\1/\\2', 'g'), '[?&]$', '') AS original
    FROM (SELECT row_id, unnest(images) AS x, unnest(range(1, len(images) + 1)) AS i FROM article_item)"""
)
def original_images(t) -> DataFrame:
    """Addresses of the original images."""
    one = t("article_item").select("row_id", F.posexplode("images").alias("i", "x"))
    return one.select("row_id", (F.col("i") + 1).cast("long").alias("i"), urls.image_original(F.col("x")).alias("original"))


@add(
    """WITH p AS (SELECT event_id, user_id, 'user=' || user_id || '; type=' || event_type || '=x; user=' || (user_id + 1) || ';flag' AS s FROM events)
    SELECT event_id, CAST(user_id + 1 AS VARCHAR) AS user, regexp_extract(s, 'type=([^;]*)', 1) AS kind FROM p"""
)
def parsed_pairs(t) -> DataFrame:
    """``k=v`` pairs: split at the first sign, the last of equal keys counts."""
    s = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("; type="), "event_type", F.lit("=x; user="), (F.col("user_id") + 1).cast("string"), F.lit(";flag"))
    m = t("events").select("event_id", urls.parse_pairs(s).alias("m"))
    return m.select("event_id", F.col("m")["user"].alias("user"), F.col("m")["type"].alias("kind"))


@add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def unwrapped_json(t) -> DataFrame:
    """JSON inside a callback."""
    body = urls.unwrap_jsonp(F.concat(F.lit("callback_1("), "props", F.lit(");")))
    return t("events").select("event_id", F.get_json_object(body, "$.k").cast("long").alias("k"))


@add("SELECT doc_id, CAST(('0x' || right(md5(text), 8)) AS BIGINT) AS number FROM documents")
def hex_tails(t) -> DataFrame:
    """Last hexadecimal digits of a hash as a number."""
    return t("documents").select("doc_id", urls.hex_tail(F.md5("text")).alias("number"))


@add(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/bmp' ELSE 'application/octet-stream' END AS mime FROM documents"""
)
def sniffed_types(t) -> DataFrame:
    """MIME types by first bytes."""
    heads = ("FFD8FFE0", "89504E470D0A", "474946383961", "524946460000000057454250", "424D00", "00112233")
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 6 + 1).cast("int")))
    return t("documents").select("doc_id", urls.mime_of(content).alias("mime"))


# ---- dates
_AS_OF = "DATE '2025-11-20'"
_YMD = "([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})"


def _sql_day(y: str, m: str, d: str) -> str:
    return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


_MONTHS = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"


def _sql_date(s: str) -> str:
    def x(p: str, i: int) -> str:
        return f"regexp_extract({s}, '{p}', {i})"

    md, mail, tail = "^([0-9]{1,2})[-/月]([0-9]{1,2})", f"([0-9]{{1,2}}) {_MON} ([0-9]{{4}})", f"{_MON} ([0-9]{{1,2}}) .*([0-9]{{4}})$"
    mon = lambda name: f"CAST((strpos({_MONTHS}, {name}) + 2) // 3 AS VARCHAR)"
    year = f"CAST(year({_AS_OF}) AS VARCHAR)"
    before = f"CAST(year({_AS_OF}) - 1 AS VARCHAR)"
    return f"""coalesce({_sql_day(x(_YMD, 1), x(_YMD, 2), x(_YMD, 3))},
    CASE WHEN regexp_full_match({s}, '[0-9]{{13}}') THEN DATE '1970-01-01' + CAST(floor((CAST(try_cast({s} AS BIGINT) AS DOUBLE) / 1000 + 28800) / 86400) AS INTEGER) END,
    CASE WHEN regexp_full_match({s}, '[0-9]{{10}}') THEN DATE '1970-01-01' + CAST((try_cast({s} AS BIGINT) + 28800) // 86400 AS INTEGER) END,
    CASE WHEN regexp_matches({s}, '{md}') THEN CASE WHEN {_sql_day(year, x(md, 1), x(md, 2))} <= {_AS_OF} THEN {_sql_day(year, x(md, 1), x(md, 2))} ELSE {_sql_day(before, x(md, 1), x(md, 2))} END END,
    CASE WHEN regexp_matches({s}, '{mail}') THEN {_sql_day(x(mail, 3), mon(x(mail, 2)), x(mail, 1))} END,
    CASE WHEN regexp_matches({s}, '{tail}') THEN {_sql_day(x(tail, 3), mon(x(tail, 1)), x(tail, 2))} END,
    CASE WHEN regexp_matches({s}, '^刚刚|^今天') THEN {_AS_OF} WHEN regexp_matches({s}, '^昨天') THEN {_AS_OF} - 1 WHEN regexp_matches({s}, '^前天') THEN {_AS_OF} - 2 END,
    CASE WHEN regexp_matches({s}, '^[0-9]+ ?(?:分钟|小时)前') THEN {_AS_OF} WHEN regexp_matches({s}, '^[0-9]{{1,4}} ?天前') THEN {_AS_OF} - CAST(regexp_extract({s}, '^([0-9]{{1,4}})', 1) AS INTEGER) END)"""


def as_of():
    """The day the queries take for today."""
    return F.lit("2025-11-20").cast("date")


@add(f"SELECT row_id, CAST({_sql_date(sql_trim('publish_time'))} AS VARCHAR) AS day FROM article_item")
def fuzzy_dates(t) -> DataFrame:
    """Days of written times."""
    return t("article_item").select("row_id", dates.fuzzy_date(F.col("publish_time"), as_of()).cast("string").alias("day"))


@add(
    f"""WITH d AS (SELECT ord, {_sql_date(sql_trim("coalesce(nullif(publish_time, ''), create_time)"))} AS day FROM list_meta)
    SELECT ord, CAST(day AS VARCHAR) AS day, day IS NULL AS is_unknown FROM d WHERE day IS NULL OR day BETWEEN DATE '2023-01-01' AND DATE '2024-06-30'"""
)
def date_range_kept(t) -> DataFrame:
    """Articles in a range of days; unreadable dates are kept."""
    day = dates.fuzzy_date(F.coalesce(F.nullif("publish_time", F.lit("")), "create_time"), as_of())
    rows = t("list_meta").select("ord", day.alias("day"))
    kept = rows.filter(F.col("day").isNull() | F.col("day").between(F.lit("2023-01-01").cast("date"), F.lit("2024-06-30").cast("date")))
    return kept.select("ord", F.col("day").cast("string").alias("day"), F.col("day").isNull().alias("is_unknown"))


@add(
    f"""WITH d AS (SELECT {_sql_date(sql_trim("coalesce(nullif(publish_time, ''), create_time)"))} AS day FROM list_meta)
    SELECT count(*) AS n_all, count(*) FILTER (day IS NULL) AS n_unknown, count(*) FILTER (day < DATE '2023-01-01' OR day > DATE '2024-06-30') AS n_removed FROM d"""
)
def date_range_counts(t) -> DataFrame:
    """How many a range of days keeps, removes and cannot tell."""
    day = dates.fuzzy_date(F.coalesce(F.nullif("publish_time", F.lit("")), "create_time"), as_of())
    out = (F.col("day") < F.lit("2023-01-01").cast("date")) | (F.col("day") > F.lit("2024-06-30").cast("date"))
    return t("list_meta").select(day.alias("day")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("day").isNull()).alias("n_unknown"), F.count_if(out).alias("n_removed"))


@add("SELECT row_id, regexp_extract(coalesce(publish_time, ''), '([0-9]{4}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?)', 1) AS found FROM article_item")
def found_dates(t) -> DataFrame:
    """First full date in a text."""
    return t("article_item").select("row_id", dates.date_part(F.coalesce("publish_time", F.lit(""))).alias("found"))


@add(
    f"""SELECT row_id, CASE WHEN regexp_full_match({sql_trim('publish_time')}, '[0-9]{{10}}') THEN strftime(make_timestamp((CAST({sql_trim('publish_time')} AS BIGINT) + 28800) * 1000000), '%Y-%m-%d %H:%M:%S')
    WHEN regexp_full_match({sql_trim('publish_time')}, '[0-9]{{13}}') THEN strftime(make_timestamp((CAST({sql_trim('publish_time')} AS BIGINT) // 1000 + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') ELSE '' END AS shown FROM article_item"""
)
def shown_epochs(t) -> DataFrame:
    """Epoch times as they are shown."""
    return t("article_item").select("row_id", dates.show_epoch(F.col("publish_time")).alias("shown"))
