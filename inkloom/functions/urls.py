"""Column functions over URLs and what is written in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import trim_ws

URL = r"""https?://[^\s,"'<>]+"""

# Hosts of the platforms in the order in which they are looked for.
PLATFORM_HOSTS = (
    ("csdn.net", "csdn"), ("juejin.cn", "juejin"), ("zhihu.com", "zhihu"), ("cnblogs.com", "cnblogs"), ("51cto.com", "51cto"), ("weibo.com", "weibo"), ("weibo.cn", "weibo"),
    ("blog.sina.com.cn", "sina_blog"), ("jianshu.com", "jianshu"), ("sohu.com", "sohu"), ("baijiahao.baidu.com", "baijiahao"), ("author.baidu.com", "baijiahao"), ("weixin.qq.com", "wechat"),
)


def urls_in(text: Column) -> Column:
    """All URLs of a text in order, punctuation after them dropped."""
    return F.transform(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;，；。]+$", ""))


def detect_platform(text: Column, fallback: str = "custom_urls") -> Column:
    """Platform of a target text: several URLs are a custom set, else the first host in fixed order."""
    n = F.size(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    found = F.when(n > 1, F.lit("custom_urls"))
    lower = F.lower(text)
    for host, platform in PLATFORM_HOSTS:
        found = found.when(lower.contains(host), F.lit(platform))
    return found.otherwise(F.lit(fallback))


def absolute(url: Column, host: str) -> Column:
    """'//x' gets https, '/x' the host."""
    u = trim_ws(url)
    return F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(F.lit(host), u)).otherwise(u)


def without_query(url: Column) -> Column:
    return F.split_part(trim_ws(url), F.lit("?"), F.lit(1))


def canonical_url(url: Column) -> Column:
    """The key two notations of one address share: no scheme, query, fragment, slash at the end or case of host."""
    u = F.regexp_replace(F.regexp_replace(trim_ws(url), r"^(?:[A-Za-z]+:)?//", ""), r"[?#].*$", "")
    u = F.regexp_replace(u, "/+$", "")
    host = F.regexp_extract(u, r"^([^/]*)", 1)
    return F.concat(F.lower(host), F.substr(u, F.length(host) + 1))


def image_original(src: Column) -> Column:
    """Image address without watermark parameters and thumbnail path."""
    s = F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src)).otherwise(src)
    for name in ("x-oss-process=image/watermark", "watermark", "imageMogr2/watermark", "source="):
        s = F.regexp_replace(s, rf"[?&]{name}[^&#]*", "")
    s = F.regexp_replace(s, r"(zhimg\.com)/[0-9a-zA-Z_-]+/(v2-[0-9a-fA-F]+)", "$1/$2")
    return F.regexp_replace(s, r"[?&]$", "")


def parse_pairs(text: Column, sep: str = ";", eq: str = "=") -> Column:
    """``k=v;k=v`` as a map, split at the first sign; of repeated keys the last counts."""
    parts = F.filter(F.split(text, sep), lambda p: F.instr(p, eq) > 1)
    entries = F.transform(parts, lambda p: F.struct(trim_ws(F.split_part(p, F.lit(eq), F.lit(1))).alias("key"), F.substr(p, F.instr(p, eq) + len(eq)).alias("value")))
    # keep the last of equal keys, in an order that a map accepts under any policy
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def unwrap_jsonp(text: Column) -> Column:
    """The JSON inside ``callback(...)``."""
    return F.regexp_extract(text, r"^[ \t\r\n]*[\w$.]+[ \t]*\(((?s).*)\)[ \t]*;?[ \t\r\n]*$", 1)


def hex_tail(text: Column) -> Column:
    """Last eight hexadecimal digits as a number."""
    return F.conv(F.right(text, F.lit(8)), 16, 10).cast("long")


def mime_of(content: Column) -> Column:
    """MIME type by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")
        .when(F.startswith(head, F.lit("89504E47")), "image/png")
        .when(F.startswith(head, F.lit("47494638")), "image/gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.startswith(head, F.lit("424D")), "image/bmp")
        .when(F.startswith(head, F.lit("3C737667")) | F.startswith(head, F.lit("3C3F786D6C")), "image/svg+xml")
        .otherwise("application/octet-stream")
    )


def id_url(url: Column) -> Column:
    """An article's address rebuilt from the number in it, on the site's main host; other addresses stay as they are, trimmed.

    ``/p/7``, ``/read?id=7``, ``/article/7.html``, ``/post/a7/`` and ``/7`` of
    the main and the mobile host are one article.
    """
    bare = F.regexp_replace(F.trim(url), "^(?:[a-z]+:)?//", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?#]+)", 1)), r"^(?:www|m)\.", "")
    number = F.regexp_extract(bare, r"^[^/?#]+/(?:(?:p|post|article|read)(?:/|\?id=))?[a-z]?([0-9]+)(?:\.html)?/?(?:[&?#].*)?$", 1)
    return F.when((host != "") & (number != ""), F.concat(F.lit("https://"), host, F.lit("/p/"), number)).otherwise(F.trim(url))
