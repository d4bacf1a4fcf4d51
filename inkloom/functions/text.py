"""Column functions over titles, lines, Markdown and file names.

Patterns keep to what Java and RE2 read alike; white space is spelt out (WS),
as neither engine's ``\\s`` holds the ideographic or the no-break blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Unicode counts as white space.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same characters, for native trims.
WS_CHARS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Characters file systems reserve.
RESERVED = r'[\\/:*?"<>|]'

# Names by which the platforms are shown, by their internal mark.
PLATFORM_NAMES = {
    "wechat": "微信公众号", "sina_blog": "新浪博客", "jianshu": "简书", "csdn": "CSDN 博客", "zhihu": "知乎", "weibo": "新浪微博",
    "juejin": "稀土掘金", "cnblogs": "博客园", "51cto": "51CTO", "sohu": "搜狐号", "baijiahao": "百家号", "custom_urls": "网页合集",
}
UNNAMED_PLATFORM = "网页文章"
# Title prefixes and the content type each one means.
TITLE_TYPES = {"【专栏】": "article", "【专栏文章】": "article", "【文章】": "article", "【回答】": "answer", "【想法】": "pin"}


def trim_ws(text: Column) -> Column:
    """Strip all Unicode white space from both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once for each row: inside lambdas an outer expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def squeeze(text: Column) -> Column:
    """Trim, and make every run of white space one blank."""
    return trim_ws(F.regexp_replace(text, f"[{WS}]+", " "))


def blank_to_null(text: Column) -> Column:
    return F.when(trim_ws(text) != "", text)


def undouble(title: Column) -> Column:
    """A title written twice ('T T') becomes one; others are only squeezed."""
    t = squeeze(title)
    half = ((F.length(t) - 1) / 2).cast("int")
    left, right = F.substring(t, F.lit(1), half), F.substring(t, half + 2, half)
    doubled = (F.length(t) % 2 == 1) & (F.substring(t, half + 1, F.lit(1)) == " ") & (left == right)
    return F.when(doubled, left).otherwise(t)


def safe_filename(name: Column, default: str = "untitled", limit: int | None = None) -> Column:
    """Reserved characters become '_', blanks go from the ends, nothing left becomes ``default``."""
    clean = trim_ws(F.regexp_replace(name, RESERVED, "_"))
    clean = F.when(clean == "", F.lit(default)).otherwise(F.coalesce(clean, F.lit(default)))
    return F.substring(clean, 1, limit) if limit else clean


def file_prefix(category: Column, author: Column, platform: Column) -> Column:
    """``category_author_platform``, without the category if it is blank."""
    cat = blank_to_null(category)
    return F.concat_ws("_", F.when(cat.isNotNull(), safe_filename(cat)), safe_filename(author, "author"), safe_filename(platform, "platform"))


def anchor(text: Column) -> Column:
    """Link target of a heading: runs of anything but letters, digits, '_' and '-' become '-'."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\-]+", "-"), r"^-+|-+$", ""))


def escape_brackets(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def escape_html(text: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(ref))
    return text


def quote_lines(text: Column) -> Column:
    """Each line as a Markdown quotation."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")


def strip_leading_title(body: Column, title: Column) -> Column:
    """A body without the blank lines and title lines it begins with."""

    def stripped(lines: Column, named: Column) -> Column:
        def leads(bare: Column) -> Column:
            no_hash = F.when(F.startswith(bare, F.lit("#")), trim_ws(F.regexp_replace(bare, f"^#+[{WS}]*", ""))).otherwise(bare)
            return (bare == "") | (F.lower(no_hash) == named["lower"]) | ((named["title"] != "") & F.startswith(bare, named["title"]))

        first = F.array_min(F.transform(F.transform(lines, trim_ws), lambda bare, i: F.when(~F.coalesce(leads(bare), F.lit(False)), i)))
        rest = let(first, lambda at: F.when(at.isNotNull(), trim_ws(F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))))
        return F.coalesce(rest, F.lit(""))

    named = F.struct(F.lower(trim_ws(title)).alias("lower"), title.alias("title"))
    return let(F.split(F.coalesce(body, F.lit("")), "\n"), lambda lines: let(named, lambda n: stripped(lines, n)))


def markdown_to_text(md: Column) -> Column:
    """Plain text of Markdown: no images, links by their text, no heading or emphasis marks."""
    for pattern, to in ((r"!\[[^\]\n]*\]\([^)\n]*\)", ""), (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"#{1,6}[ \t]*", ""), (r"[`*_~]", ""), (r"\n{3,}", "\n\n")):
        md = F.regexp_replace(md, pattern, to)
    return trim_ws(md)


def markdown_to_text_gently(md: Column) -> Column:
    """Like ``markdown_to_text`` but only heads of lines lose '#', and only paired emphasis marks go."""
    for pattern, to in ((r"!\[[^\]\n]*\]\([^)\n]*\)", ""), (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"), (r"(?m)^#{1,6}[ \t]+", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"`([^`\n]+)`", "$1"), (r"\n{3,}", "\n\n")):
        md = F.regexp_replace(md, pattern, to)
    return trim_ws(md)


def tag_line(tags: Column) -> Column:
    """Tags as '#a   #b', without their own marks, blanks left out."""
    bare = F.transform(F.filter(tags, lambda t: trim_ws(t) != ""), lambda t: F.concat(F.lit("#"), F.regexp_replace(trim_ws(t), "^#+", "")))
    return F.array_join(bare, "   ")


def shorten(text: Column, limit: int, mark: str = "...", keep: int | None = None) -> Column:
    """A text over ``limit`` characters cut to ``keep`` (default ``limit``) and marked."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep or limit), F.lit(mark))).otherwise(text)


def first_line(text: Column) -> Column:
    """First line with text: <br> ends a line, tags go."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)<br[ \t]*/?>", "\n"), r"<[^>]+>", "")
    lines = F.filter(F.transform(F.split(plain, "\n"), trim_ws), lambda x: x != "")
    return F.try_element_at(lines, F.lit(1))


def strip_site_suffix(title: Column, suffixes: list[str]) -> Column:
    """A page title without its site's name: known suffixes, then what follows ' - ' or ' | '."""
    import re

    known = "|".join(re.escape(s) for s in suffixes)
    cut = F.regexp_replace(title, f"(?:{known}).*$", "") if known else title
    return trim_ws(F.split_part(F.split_part(cut, F.lit(" - "), F.lit(1)), F.lit(" | "), F.lit(1)))


def strip_controls(text: Column) -> Column:
    """No control characters but tab and line ends."""
    return trim_ws(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def text_length(html: Column) -> Column:
    """Characters of HTML outside tags."""
    return F.length(F.regexp_replace(html, r"<[^>]+>", ""))


def platform_name(platform: Column) -> Column:
    """Shown name of a platform; unknown ones as they are, blank ones as pages."""
    names = F.create_map(*[F.lit(x) for pair in PLATFORM_NAMES.items() for x in pair])
    p = trim_ws(platform)
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit(UNNAMED_PLATFORM)).otherwise(F.coalesce(F.try_element_at(names, F.lower(p)), p))


def content_type(kind: Column, title: Column) -> Column:
    """Given type, the legacy column type folded into 'article'; else by title prefix; else 'article'."""
    by_title = F.when(F.lit(False), F.lit(""))
    for prefix, value in TITLE_TYPES.items():
        by_title = by_title.when(F.startswith(title, F.lit(prefix)), F.lit(value))
    given = F.nullif(kind, F.lit(""))
    return F.when(given == "column_article", F.lit("article")).otherwise(F.coalesce(given, by_title, F.lit("article")))


def strip_title_type(title: Column) -> Column:
    return F.regexp_replace(title, "^(?:" + "|".join(sorted(TITLE_TYPES, key=len, reverse=True)) + ")", "")


def mask(secret: Column) -> Column:
    """First and last three characters; short ones as they are."""
    return F.when(F.length(secret) > 6, F.concat(F.left(secret, F.lit(3)), F.lit("****"), F.right(secret, F.lit(3)))).otherwise(secret)


def bucket_of(text: Column, n: int) -> Column:
    """Deterministic bucket: sum of the code points modulo ``n``."""
    codes = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x) % n


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row; NULL for other lines and for the rule under the head."""
    bare = trim_ws(line)
    is_row = F.startswith(bare, F.lit("|")) & ~bare.rlike(r"^\|?[-:| ]+\|?$")
    return F.when(is_row, F.transform(F.split(F.regexp_replace(bare, r"^\||\|$", ""), r"\|"), trim_ws))


def distinct_words(text: Column) -> Column:
    """Words in first-seen order, each once."""
    return F.array_join(F.array_distinct(F.split(squeeze(text), " ")), " ")


def prefix_author(title: Column, author: Column, placeholders: tuple[str, ...]) -> Column:
    """``[author]title``, once; placeholder and missing authors add nothing."""
    mark = F.concat(F.lit("["), author, F.lit("]"))
    wanted = author.isNotNull() & ~author.isin(*placeholders) & ~F.startswith(title, mark)
    return F.when(wanted, F.concat(mark, title)).otherwise(title)


#: Longest title of a post, and what is kept of a longer one.
POST_TITLE, POST_KEPT = 40, 38


def post_title(line: Column, card: Column, is_article: Column, origin_user: Column, origin_title: Column, origin_text: Column, key: Column) -> Column:
    """Title of a post that has none of its own: by what it quotes, its card, its first line, or its id.

    A post that quotes another (``origin_user`` not NULL) names whom it quotes,
    with the quoted title if there is one, else with its own first line or the
    beginning of the quoted text.  The line that only says so is no line.
    """
    own, card = F.nullif(trim_ws(line), F.lit("")), F.nullif(trim_ws(card), F.lit(""))
    # fixed values: the marks of a quoting post
    quoted, only = F.concat(F.lit("转发@"), origin_user, F.lit(": ")), F.lit("转发微博")
    whole = trim_ws(F.regexp_replace(F.coalesce(origin_text, F.lit("")), "<[^>]*>", ""))
    quoting = (
        F.when(F.nullif(trim_ws(origin_title), F.lit("")).isNotNull(), F.concat(quoted, origin_title))
        .when(own.isNotNull() & (own != only), F.concat(own, F.lit(" // "), quoted, F.substring(whole, 1, 22)))
        .otherwise(F.concat(quoted, F.substring(whole, 1, 25)))
    )
    plain = F.coalesce(F.when(F.coalesce(is_article, F.lit(False)), card), own, card, F.concat(F.lit("微博_"), key))
    return shorten(F.when(origin_user.isNotNull(), quoting).otherwise(plain), POST_TITLE, keep=POST_KEPT)
