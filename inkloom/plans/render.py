"""Row builders of the export formats: every document part is one Column.

Whole collections are never built in one value: a sink writes the ordered rows
of a unit, or ``unit_documents`` joins them for units of a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import numbers, text

#: Most rows of a unit that is rendered as one value.
UNIT_ROWS = 500

# Labels of the counters in a rendered article.
COUNTERS = {"read_num": "阅读", "like_count": "点赞", "old_like_count": "在看", "share_count": "分享", "comment_count": "留言"}


def stats_line() -> Column:
    """Counters above zero, in their order; comments are not abbreviated."""
    parts = []
    for c, label in COUNTERS.items():
        shown = F.col(c).cast("string") if c == "comment_count" else numbers.show_count(F.col(c))
        parts.append(F.when(F.col(c) > 0, F.concat(F.lit(f"{label} "), shown)))
    return F.concat_ws(" · ", *parts)


def origin_line() -> Column:
    """Platform, author and time, blank ones left out."""
    return F.concat_ws("  ·  ", text.platform_name(F.col("platform")), F.nullif(text.trim_ws(F.col("author")), F.lit("")), F.nullif(text.trim_ws(F.col("publish_time")), F.lit("")))


def comment_lines() -> Column:
    """Comments with their replies, one line each."""

    def flat(x: Column) -> Column:
        return F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))

    def reply(r: Column) -> Column:
        return F.concat(F.lit(">   - ↳ **"), F.coalesce(r["nick_name"], F.lit("作者")), F.lit("回复**："), flat(r["content"]))

    def comment(c: Column) -> Column:
        head = F.concat(
            F.lit("> - **"), F.coalesce(c["nick_name"], F.lit("用户")), F.lit("**"),
            F.when(F.coalesce(c["ip_region"], F.lit("")) != "", F.concat(F.lit(" ["), c["ip_region"], F.lit("]"))).otherwise(F.lit("")),
            F.when(F.coalesce(c["like_num"], F.lit(0)) > 0, F.concat(F.lit(" +"), c["like_num"].cast("string"))).otherwise(F.lit("")),
            F.lit("："), flat(c["content"]),
        )
        return F.concat_ws("\n", head, F.array_join(F.transform(c["replies"], reply), "\n"))

    return F.array_join(F.transform("comments", comment), "\n")


def markdown_section(number: Column) -> Column:
    """An article as a numbered Markdown section."""
    title = F.coalesce("title", F.lit(""))
    tags = text.tag_line(F.col("tags"))
    stats = stats_line()
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("## "), number.cast("string"), F.lit(". "), title),
        F.when(tags != "", F.concat(F.lit("**标签**："), tags)),
        F.concat(F.lit("**原文**："), origin_line()),
        F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("**链接**："), F.trim("url"))),
        F.lit("---"),
        F.nullif(text.strip_leading_title(F.col("content_markdown"), F.col("title")), F.lit("")),
        F.when(stats != "", F.concat(F.lit("> "), stats)),
    )


def text_section(number: Column) -> Column:
    """An article as numbered plain text."""
    body = text.markdown_to_text(text.strip_leading_title(F.col("content_markdown"), F.col("title")))
    return F.concat_ws("\n\n", F.concat(number.cast("string"), F.lit(". "), F.coalesce("title", F.lit(""))), F.nullif(origin_line(), F.lit("")), F.nullif(body, F.lit("")), F.lit("=" * 20))


def html_card(number: Column) -> Column:
    """An article as an HTML card around its own markup."""
    title = text.escape_html(F.coalesce("title", F.lit("")))
    return F.concat(
        F.lit('<article id="a'), number.cast("string"), F.lit('"><h2>'), title, F.lit("</h2><p>"), text.escape_html(origin_line()), F.lit("</p><div>"), F.coalesce("content_html", F.lit("")), F.lit("</div></article>")
    )


def front_matter() -> Column:
    """YAML head: title, author, date, url, quotation marks escaped."""

    def line(name: str, c: str) -> Column:
        return F.concat(F.lit(f'{name}: "'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))

    return F.concat_ws("\n", F.lit("---"), line("title", "title"), line("author", "author"), line("date", "publish_time"), line("url", "url"), F.lit("---"))


def manifest_line(number: Column) -> Column:
    """Numbered title, time and link."""
    when = F.nullif(text.trim_ws(F.col("publish_time")), F.lit(""))
    return F.concat(number.cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.when(when.isNotNull(), F.concat(F.lit(" ("), when, F.lit(")"))).otherwise(F.lit("")), F.lit(" - "), F.trim(F.coalesce("url", F.lit(""))))


def unit_documents(rows: DataFrame, unit: list[str], order: str, section: str, head: Column | None = None, max_rows: int = UNIT_ROWS) -> DataFrame:
    """One document for each unit, its sections in order; units over ``max_rows`` must be cut first."""
    largest = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a unit has {largest} rows, more than {max_rows}: cut units into parts first")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, section))), lambda x: x[section]), "\n\n")
    return rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_articles"), joined.alias("document"))


def contents_line(number: Column) -> Column:
    """An article's entry in the contents of a merged document: a link to its anchor, with its time."""
    shown = F.concat(number.cast("string"), F.lit(". "), text.escape_brackets(F.coalesce("title", F.lit(""))))
    when = F.nullif(text.trim_ws(F.col("publish_time")), F.lit(""))
    return F.concat(F.lit("- ["), shown, F.lit("](#"), section_anchor(number), F.lit(")"), F.when(when.isNotNull(), F.concat(F.lit(" `("), when, F.lit(")`"))).otherwise(F.lit("")))


def section_anchor(number: Column) -> Column:
    return text.anchor(F.concat(number.cast("string"), F.lit("-"), F.coalesce("title", F.lit(""))))


def merged_markdown(rows: DataFrame, unit: list[str], number: str, head: Column, foot: str, max_rows: int = UNIT_ROWS) -> DataFrame:
    """One Markdown document for each unit: head, contents with anchors, sections with counters and comments, foot.

    ``rows`` are articles with a dense ``number`` in their unit.  Units over
    ``max_rows`` must be cut first.
    """
    n = F.col(number)
    comments = comment_lines()
    section = F.concat_ws("\n\n", F.concat(F.lit('<a id="'), section_anchor(n), F.lit('"></a>')), markdown_section(n), F.nullif(F.coalesce(comments, F.lit("")), F.lit("")), F.lit(foot))
    lines = rows.select(*unit, number, contents_line(n).alias("__line"), section.alias("__section"), head.alias("__head"))
    largest = lines.groupBy(*unit).agg(F.max(number).alias("n")).agg(F.max("n")).head()[0] or 0
    if largest > max_rows:
        raise ValueError(f"a unit has {largest} rows, more than {max_rows}: cut units into parts first")
    parts = lines.groupBy(*unit).agg(F.count(F.lit(1)).alias("n_articles"), F.first("__head").alias("__head"), F.sort_array(F.collect_list(F.struct(number, "__line", "__section"))).alias("__all"))
    joined = lambda c, by: F.array_join(F.transform("__all", lambda x: x[c]), by)
    document = F.concat_ws("\n\n", F.concat("__head", F.lit(" ("), F.col("n_articles").cast("string"), F.lit(")")), joined("__line", "\n"), F.lit("---"), joined("__section", "\n\n---\n\n"))
    return parts.select(*unit, "n_articles", document.alias("document"))
