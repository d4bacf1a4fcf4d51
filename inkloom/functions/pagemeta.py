"""What pages and scripts say about themselves."""

from __future__ import annotations

import html as html_text
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.text import squeeze, trim_ws


def meta_content(html: Column, attribute: str, name: str) -> Column:
    """``content`` of a meta element, NULL if blank or absent."""
    return F.nullif(trim_ws(F.regexp_extract(html, rf'(?i)<meta[^>]+{attribute}="{name}"[^>]+content="([^"]*)"', 1)), F.lit(""))


def element_text(html: Column, tag: str) -> Column:
    """Text of the first ``tag`` element, NULL if blank or absent."""
    return F.nullif(squeeze(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))


def script_text(html: Column, name: str) -> Column:
    """A quoted text variable of a page's script, references resolved; NULL if blank or absent."""
    raw = F.regexp_extract(html, rf"""(?s)\bvar\s+{name}\s*=\s*(?:'([^'\n]*)'|"[^"\n]*")""", 1)
    other = F.regexp_extract(html, rf"""(?s)\bvar\s+{name}\s*=\s*"([^"\n]*)\"""", 1)
    return F.nullif(trim_ws(resolved(F.coalesce(F.nullif(raw, F.lit("")), other))), F.lit(""))


def resolved(text: Column) -> Column:
    """The five references of markup and the blank as characters."""
    for ref, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(ch))
    return text


def element_by_id(html: Column, name: str) -> Column:
    """Text of the element of an id, up to its first end tag; NULL if blank or absent."""
    inner = F.regexp_extract(html, rf"""(?is)<[a-z0-9]+[^>]*\bid=["']{name}["'][^>]*>(.*?)</""", 1)
    return F.nullif(squeeze(resolved(F.regexp_replace(inner, "<[^>]*>", ""))), F.lit(""))


def element_by_class(html: Column, name: str) -> Column:
    """Text of the first element of a class, up to its first end tag; NULL if blank or absent."""
    inner = F.regexp_extract(html, rf"""(?is)<[a-z0-9]+[^>]*\bclass=["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["'][^>]*>(.*?)</""", 1)
    return F.nullif(squeeze(resolved(F.regexp_replace(inner, "<[^>]*>", ""))), F.lit(""))


def script_time(html: Column) -> Column:
    """Publication time of a script's epoch second, on the clock of China, to the minute; NULL if there is none."""
    found = [F.regexp_extract(html, rf"""\bvar\s+{name}\s*=\s*["']?([0-9]{{10}})""", 1).try_cast("long") for name in ("ct", "oriCreateTime")]
    local = F.timestamp_seconds(F.coalesce(*found) + F.lit(8 * 3600))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")


def page_title(html: Column) -> Column:
    """Title: og:title, a script's variable, the first heading, or the title element without the site's name."""
    page = element_text(html, "title")
    cut = F.nullif(trim_ws(F.split_part(F.split_part(page, F.lit(" - "), F.lit(1)), F.lit(" | "), F.lit(1))), F.lit(""))
    return F.coalesce(meta_content(html, "property", "og:title"), script_text(html, "msg_title"), element_text(html, "h1"), cut)


def page_author(html: Column) -> Column:
    """Author: two meta elements, the element that names the account, or a script's variable."""
    return F.coalesce(
        meta_content(html, "property", "og:article:author"), meta_content(html, "name", "author"), element_by_id(html, "js_name"), element_by_class(html, "profile_nickname"), script_text(html, "nickname")
    )


def page_time(html: Column) -> Column:
    """Publication time of three meta elements, a script's epoch second, or the element that shows it, to the minute."""
    found = F.coalesce(meta_content(html, "property", "article:published_time"), meta_content(html, "name", "pubdate"), meta_content(html, "name", "publishdate"))
    return F.coalesce(F.replace(F.substring(found, 1, 16), F.lit("T"), F.lit(" ")), script_time(html), element_by_id(html, "publish_time"))


def script_number(html: Column, name: str) -> Column:
    """A counter of a page's script, 0 where blank."""
    return F.coalesce(F.regexp_extract(html, rf"""{name}\s*[:=]\s*['"]?([0-9]+)""", 1).try_cast("long"), F.lit(0).cast("long"))


def strip_hidden(html: Column) -> Column:
    """No styles that hide; fractions of opacity stay."""
    shown = F.regexp_replace(html, r"(?i)visibility\s*:\s*hidden\s*;?", "")
    return F.regexp_replace(shown, r"(?i)opacity\s*:\s*0([^.0-9]|$)", "$1")


def tolerant_items(doc: Column) -> Column:
    """Items of a JSON list as strings: an array, the array under 'list', or a single object."""
    array = "array<string>"
    whole = F.from_json(doc, array)
    under = F.from_json(F.get_json_object(doc, "$.list"), array)
    bare = F.ltrim(doc)
    return F.when(F.startswith(bare, F.lit("[")), whole).when(under.isNotNull(), under).when(F.startswith(bare, F.lit("{")), F.array(doc)).otherwise(F.array().cast(array))


def sniffed(raw: bytes | None) -> str | None:
    """Bytes decoded by the charset named in the first KB; latin-1 and the Chinese ones are read as GB18030."""
    if raw is None:
        return None
    named = re.search(rb"""charset=["']?([A-Za-z0-9_-]+)""", raw[:1024])
    charset = named[1].decode("ascii").lower() if named else "utf-8"
    if charset in ("gb2312", "gbk", "gb18030", "iso-8859-1", "latin1"):
        charset = "gb18030"
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def decode_sniffed(df: DataFrame, *, id_col: str, raw_col: str) -> DataFrame:
    """``(id, decoded)``: binary pages as text; NULL stays NULL."""
    slim = df.select(F.col(id_col).alias("__id"), F.col(raw_col).alias("raw"))
    schema = T.StructType([slim.schema["__id"], T.StructField("decoded", T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sniffed(r) for r in batch.column(1).to_pylist()], pa.string())], names=schema.names)

    return slim.mapInArrow(decode, schema).withColumnRenamed("__id", id_col)


def json_after(df: DataFrame, *, id_col: str, text_col: str, marker: str) -> DataFrame:
    """``(id, json)``: the JSON value behind the first ``marker`` that one follows; NULL where there is none.

    Braces in strings and whatever follows the value do not matter.
    """
    slim = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = T.StructType([slim.schema["__id"], T.StructField("json", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = json.JSONDecoder()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found, at = None, text.find(marker)
                while at >= 0 and found is None:
                    begin = at + len(marker)
                    while begin < len(text) and text[begin].isspace():
                        begin += 1
                    try:
                        _, end = decoder.raw_decode(text, begin)
                        found = text[begin:end]
                    except ValueError:
                        at = text.find(marker, at + 1)
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return slim.mapInArrow(find, schema).withColumnRenamed("__id", id_col)


def engagement(script: Column) -> Column:
    """Counters and originality of a page script as a struct; blank counters are 0."""
    names = ("read_num", "like_count", "old_like_count", "share_count", "comment_count")
    return F.struct(*[script_number(script, n).alias(n) for n in names], (script_number(script, "copyright_stat") == 1).alias("is_original"))


#: Styles that take an element out of the flow, and classes of elements that a platform lays over its text.
LAYOUT_STYLES = r"(?i)(?:(?:position|float|z-index|transform)\s*:|(?:margin|top|left|right|bottom)(?:-[a-z]+)?\s*:\s*-)[^;\"']*;?"
LAYOUT_CLASSES = r"(?i)(class=[\"'][^\"']*?)\b(?:sticky|floating|overlay|fixed-bar|toolbar)\b"


def strip_layout(html: Column) -> Column:
    """No inline styles and classes that take elements out of the flow, nor negative margins and offsets."""
    return F.regexp_replace(F.regexp_replace(html, LAYOUT_STYLES, ""), LAYOUT_CLASSES, "$1")


def is_truncated(html: Column) -> Column:
    """Whether a text ends in a link to its full version."""
    return html.rlike(r"<a[^>]*>[^<]{0,4}(?:全文|展开|Read more|Continue reading)[^<]{0,4}</a>\s*(?:</[a-z]+>\s*)*\z")


def replace_variants(html: Column, url: Column, to: Column) -> Column:
    """A URL replaced as written, with its '&' escaped, and with its escaped characters decoded."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    out = F.replace(F.replace(html, F.replace(url, F.lit("&"), F.lit("&amp;")), to), url, to)
    return F.when(decoded != url, F.replace(out, decoded, to)).otherwise(out)


def sections_html(sections: Column) -> Column:
    """Typed sections (kind, value) as HTML."""

    def one(s: Column) -> Column:
        return F.when(s["kind"] == "image", F.concat(F.lit('<img src="'), s["value"], F.lit('">'))).when(s["kind"] == "heading", F.concat(F.lit("<h2>"), s["value"], F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), s["value"], F.lit("</p>")))

    return F.array_join(F.transform(sections, one), "")


def unescaped(text: str | None) -> str | None:
    r"""Script escapes resolved: ``\xHH``, ``\n``, ``\r``, ``\t``, then character references."""
    if text is None:
        return None
    text = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text)
    return html_text.unescape(text.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t")).strip()


def decode_escapes(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``(id, decoded)``: texts of scripts without their escapes."""
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    schema = T.StructType([slim.schema["__id"], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([unescaped(t) for t in batch.column(1).to_pylist()], pa.string())], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
