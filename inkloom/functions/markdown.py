"""Markdown as blocks and inline runs."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps

_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*$")
_BULLET = re.compile(r"^(\s*)[-*+•]\s+(.*)$")
_ORDERED = re.compile(r"^(\s*)(\d{1,4})[.)、]\s+(.*)$")
_IMAGE = re.compile(r"^!\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)$")
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})$")
_SEPARATOR = re.compile(r"^\|?[-:| ]+\|?$")
_INLINE = re.compile(
    r"(?P<code>`[^`\n]+`)|(?P<both>\*\*\*[^*\n]+\*\*\*)|(?P<bold>\*\*[^*\n]+\*\*|__[^_\n]+__)|(?P<italic>\*[^*\n]+\*|(?<!\w)_[^_\n]+_(?!\w))|(?P<strike>~~[^~\n]+~~)|(?P<link>\[[^\[\]\n]+\]\([^)\s\[]+\))"
)
_WIDTH = {"code": 1, "both": 3, "bold": 2, "italic": 1, "strike": 2}
#: Deepest indent that is told apart.
MAX_INDENT = 4
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("style", "text", "target")]))


_CODE_SPAN = re.compile(r"(`[^`\n]+`)")


def sanitise(md: str) -> str:
    """Markdown without script links, stray tags, escapes, unpaired bold marks and contents marks; code is left as it is."""
    out: list[str] = []
    plain: list[str] = []
    fenced = False
    for line in md.split("\n"):
        if line.strip().startswith("```"):
            if not fenced:
                out += _sanitised(plain)
                plain = []
            fenced = not fenced
            out.append(line)
        elif fenced:
            out.append(line)
        else:
            plain.append(line)
    return "\n".join(out + _sanitised(plain))


def _sanitised(lines: list[str]) -> list[str]:
    if not lines:
        return []
    # every second part is a code span
    parts = _CODE_SPAN.split("\n".join(lines))
    md = "".join(x if i % 2 else _without_tags(x) for i, x in enumerate(parts))
    md = re.sub(r"(?mi)^[ \t]*\[toc\][ \t\r]*$", "", md)
    return [line if _CODE_SPAN.sub("", line).count("**") % 2 == 0 else "".join(x if i % 2 else x.replace("**", "") for i, x in enumerate(_CODE_SPAN.split(line))) for line in md.split("\n")]


def _without_tags(md: str) -> str:
    md = html.unescape(md)
    md = re.sub(r"!?\[([^\]]*)\]\(\s*javascript:[^)]*\)", r"\1", md, flags=re.I)
    md = re.sub(r"</?(?:strong|b)>", "**", md, flags=re.I)
    md = re.sub(r"</?(?:em|i)>", "*", md, flags=re.I)
    md = re.sub(r"<br\s*/?>", "\n", md, flags=re.I)
    md = re.sub(r"</?[a-zA-Z][^<>\n]*>", "", md)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!|>~-])", r"\1", md)


def inline_runs(text: str) -> list[tuple[str, str, str]]:
    """``(style, text, target)`` of each run, leftmost match first; plain text has style 'text'."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        if m.start() > at:
            out.append(("text", text[at : m.start()], ""))
        style, raw = m.lastgroup, m.group()
        if style == "link":
            label, target = raw[1:-1].split("](", 1)
            out.append(("link", label, target))
        else:
            out.append((style, raw[_WIDTH[style] : -_WIDTH[style]], ""))
        at = m.end()
    if at < len(text):
        out.append(("text", text[at:], ""))
    return out


def blocks(md: str) -> list[tuple[str, int, str]]:
    """``(kind, level, text)``: heading, bullet, ordered, quote, code, table, image, rule, paragraph.

    The level is a heading's rank, a list item's indent or a quotation's depth.  A lone bullet takes
    the next line of text as its own; table cells are joined by tabs.
    """
    out: list[tuple[str, int, str]] = []
    lines = md.replace("\r\n", "\n").split("\n")
    paragraph: list[str] = []
    i = 0

    def end() -> None:
        if paragraph:
            out.append(("paragraph", 0, "\n".join(paragraph)))
            paragraph.clear()

    while i < len(lines):
        line = lines[i]
        bare = line.strip()
        i += 1
        if bare.startswith("```"):
            end()
            code = []
            while i < len(lines) and not lines[i].strip().startswith("```"):
                code.append(lines[i])
                i += 1
            i += 1
            out.append(("code", 0, "\n".join(code)))
        elif not bare:
            end()
        elif bare in "-*+•":
            end()
            while i < len(lines) and not lines[i].strip():
                i += 1
            if i < len(lines) and not re.match(r"^(?:#|>|\||```|[-*+•]\s|\d+[.)])", lines[i].strip()):
                out.append(("bullet", 0, lines[i].strip()))
                i += 1
        elif m := _HEADING.match(bare):
            end()
            out.append(("heading", len(m[1]), m[2]))
        elif _RULE.match(bare):
            end()
            out.append(("rule", 0, ""))
        elif m := _IMAGE.match(bare):
            end()
            out.append(("image", 0, m[2]))
        elif bare.startswith(">"):
            end()
            quoted = bare.lstrip("> ")
            out.append(("quote", bare[: len(bare) - len(quoted)].count(">"), quoted))
        elif bare.startswith("|"):
            end()
            if not _SEPARATOR.match(bare):
                out.append(("table", 0, "\t".join(c.strip() for c in bare.strip("|").split("|"))))
        elif m := _BULLET.match(line):
            end()
            out.append(("bullet", min(len(m[1].expandtabs(4)) // 2, MAX_INDENT), m[2]))
        elif m := _ORDERED.match(line):
            end()
            out.append(("ordered", min(len(m[1].expandtabs(4)) // 2, MAX_INDENT), m[3]))
        else:
            paragraph.append(bare)
    end()
    return out


def markdown_blocks(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``(id, seq, kind, level, text, n_runs, runs)`` of every block of every text; NULL and empty texts have none.

    ``runs`` are the inline runs ``(style, text, target)`` of a block, for code one run of style 'code'.
    """
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).filter("t <> ''")
    schema = T.StructType(
        [slim.schema["__id"], T.StructField("seq", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n_runs", T.IntegerType()), T.StructField("runs", RUNS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in steps(whole, [1], 2000)):
            own, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = blocks(sanitise(t))
                own += [i] * len(found)
                for n, (k, level, text) in enumerate(found):
                    runs = [("code", text, "")] if k == "code" else inline_runs(text)
                    rows.append((n, k, level, text, len(runs), [dict(zip(("style", "text", "target"), r)) for r in runs]))
            run_type = pa.list_(pa.struct([(c, pa.string()) for c in ("style", "text", "target")]))
            types = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), run_type)
            columns = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *columns], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
