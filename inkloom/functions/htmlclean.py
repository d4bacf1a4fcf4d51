"""Tolerant HTML cleaning: clean markup, Markdown and images from whatever a page holds."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps

#: Elements nested deeper are flat in the deepest one, as browsers do it: no page is too deep to walk.
MAX_DEPTH = 120
#: Elements dropped with all they hold.
DROPPED = frozenset("script style noscript iframe form button input select textarea svg canvas link meta head".split())
#: Elements of a page's frame, dropped unless the whole page is asked for.
FRAME = frozenset("nav aside footer header".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre code strong b em i del s a img figure figcaption table thead tbody tr td th br hr section article main div span".split())
#: Attributes in which an image's address may be, best first.
IMAGE_SOURCES = ("real_src", "data-original", "data-original-src", "data-actualsrc", "data-src", "src")
SHOWN_SOURCES = ("src", "data-src", "data-actualsrc", "data-original-src", "data-original")
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol blockquote pre table figure hr".split())
_NO_TEXT = frozenset("table thead tbody tfoot tr ul ol".split())
_INLINE = frozenset("a b strong em i del s span font u code".split())
#: Open inline elements before a block from which they are taken for unclosed.
UNCLOSED = 8
#: Class names of elements that hold the content, best first, where neither article nor main does.
CONTENT_CLASSES = ("article-content", "post-content", "entry-content", "article-body", "post-body", "content", "article", "post")
_HIDDEN = re.compile(r"visibility\s*:\s*hidden\s*;?|opacity\s*:\s*0(?![.\d])\s*;?", re.I)
_LAYOUT = re.compile(r"(?:position|float|z-index|transform|(?:margin|top|left|right|bottom)[a-z-]*\s*:\s*-)[^;]*;?", re.I)
_WATERMARK = re.compile(r"[?&](?:x-oss-process=image/watermark|watermark|imageMogr2/watermark|source=)[^&#]*")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    blocky: bool | None = None


class _Builder(HTMLParser):
    """A tree of any markup: unclosed elements close where their successors or parents do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.skip: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            if tag == self.skip[0] and tag not in VOID:
                self.skip.append(tag)
            return
        if tag in DROPPED:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in _CLOSES:
            outermost = None
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in _CLOSES[tag]:
                    outermost = i
                elif self.open[i].tag in ("ul", "ol", "table", "blockquote", "div", "section"):
                    break
            if outermost is not None:
                del self.open[outermost:]
        elif tag in _BLOCKS:
            # inline elements that were never closed end with their block
            at = len(self.open) - 1
            while at > 0 and self.open[at].tag in _INLINE:
                at -= 1
            if self.open[at].tag == "p":
                del self.open[at:]
            elif len(self.open) - 1 - at > UNCLOSED:
                del self.open[at + 1 :]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.skip:
            node = self.open[-1]
            if len(self.open) >= MAX_DEPTH:
                # the deepest element may be one that holds no text itself
                node = next((n for n in reversed(self.open) if n.tag not in _NO_TEXT), self.root)
            node.children.append(data)


def parse(page: str) -> Node:
    """The tree of a page.  Behind the last '>' there is no markup: what stands there is text, however many tags it begins."""
    builder = _Builder()
    end = page.rfind(">") + 1
    builder.feed(page[:end])
    builder.close()
    if tail := page[end:].partition("<!--")[0]:
        builder.handle_data(html.unescape(tail))
    return builder.root


def image_source(attrs: dict[str, str], original: bool = True) -> str:
    """An image's address by the priority of its attributes; without watermark parameters if ``original``."""
    src = next((attrs[a].strip() for a in (IMAGE_SOURCES if original else SHOWN_SOURCES) if attrs.get(a, "").strip()), "")
    if src.startswith("//"):
        src = "https:" + src
    return re.sub(r"[?&]$", "", _WATERMARK.sub("", src)) if original else src


def clean_style(style: str) -> str:
    """A style without hiding and without layout that takes an element out of the flow."""
    return _LAYOUT.sub("", _HIDDEN.sub("", style)).strip(" ;")


def _find(node: Node, tags: tuple[str, ...]) -> Node | None:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag in tags:
                return child
            if (found := _find(child, tags)) is not None:
                return found
    return None


def _has_block(node: Node) -> bool:
    """Whether an element of block level is in a node; each node is looked at once."""
    if node.blocky is None:
        node.blocky = any(isinstance(c, Node) and (c.tag in _BLOCKS or _has_block(c)) for c in node.children)
    return node.blocky


def text_of(node: Node | str) -> str:
    return node if isinstance(node, str) else "".join(text_of(c) for c in node.children)


def _find_class(root: Node, name: str) -> Node | None:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if name in node.attrs.get("class", "").lower().split():
            return node
        waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
    return None


def content_root(root: Node) -> Node:
    """The content element: article, else main, else one of a content class, else the element that holds most text in paragraphs, else all."""
    for tag in ("article", "main"):
        if (found := _find(root, (tag,))) is not None and text_of(found).strip():
            return found
    for name in CONTENT_CLASSES:
        if (found := _find_class(root, name)) is not None and text_of(found).strip():
            return found
    best, most, waiting = root, 0, [root]
    while waiting:
        node = waiting.pop()
        size = sum(len(text_of(c).strip()) for c in node.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "h2", "h3"))
        if size > most:
            best, most = node, size
        waiting += [c for c in reversed(node.children) if isinstance(c, Node)]
    return best


def to_html(node: Node | str, drop_frame: bool = True) -> str:
    if isinstance(node, str):
        return html.escape(node, quote=False)
    if drop_frame and node.tag in FRAME:
        return ""
    inner = "".join(to_html(c, drop_frame) for c in node.children)
    if node.tag not in KEPT:
        return inner
    attrs = ""
    if node.tag == "a" and node.attrs.get("href", "").strip() and not node.attrs["href"].strip().lower().startswith("javascript:"):
        attrs = f' href="{html.escape(node.attrs["href"].strip())}"'
    if node.tag == "img":
        src = image_source(node.attrs)
        if not src:
            return ""
        attrs = f' src="{html.escape(src)}"' + (f' alt="{html.escape(node.attrs["alt"])}"' if node.attrs.get("alt") else "")
    if style := clean_style(node.attrs.get("style", "")):
        attrs += f' style="{html.escape(style)}"'
    return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def _inline(node: Node | str, images: list[str]) -> str:
    if isinstance(node, str):
        return re.sub(r"[ \t\r\n]+", " ", node)
    if node.tag in FRAME:
        return ""
    inner = "".join(_inline(c, images) for c in node.children)
    bare = inner.strip()
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        src = image_source(node.attrs)
        if src:
            images.append(src)
        return f"![{node.attrs.get('alt', '')}]({src})" if src else ""
    if not bare:
        return inner
    if node.tag in ("strong", "b"):
        return f"**{bare}**"
    if node.tag in ("em", "i"):
        return f"*{bare}*"
    if node.tag in ("del", "s"):
        return f"~~{bare}~~"
    if node.tag == "code":
        return f"`{bare}`"
    if node.tag == "a":
        href = node.attrs.get("href", "").strip()
        return f"[{bare}]({href})" if href and not href.lower().startswith("javascript:") else inner
    return inner


def to_markdown(node: Node, images: list[str], depth: int = 0) -> list[str]:
    """Markdown blocks of a tree: ATX headings, fenced code, '-' lists, '|' tables."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = "".join(line).strip()
        line.clear()
        if text:
            out.append(text)

    for child in node.children:
        if isinstance(child, str) or child.tag not in _BLOCKS and child.tag not in ("li", "tr", "figcaption", *FRAME) and not _has_block(child):
            line.append(_inline(child, images))
            continue
        flush()
        tag = child.tag
        if tag in FRAME:
            continue
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            text = _inline(Node("span", {}, child.children), images).strip()
            if text:
                out.append("#" * int(tag[1]) + " " + text)
        elif tag == "pre":
            code = text_of(child).strip("\n")
            if code.strip():
                out.append(f"```\n{code}\n```")
        elif tag in ("ul", "ol"):
            items = []
            for n, item in enumerate([c for c in child.children if isinstance(c, Node) or c.strip()], 1):
                blocks = to_markdown(Node("span", {}, [item] if isinstance(item, str) else item.children), images, depth + 1)
                if blocks:
                    mark = f"{n}. " if tag == "ol" else "- "
                    items.append("  " * depth + mark + "\n".join(blocks).strip())
            if items:
                out.append("\n".join(items))
        elif tag == "blockquote":
            inner = "\n\n".join(to_markdown(child, images))
            if inner:
                out.append("\n".join("> " + x if x else ">" for x in inner.split("\n")))
        elif tag == "table":
            rows = []
            _rows(child, rows, images)
            if rows and all(len(r) == 1 for r in rows):  # a table for layout
                out += [x for r in rows for x in to_markdown(r[0], images)]
            elif rows:
                cells = [[" ".join(_inline(c, images).split()) for c in r] for r in rows]
                lines = ["| " + " | ".join(r) + " |" for r in cells]
                lines.insert(1, "|" + "---|" * len(cells[0]))
                out.append("\n".join(lines))
            elif text := _inline(Node("span", {}, child.children), images).strip():
                out.append(text)
        elif tag == "hr":
            out.append("---")
        else:
            out += to_markdown(child, images, depth)
    flush()
    return out


def _rows(node: Node, rows: list, images: list[str]) -> None:
    for c in node.children:
        if isinstance(c, Node):
            if c.tag == "tr":
                cells = [x for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                if cells:
                    rows.append(cells)
            elif c.tag in ("thead", "tbody", "tfoot"):
                _rows(c, rows, images)


def clean_page(page: str, title: str = "", whole: bool = False) -> tuple[str, str, list[str]]:
    """``(clean HTML, Markdown, images)`` of a page; a first heading equal to ``title`` goes."""
    root = parse(page)
    node = root if whole else content_root(root)
    named = " ".join(title.split()).lower()
    heading = _find(node, ("h1", "h2", "h3"))
    if named and heading is not None and " ".join(text_of(heading).split()).lower() == named:
        heading.children = []
    images: list[str] = []
    markdown = re.sub(r"\n{3,}", "\n\n", "\n\n".join(to_markdown(node, images))).strip()
    return "".join(to_html(c, not whole) for c in node.children).strip(), markdown, list(dict.fromkeys(images))


def clean_pages(df: DataFrame, *, id_col: str, html_col: str, title_col: str | None = None, whole: bool = False) -> DataFrame:
    """``(id, clean_html, markdown, images)`` of every page; NULL and empty pages give empty results."""
    title = F.coalesce(F.col(title_col), F.lit("")) if title_col else F.lit("")
    slim = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(html_col), F.lit("")).alias("h"), title.alias("t"))
    schema = T.StructType([slim.schema["__id"], T.StructField("clean_html", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("images", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in steps(whole_batch, [1], 500)):
            done = [clean_page(h, t, whole) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return slim.mapInArrow(run, schema).withColumnRenamed("__id", id_col)
