"""Flat text blocks of a page: the text between two neighbouring block-level tags."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: The tags of block level.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table "
    "tbody td tfoot th thead title tr ul".split()
)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*|/)?>|<[!?][^>]*>",
    re.S | re.I,
)
_WHITE = re.compile(r"[ \t\r\n]+")


def _unclosed(markup: str, element: str | None) -> bool:
    """Whether a comment, script or style goes on behind its match."""
    if element:
        return not re.search(rf"</{element}\s*>\Z", markup, re.I)
    return markup.startswith("<!--") and not (markup.endswith("-->") and len(markup) >= 7)


class Block(NamedTuple):
    text: str
    #: Block-level tag before the text, '/x' for an end tag, '' at the start of a page.
    tag: str
    #: Innermost open list, table, quote, code or heading element, else ''.
    inside: str
    link_chars: int
    bold_chars: int


_HOLDERS = {"li": "li", "td": "td", "th": "td", "pre": "pre", "blockquote": "blockquote", "title": "title", "nav": "nav", "footer": "footer", "aside": "aside", "header": "header"} | {f"h{i}": f"h{i}" for i in range(1, 7)}


def parse_blocks(page: str) -> list[Block]:
    """All non-empty blocks of a page in order, however malformed its markup.

    Inline tags are dropped, scripts, styles and comments skipped, character
    references decoded, each run of blanks, tabs and line ends is one blank.
    """
    out: list[Block] = []
    buf: list[str] = []
    link = bold = at = 0
    in_link = in_bold = 0
    tag = inside = ""
    # behind the last '>' there is no markup but what an unclosed comment, script or style swallows
    end = page.rfind(">") + 1
    last = None
    for m in _MARKUP.finditer(page, 0, end):
        last = m
        start = m.start()
        if start > at:
            piece = page[at:start]
            buf.append(piece)
            if in_link:
                link += len(piece)
            if in_bold:
                bold += len(piece)
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if name in BLOCK_TAGS:
            if buf:
                text = "".join(buf)
                if "&" in text:
                    text = html.unescape(text)
                text = _WHITE.sub(" ", text).strip(" ")
                if text:
                    out.append(Block(text, tag, inside, link, bold))
                buf = []
            link = bold = 0
            if m.group(2):
                tag = "/" + name
                if _HOLDERS.get(name) == inside:
                    inside = ""
            else:
                tag = name
                if name in _HOLDERS:
                    inside = _HOLDERS[name]
                elif name in ("div", "main", "article", "section", "ul", "ol", "table", "tr"):
                    inside = ""
        elif name == "a":
            in_link = not m.group(2)
        elif name in ("b", "strong"):
            in_bold = not m.group(2)
    rest, comment, _ = page[at:].partition("<!--")
    if last is not None and at == end and _unclosed(last.group(), last.group(1)):
        rest = ""
    if rest:
        buf.append(rest)
        if in_link:
            link += len(rest)
        if in_bold and comment:
            bold += len(rest)
    if buf:
        text = _WHITE.sub(" ", html.unescape("".join(buf))).strip(" ")
        if text:
            out.append(Block(text, tag, inside, link, bold))
    return out
