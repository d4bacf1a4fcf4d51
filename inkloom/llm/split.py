"""Oversized texts cut at natural boundaries, with overlap.

Sizes are prefix sums over a text's characters (of characters, or of a public
tokenizer's tokens); boundaries are sorted offset arrays by kind.  The last
boundary under the limit is found by binary search, the next piece steps back
by the overlap, and where no boundary serves the cut is hard.  The same arrays
tell which is the largest natural unit whose gaps are all within the limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps

LIMIT, OVERLAP = 3000, 200
#: A boundary is taken only if the piece is at least this full; then less full ones are tried.
MIN_FILL = 0.5
KINDS = ("paragraph", "line", "sentence", "word")
PIECE_SCHEMA = "piece_no int, start long, end long, overlap long, cut string, piece string, boundary string"

_LINE_END = re.compile(r"\r?\n")
#: Lines of white space only, with the line end before them.
_PARAGRAPH = re.compile(r"(?:\r?\n|\A)(?:[ \t\r]*\n)+|\r?\n[ \t\r]*\Z")
_SENTENCE = re.compile(r"[。！？]|[.!?](?=[ \t])")
_SENTENCE_GAP = re.compile(r"(?:[。！？]|[.!?](?=[ \t]))[ \t]*")
_SPACE = re.compile(r"[ \t\r\n]+")


class Units:
    """The natural units of a text: for each kind sorted arrays of their starts and ends."""

    def __init__(self, text: str):
        n = len(text)
        self.bounds: dict[str, np.ndarray] = {}
        self.ends: dict[str, np.ndarray] = {}
        for kind, gap in (("paragraph", _PARAGRAPH), ("line", _LINE_END), ("word", _SPACE)):
            spans = [m.span() for m in gap.finditer(text)]
            self.bounds[kind] = np.array([b for _, b in spans], dtype=np.int64)
            self.ends[kind] = np.array([*[a for a, _ in spans], n], dtype=np.int64)
        self.bounds["sentence"] = np.array([m.end() for m in _SENTENCE_GAP.finditer(text)], dtype=np.int64)
        # a sentence ends after its mark, or with its line
        marks = np.array([m.end() for m in _SENTENCE.finditer(text)], dtype=np.int64)
        self.cuts = np.unique(np.concatenate([[0], self.bounds["line"], self.ends["line"], marks]).astype(np.int64))
        # a CR before its LF is no character of its own
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        pair = np.zeros(n, dtype=bool)
        if n > 1:
            pair[:-1] = (codes[:-1] == 13) & (codes[1:] == 10)
        self.prefix = np.concatenate([[0], np.cumsum(~pair)]).astype(np.int64)
        self.solid = np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 10)) & (codes != 13))

    def longest(self, kind: str) -> int:
        """The largest gap between two boundaries of a kind, by the prefix sums; sentences are trimmed of white space."""
        if kind != "sentence":
            starts, ends = np.concatenate([[0], self.bounds[kind]]), self.ends[kind]
            if kind == "paragraph":
                # white space alone is no paragraph
                some = np.searchsorted(self.solid, ends) > np.searchsorted(self.solid, starts)
                starts, ends = starts[some], ends[some]
        else:
            # from the first solid character at or after a cut to the last one before the next
            starts, ends = self.cuts[:-1], self.cuts[1:]
            first, last = np.searchsorted(self.solid, starts), np.searchsorted(self.solid, ends) - 1
            some = first <= last
            starts, ends = self.solid[first[some]], self.solid[last[some]] + 1
        return int((self.prefix[ends] - self.prefix[starts]).max(initial=0))

    def kind(self, limit: int) -> str:
        """The largest natural unit all of whose pieces are within ``limit`` characters, 'none' if even words are not."""
        return next((k for k in KINDS if self.longest(k) <= limit), "none")


def boundary_kind(text: str, limit: int = LIMIT) -> str:
    """The largest natural unit all of whose pieces are within ``limit`` characters."""
    return Units(text).kind(limit)


def _safe_cut(text: str, at: int, start: int) -> int:
    """A hard cut that parts neither CR from LF nor a mark from its letter, if it can."""
    import unicodedata

    best = at
    while best > start + 1 and best < len(text) and (unicodedata.combining(text[best]) or text[best] in "‍️" or text[best - 1] == "‍" or text[best - 1 : best + 1] == "\r\n"):
        best -= 1
    return best if best > start else at


def split_text(
    text: str, limit: int = LIMIT, overlap: int = OVERLAP, prefix: np.ndarray | None = None, min_fill: float = MIN_FILL, units: Units | None = None, measure: Callable[[str], int] | None = None
) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, end, overlap, cut)`` of a text, each at most ``limit`` large.

    ``prefix[i]`` is the size of ``text[:i]`` (characters if not given).  Where
    the size of a piece by itself may be above the difference of two prefixes
    (tokens), ``measure`` gives it, and the piece is cut shorter until it is
    within the limit.  A
    piece starts exactly ``overlap`` before the end of the last one (with
    tokens: as near as characters allow, never more).  ``cut`` is the kind of
    boundary the piece ends at: one of KINDS, 'hard' or 'end'.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and overlap smaller than limit")
    n = len(text)
    if n == 0:
        return []
    size = np.arange(n + 1, dtype=np.int64) if prefix is None else prefix
    bounds = units.bounds if units else None
    pieces, start, over = [], 0, 0
    room = limit
    while True:
        if size[n] - size[start] <= room and (measure is None or measure(text[start:n]) <= limit):
            pieces.append((start, n, over, "end"))
            return pieces
        if bounds is None:
            bounds = Units(text).bounds
        reach = int(np.searchsorted(size, size[start] + room, side="right")) - 1
        reach = min(max(reach, start + 1), n - 1 if measure else n)
        cut, end = "hard", None
        # the piece must bring something beyond the overlap
        beyond = int(np.searchsorted(size, size[start] + overlap, side="right")) if pieces else start + 1
        for least in (max(beyond, int(np.searchsorted(size, size[start] + int(limit * min_fill), side="left"))), beyond):
            for kind in KINDS:
                offsets = bounds[kind]
                i = int(np.searchsorted(offsets, reach, side="right")) - 1
                if i >= 0 and offsets[i] >= least and offsets[i] > start:
                    cut, end = kind, int(offsets[i])
                    break
            if end is not None:
                break
        if end is None:
            end = _safe_cut(text, reach, max(start, beyond - 1))
        if measure and end > start + 1 and measure(text[start:end]) > limit:
            room = max(min(room, int(size[end] - size[start])) - 1, 1)
            if reach > start + 1:
                continue
        room = limit
        pieces.append((start, end, over, cut))
        back = int(np.searchsorted(size, size[end] - overlap, side="left"))
        nxt = max(back, start + 1)
        over, start = end - nxt, nxt


def joined(text_pieces: list[tuple[str, int]]) -> str:
    """The text again, from its pieces with their overlaps."""
    return "".join(piece[over:] for piece, over in text_pieces)


def token_prefix(texts_to_ids: Callable, text: str) -> np.ndarray:
    """Prefix sums of tokens by character: tokens that have begun before each character offset."""
    lengths = texts_to_ids(text)
    begun = np.zeros(len(text) + 1, dtype=np.int64)
    byte_at = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0)
    begun[:] = np.searchsorted(starts, byte_at, side="left")
    return begun


def _token_lengths(path: str) -> Callable:
    from inkloom.llm.tokens import bpe

    encoding = bpe(path)
    return lambda text: [len(encoding.decode_single_token_bytes(t)) for t in encoding.encode_ordinary(text)]


def split_oversized(
    docs: DataFrame,
    *,
    id_col: str,
    text_col: str,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pieces ``(id, piece_no, start, end, overlap, cut, piece, boundary)`` of every text, cut only where over ``limit``.

    ``boundary`` is, for texts over ``limit`` characters, the largest natural
    unit of which every one is within the limit (see ``Units.kind``).

    Sizes are characters, or tokens of the tokenizer file if given.  Texts
    within the limit are one piece with cut 'end' and, for characters, never
    leave the JVM.  NULL and empty texts have no pieces.  Repeated ids each
    give their pieces; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text") != "")
    large = slim if tokenizer_path else slim.filter(F.length("__text") > limit)

    names = ["__id", "piece_no", "start", "end", "overlap", "cut", "piece", "boundary"]
    schema = T.StructType([large.schema["__id"], *T._parse_datatype_string(PIECE_SCHEMA).fields])
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _token_lengths(tokenizer_path) if tokenizer_path else None
        for batch in batches:
            for part in steps(batch, [1], 2000):
                owner, rows = [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    units = Units(text) if len(text) > limit else None
                    prefix = token_prefix(lengths, text) if lengths else None
                    measure = (lambda piece: len(lengths(piece))) if lengths else None
                    natural = units.kind(limit) if units else None
                    found = split_text(text, limit, overlap, prefix, units=units, measure=measure)
                    rows += [(i, s, e, o, kind, text[s:e], natural) for i, (s, e, o, kind) in enumerate(found)]
                    owner += [r] * len(found)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *columns], names=names)

    pieces = large.mapInArrow(cut, schema)
    if not tokenizer_path:
        zero = F.lit(0).cast("long")
        small = slim.filter(F.length("__text") <= limit).select(
            "__id", F.lit(0).alias("piece_no"), zero.alias("start"), F.length("__text").cast("long").alias("end"), zero.alias("overlap"), F.lit("end").alias("cut"), F.col("__text").alias("piece"), F.lit(None).cast("string").alias("boundary")
        )
        pieces = pieces.unionByName(small)
    return pieces.withColumnRenamed("__id", id_col)
