"""Evaluation texts inside training text.

Windows of the items and of the documents are embedded by CGK random walks,
which turn edit distance into Hamming distance; bits of each walk are sampled,
and windows that agree in a repetition are candidates.  The number of
repetitions follows from the measured agreement of passages with edits.  Every
candidate is verified exactly: aligned windows are extended to the longest
passage within the allowed number of edits, and to the longest equal run.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps

#: Normalised characters a shared passage must have, and those for items in Chinese.
MIN_RUN, MIN_RUN_ZH = 60, 24
#: Edits a passage may have, and the share of such passages that is to be found.
MAX_EDITS, RECALL = 1, 0.99
#: Characters of the items in one broadcast index; more items are searched in shards of this size.
SHARD_CHARS = 2_000_000
#: Coordinates of a walk sampled in a repetition.
SAMPLED = 8
#: Candidates looked at together.
CANDIDATES = 8192
#: Planted passages, and repetitions of each, by which the agreement of a scheme is measured.
TRIALS, MEASURED = 500, 32

_DROP = re.compile(r"[\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """NFKC, lower case, letters and digits only."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower())


@dataclass(frozen=True)
class Scheme:
    """How windows are laid for passages of ``run`` characters and embedded.

    Item windows start at every character, document windows at every
    ``stride``.  Each repetition is a walk of its own.
    """

    run: int
    window: int
    stride: int
    repetitions: int
    seed: int

    @property
    def steps(self) -> np.ndarray:
        """Sampled coordinates, one row each repetition, spread over the walk."""
        rng = np.random.default_rng(self.seed)
        length = 2 * self.window  # a walk reads a character in two steps on average
        return np.sort(np.array([rng.choice(length, min(SAMPLED, length), replace=False) for _ in range(self.repetitions)]), axis=1)


@cache
def scheme(run: int, max_edits: int = 0, recall: float = RECALL, seed: int = 11) -> Scheme:
    """Window sizes and repetitions for a target recall of passages of exactly ``run`` characters.

    Without edits a passage holds one whole document window; equal windows
    embed equally, so one repetition finds all.  With edits a passage holds
    four windows of a third of its size, and as many repetitions are made as
    planted passages need: each passage is found in some share of the measured
    repetitions, and the mean of its chances to be missed in all is at most
    ``1 - recall``.
    """
    if not max_edits:
        window = max(4, run * 2 // 3)
        return Scheme(run, window, run - window + 1, 1, seed)
    window = max(4, run // 3)
    stride = max(1, (run - window) // 4)
    chances = _agreement(Scheme(run, window, stride, MEASURED, seed), max_edits)
    repetitions = 1
    # a margin for passages and texts unlike the planted ones
    while np.mean((1 - chances) ** repetitions) > (1 - recall) / 2:
        repetitions += 1
        if repetitions > 10_000:
            raise ValueError(f"passages of {run} characters with {max_edits} edits cannot be found with a recall of {recall}")
    return Scheme(run, window, stride, repetitions, seed)


def edited(passage: np.ndarray, edits: int, rng: np.random.Generator, letters: int = 26) -> np.ndarray:
    """A passage with ``edits`` random characters replaced, left out or put in."""
    out = passage.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        if kind == 0:
            out[at] = 97 + (out[at] - 97 + 1 + int(rng.integers(letters - 1))) % letters
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, 97 + int(rng.integers(letters)))
    return np.array(out)


def _agreement(sch: Scheme, edits: int) -> np.ndarray:
    """Share of the repetitions in which each of TRIALS planted passages agrees with its item in some window."""
    rng = np.random.default_rng(sch.seed + 7)
    items = rng.integers(97, 123, (TRIALS, sch.run))
    texts = [edited(item, edits, rng) for item in items]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
    laid = [np.arange(int(rng.integers(sch.stride)), max(len(t) - sch.window + 1, 1), sch.stride) for t in texts]
    of_text = np.repeat(np.arange(TRIALS), [len(x) for x in laid])
    own_starts = (np.arange(TRIALS)[:, None] * sch.run + np.arange(sch.run - sch.window + 1)).ravel()
    own = embed(items.ravel().astype(np.uint32), own_starts, sch)
    its = embed(np.concatenate(texts).astype(np.uint32), first[of_text] + np.concatenate(laid), sch)
    mine, yours = (own_starts // sch.run).astype(np.uint64) * _MULT, of_text.astype(np.uint64) * _MULT
    agreed = np.zeros(TRIALS)
    for r in range(sch.repetitions):
        hit = np.isin(its[r] ^ yours, own[r] ^ mine)
        agreed += np.bincount(of_text, weights=hit, minlength=TRIALS) > 0
    # a share measured as 0 may be one of a half repetition
    return np.maximum(agreed, 0.5) / sch.repetitions


def embed(codes: np.ndarray, starts: np.ndarray, sch: Scheme) -> np.ndarray:
    """A 64-bit key for each repetition and window start: the sampled CGK coordinates, hashed.

    A walk reads the window's character at its place and moves on where the
    step's random bit of that character says so; past the window it reads a pad.
    """
    wanted = sch.steps
    end = starts + sch.window
    padded = np.append(codes, 0).astype(np.uint64)
    keys = np.zeros((sch.repetitions, len(starts)), dtype=np.uint64)
    bits = np.random.default_rng(sch.seed + 1).integers(1, 2**63, (sch.repetitions, 2 * sch.window), dtype=np.uint64) | np.uint64(1)
    for r in range(sch.repetitions):
        at = starts.astype(np.int64).copy()
        key = keys[r]
        sampled = set(wanted[r].tolist())
        for step in range(int(wanted[r].max()) + 1):
            # a walk cannot have left its window before it has made as many steps
            char = padded[at] if step < sch.window else np.where(at < end, padded[np.minimum(at, len(codes))], np.uint64(0))
            if step in sampled:
                key ^= char + np.uint64(step + 1)
                key *= _MULT
                key ^= key >> np.uint64(29)
            at += (((char + np.uint64(1)) * bits[r, step]) >> np.uint64(61) & np.uint64(1)).astype(np.int64)
        key ^= np.uint64((r + 1) * int(_MULT) & 0xFFFFFFFFFFFFFFFF)
    return keys


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class ItemIndex:
    """Sorted window keys of all items, for each scheme."""

    def __init__(self, items: list[tuple[int, str, int]], max_edits: int = MAX_EDITS, recall: float = RECALL):
        """``items``: (item id, normalised text, characters a passage must have)."""
        self.items, self.max_edits = items, max_edits
        self.codes = _codes("".join(t for _, t, _ in items) or " ")
        self.sizes = np.array([len(t) for _, t, _ in items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.parts = []
        for run in sorted({r for _, t, r in items if len(t) >= r}):
            sch = scheme(run, max_edits, recall)
            keys, owners, offsets = [], [], []
            for i, (_, text, r) in enumerate(items):
                if r != run or len(text) < run:
                    continue
                starts = np.arange(len(text) - sch.window + 1)
                k = embed(_codes(text), starts, sch)
                keys.append(k.ravel())
                owners.append(np.full(k.size, i))
                offsets.append(np.tile(starts, sch.repetitions))
            k, o, f = np.concatenate(keys), np.concatenate(owners), np.concatenate(offsets)
            order = np.argsort(k, kind="stable")
            self.parts.append((sch, k[order], o[order], f[order]))

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """``(text index, item index, passage length, start in the text, longest equal run)`` of all verified passages, the longest of each pair."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        equal: dict[tuple[int, int], int] = {}
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)
        codes = _codes("".join(texts))
        for sch, keys, owners, offsets in self.parts:
            counts = np.maximum((lengths - sch.window) // sch.stride + 1, 0)
            counts[lengths < sch.run - self.max_edits] = 0
            at = np.repeat(np.arange(len(texts)), counts)
            if not len(at):
                continue
            inner = np.arange(len(at)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            starts = first[at] + inner * sch.stride
            # where in the text the passages of a pair end that were extended, by their diagonal
            seen: dict[tuple[int, int, int], int] = {}
            for found in embed(codes, starts, sch):
                low = np.searchsorted(keys, found, side="left")
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == found)
                many = np.searchsorted(keys, found[hit], side="right") - low[hit]
                ends = np.cumsum(many)
                for a in range(0, int(ends[-1]) if len(ends) else 0, CANDIDATES):
                    # candidates a.. of all (window, item window) pairs with equal keys
                    rank = np.arange(a, min(a + CANDIDATES, int(ends[-1])))
                    h = np.searchsorted(ends, rank, side="right")
                    w = hit[h]
                    j = low[w] + rank - (ends[h] - many[h])
                    ok = self._may_hold(codes, starts[w], first[at[w]], lengths[at[w]], owners[j], offsets[j], sch)
                    for d, p, i, q in zip(at[w][ok].tolist(), (starts[w] - first[at[w]])[ok].tolist(), owners[j][ok].tolist(), offsets[j][ok].tolist()):
                        if seen.get((d, i, p - q), -1) >= p + sch.window:
                            continue
                        size, begin, run, reach = self._extend(texts[d], p, self.items[i][1], q, sch.window)
                        seen[d, i, p - q] = max(reach, p + sch.window)
                        if size >= sch.run and size > best.get((d, i), (0, 0))[0]:
                            best[d, i] = (size, begin)
                        if run > equal.get((d, i), 0):
                            equal[d, i] = run
        return [(d, i, size, begin, equal.get((d, i), 0)) for (d, i), (size, begin) in best.items()]

    def _equal(self, codes: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, offset: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Which characters at ``around`` from aligned windows equal the item's on a diagonal that the edits can reach."""
        e = self.max_edits
        place = at[:, None] + around
        inside = (place >= begin[:, None]) & (place < (begin + size)[:, None])
        # a place outside a text or an item equals nothing
        mine = np.where(inside, codes[np.minimum(np.maximum(place, 0), len(codes) - 1)], 0)
        first = offset[:, None] + around
        start, whole = self.starts[owner][:, None], self.sizes[owner][:, None]
        equal = np.zeros(mine.shape, dtype=bool)
        for shift in range(-2 * e, 2 * e + 1):
            there = first + shift
            ok = (there >= 0) & (there < whole)
            equal |= ok & (self.codes[np.minimum(np.maximum(start + there, 0), len(self.codes) - 1)] == mine)
        return equal & inside

    def _may_hold(self, codes: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, offset: np.ndarray, sch: Scheme) -> np.ndarray:
        """Which aligned windows may lie in a passage; no window of a true passage is left out.

        A passage has half of its characters beyond the window on one side at
        least, next to it, and all but ``max_edits`` of them equal the item's.
        What passes is asked for a whole run of such characters.
        """
        e, side = self.max_edits, (sch.run - sch.window) // 2
        beside = np.concatenate([np.arange(-side, 0), np.arange(sch.window, sch.window + side)])
        near = self._equal(codes, at, begin, size, owner, offset, beside)
        ok = np.maximum(near[:, :side].sum(axis=1), near[:, side:].sum(axis=1)) >= side - e
        some = np.flatnonzero(ok)
        if len(some):
            around = np.arange(-(sch.run - sch.window) - e, sch.run + e)
            sums = np.cumsum(self._equal(codes, at[some], begin[some], size[some], owner[some], offset[some], around), axis=1)
            sums[:, sch.run :] -= sums[:, : -sch.run].copy()
            ok[some] = sums[:, sch.run - 1 :].max(axis=1) >= sch.run - e
        return ok

    def _extend(self, text: str, p: int, item: str, q: int, window: int) -> tuple[int, int, int, int]:
        """Around two aligned windows: the longest passage with at most ``max_edits`` edits (characters of the text, start), the equal run, and where that ends."""
        run, begin, reach = 0, p, p
        if text[p : p + window] == item[q : q + window]:
            left, right = _same_left(text, p, item, q), _same_right(text, p + window, item, q + window)
            run, begin, reach = left + window + right, p - left, p + window + right
        if not self.max_edits:
            return run, begin, run, reach
        # the middle of the windows is one point of the alignment
        best = (run, begin)
        for shift in range(-self.max_edits, self.max_edits + 1) if not run else (0,):
            m, n = p + window // 2, q + window // 2 + shift
            if not 0 <= n <= len(item):
                continue
            ahead, back = _reach(text, m, item, n, self.max_edits, 1), _reach(text, m, item, n, self.max_edits, -1)
            for e in range(self.max_edits + 1):
                size = ahead[e] + back[self.max_edits - e]
                if size > best[0]:
                    best = (size, m - back[self.max_edits - e])
        return (*best, run, reach)


def _same_right(a: str, i: int, b: str, j: int) -> int:
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return n


def _same_left(a: str, i: int, b: str, j: int) -> int:
    n = 0
    while n < i and n < j and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def _reach(a: str, i: int, b: str, j: int, edits: int, step: int) -> list[int]:
    """How far from ``i`` on (back with ``step`` -1) ``a`` agrees with ``b`` from ``j`` within 0..edits edits (furthest-reaching diagonals)."""
    room_a, room_b = (len(a) - i, len(b) - j) if step > 0 else (i, j)

    def same(x: int, y: int) -> int:
        return _same_right(a, i + x, b, j + y) if step > 0 else _same_left(a, i - x, b, j - y)

    far = {0: same(0, 0)}
    out = [far[0]]
    for _ in range(edits):
        nxt: dict[int, int] = {}
        for diag, x in far.items():
            for dx, dd in ((1, 0), (1, 1), (0, -1)):  # replaced, only in a, only in b
                x2, d2 = x + dx, diag + dd
                y2 = x2 - d2
                if x2 <= room_a and 0 <= y2 <= room_b:
                    x3 = x2 + same(x2, y2)
                    if x3 > nxt.get(d2, -1):
                        nxt[d2] = x3
        for diag, x in far.items():
            nxt[diag] = max(nxt.get(diag, 0), x)
        far = nxt
        out.append(max(far.values()))
    return out


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str,
    text_col: str,
    item_id_col: str,
    item_text_col: str,
    item_lang_col: str,
    min_run: int = MIN_RUN,
    min_run_zh: int = MIN_RUN_ZH,
    max_edits: int = MAX_EDITS,
    recall: float = RECALL,
) -> DataFrame:
    """``(id, item id, passage length, passage start, longest equal run)`` of every document and item that share a passage.

    A passage has ``min_run`` normalised characters (``min_run_zh`` for items
    with lang 'zh') with at most ``max_edits`` edits.  Passages without edits
    are all found, of those with edits the target ``recall``.  Length and start
    count normalised characters of the document; the equal run is the longest
    without any edit.  Items are the stated query set; the index of at most
    SHARD_CHARS of their characters is broadcast, more items are searched shard
    by shard.  NULL and short texts share nothing; repeated ids each give their
    rows; items with equal text are all reported; empty tables give no rows.
    """
    rows = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).alias("t"), F.col(item_lang_col).alias("l")).filter(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.length("t"))).head()[0] or 0
    shards = max(1, -(-size // SHARD_CHARS))
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text") != "")
    item_type = rows.schema["i"].dataType

    def shard(k: int) -> DataFrame:
        own = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == k) if shards > 1 else rows
        known = [(r["i"], normalise(r["t"]), min_run_zh if r["l"] == "zh" else min_run) for r in own.collect()]
        return _search(slim, ItemIndex(known, max_edits, recall), item_type)

    return reduce(DataFrame.unionByName, [shard(k) for k in range(shards)]).withColumnRenamed("__id", id_col)


def _search(slim: DataFrame, index: ItemIndex, item_type: T.DataType) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(index)
    names = ("passage_chars", "passage_start", "equal_chars")
    schema = T.StructType([slim.schema["__id"], T.StructField("item_id", item_type), *[T.StructField(n, T.IntegerType()) for n in names]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        index = shared.value
        for batch in batches:
            for part in steps(batch, [1], 1000):
                found = index.search([normalise(t) for t in part.column(1).to_pylist()])
                if not found:
                    continue
                ids = part.column(0).take(pa.array([x[0] for x in found]))
                keys = pa.array([index.items[x[1]][0] for x in found], to_arrow_type(item_type))
                yield pa.RecordBatch.from_arrays([ids, keys, *[pa.array([x[n] for x in found], pa.int32()) for n in (2, 3, 4)]], names=schema.names)

    return slim.mapInArrow(search, schema)
