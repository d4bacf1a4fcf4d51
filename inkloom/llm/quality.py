"""Per-document statistics of wording and layout, and fixed-threshold rules over them.

All statistics are computed on whole Arrow batches (RE2 kernels over the texts,
their lines and their words, numpy sums by document); no text is looped over in
Python.  Published rules with their published thresholds decide which documents
fail; each rule that a document fails is recorded by name.  What a document
that fails mostly consists of tells its kind: list, table, junk, or prose of an
unusual layout (verse, dialogue).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps

#: Frequent function words by which running text is told from word lists.
COMMON_WORDS = (
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she he her would make like him into time has look more go no way could my than been who its now did get come may "
    "der die das und in zu den nicht von sie ist des sich mit dem dass er es ein ich auf so eine auch als an nach wie im für man aber aus durch wenn nur war noch werden bei hat wir was wird sein einen welche sind oder zur um haben einer mir über ihm diese einem ihr uns da zum kann doch vor dieser mich ihn du hatte seine mehr am denn nun unter sehr selbst schon hier bis "
    "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas vous par sur faire plus dire me on mon lui nous comme mais avec tout y aller voir bien où sans tu ou leur homme si deux mari moi vouloir te femme venir quand grand celui si notre les des une est la l d c qu "
    "el que y a los se del las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque"
).split()
#: Frequent Chinese function characters.
COMMON_CHARS = "的了在是我有和就不人都一上也很到说要去你会着没看好自己这那而与把被让从但还之以因为所哪怕既然虽却往真正那么"

_END = r'[。！？.!?…]["”’»›」』)）\]*_]*$'
_BULLET = r"^(?:[-*+•▪◆·●○■□▸►‣–—]|[(（]\d{1,3}[)）]|[a-zA-Z][.)]|\[[ xX]\]|[①-⑳一二三四五六七八九十]{1,3}、)\s*\S"
_NUMBERED = r"^\d{1,3}[.)、．](?:\s+\S|[^\s\d.])"
_CHAPTER = r"^\d{1,3}(?:\.\d{1,3})+\s+\S"
_MARK_CELL = r"\S ?(?:\.{4,}|…{2,}|·{4,}|_{4,}|-{4,}) ?\S|[|║│¦].*[|║│¦]|\t.*\S|\S(?: {2,}|　+)\S.*(?: {2,}|　+)\S|\S {4,}\S|^[^|║│]{1,40} ?[|║│] ?[^|║│]{1,24}$|^\|?[-:| ]{5,}\|?$"
_CSV = r"^[^,;。，！？]{0,30}(?:[,;][^,;\s。，！？][^,;。，！？]{0,24}){2,}$"
_PAIR = r"^[^:：=。！？]{1,40}(?:[:：=→]| - )\s*[^。！？]{1,48}$"
_LOG = r"\d{1,2}:\d{2}:\d{2}[.,]\d{3}|\b(?:DEBUG|INFO|WARN|ERROR|TRACE|FATAL)\b|0x[0-9a-fA-F]{4,}|^\s*at [\w.$]+\(|^(?:[0-9a-f]{2,8}[: ]+){4,}"
_HEADING = r"^#{1,6} "
_LATIN = r"[\p{Latin}\p{Cyrillic}\p{Greek}][\p{Latin}\p{Cyrillic}\p{Greek}\p{M}'’-]*"

STATS = [
    ("n_chars", T.LongType()), ("n_lines", T.LongType()), ("n_words", T.LongType()),
    ("mean_word_length", T.DoubleType()), ("longest_word", T.LongType()), ("symbol_ratio", T.DoubleType()),
    ("digit_ratio", T.DoubleType()), ("letter_ratio", T.DoubleType()), ("punct_line_share", T.DoubleType()),
    ("sentence_ends_per_100", T.DoubleType()), ("bullet_line_share", T.DoubleType()), ("common_word_share", T.DoubleType()),
    ("distinct_word_share", T.DoubleType()), ("distinct_gram_share", T.DoubleType()), ("encoded_share", T.DoubleType()),
    ("short_line_share", T.DoubleType()), ("mark_line_share", T.DoubleType()), ("ellipsis_line_share", T.DoubleType()), ("duplicate_line_chars", T.DoubleType()), ("duplicate_gram_chars", T.DoubleType()),
    ("alphabetic_word_share", T.DoubleType()), ("stop_words", T.DoubleType()), ("hash_ellipsis_ratio", T.DoubleType()), ("row_line_share", T.DoubleType()), ("prose_share", T.DoubleType()), ("entry_share", T.DoubleType()), ("cell_share", T.DoubleType()), ("machine_share", T.DoubleType()),
]
#: Lines below this length are short (published with its rule).
SHORT_LINE = 30
_MARKED = r"^[-*+•▪◆·●○■□▸►‣–—]\s*\S"
#: Share of distinct n-grams below which a text repeats itself.
REPEATED = 0.3
#: Texts handled at a time.
STEP_ROWS = 4000
#: Characters over which distinct n-grams are counted.
STRETCH = 1000
#: Length from which one line without any sentence end is no entry of a list.
LONG_LINE = 160
#: An unmarked line without sentence end is an entry below these lengths (second: with Han characters).
LONG_ENTRY, LONG_ENTRY_HAN = 110, 48
#: Fewer lines than this are no list or table.
LEAST_ROWS = 3
#: Share of the characters from which a document is mostly of one kind.
MOSTLY = 0.5


def _flag(a: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(a, pattern)).astype(bool)


def _count(a: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(a, pattern)).astype(np.float64)


def _chars(a: pa.Array, runs: str) -> np.ndarray:
    """Characters in the matches of ``runs``, cheaper than counting single characters."""
    left = pc.utf8_length(pc.replace_substring_regex(a, runs, ""))
    return np.asarray(pc.utf8_length(a)).astype(np.float64) - np.asarray(left).astype(np.float64)


def _repeated_chars(lines: pa.Array, at: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Characters of each text in lines that stand before in it."""
    if not len(lines):
        return np.zeros(n)
    codes = np.asarray(pc.dictionary_encode(lines).indices).astype(np.int64)
    _, first = np.unique(at * (1 << 31) + codes, return_index=True)
    once = np.zeros(len(at), dtype=bool)
    once[first] = True
    return np.bincount(at, weights=size * ~once, minlength=n)


def _repeated_grams(codes: np.ndarray, of: np.ndarray, wide: np.ndarray, n: int, size: int = 10) -> np.ndarray:
    """Share of each text's word characters in runs of ``size`` words that stand before in it."""
    if len(codes) < size:
        return np.zeros(n)
    m = len(codes) - size + 1
    key = of[:m].astype(np.uint64)
    for i in range(size):
        key = (key ^ codes[i : m + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    _, first = np.unique(key, return_index=True)
    again = of[:m] == of[size - 1 :]
    again[first] = False
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(of, weights=wide * covered, minlength=n) / np.maximum(np.bincount(of, weights=wide, minlength=n), 1.0)


def _distinct_grams(texts: list[str], size: int = 4) -> np.ndarray:
    """Distinct character ``size``-grams over all, per text, counted anew every STRETCH characters so that length does not matter."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.ones(len(texts))
    parts = np.maximum(-(-lengths // STRETCH), 1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(texts)), lengths)
    stretch = np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), lengths) + (np.arange(len(codes)) - first[owner]) // STRETCH
    key = np.zeros(len(codes) - size + 1, dtype=np.uint64)
    for i in range(size):
        key = (key ^ codes[i : len(codes) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    inside = owner[: len(key)] == owner[size - 1 :]
    at, k = stretch[: len(key)][inside], key[inside]
    bits = np.uint64(max(int(parts.sum()) - 1, 1).bit_length())
    pairs = np.sort((k << bits) | at.astype(np.uint64))
    new = np.append(True, pairs[1:] != pairs[:-1])
    mask = (np.uint64(1) << bits) - np.uint64(1)
    whose = np.repeat(np.arange(len(texts)), parts)[(pairs[new] & mask).astype(np.int64)]
    distinct = np.bincount(whose, minlength=len(texts))
    return np.where(lengths >= size, distinct / np.maximum(lengths - size + 1, 1), 1.0)


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics STATS of an array of texts without nulls."""
    n = len(texts)
    chars = np.asarray(pc.utf8_length(texts)).astype(np.float64)
    solid = np.maximum(chars - _chars(texts, r"\s+"), 1.0)
    split = pc.split_pattern_regex(texts, r"\r?\n|\r")
    lines, at = pc.utf8_trim_whitespace(pc.list_flatten(split)), np.asarray(pc.list_parent_indices(split)).astype(np.int64)
    kept = np.asarray(pc.utf8_length(lines)).astype(np.int64) > 0
    lines, at = lines.filter(pa.array(kept)), at[kept]
    size = np.asarray(pc.utf8_length(lines)).astype(np.float64)

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=n)

    ends, bullet = _flag(lines, _END), _flag(lines, _BULLET)
    bare = pc.replace_substring_regex(lines, r"[.…·_-]{3,}", " ")
    bullet |= _flag(lines, _NUMBERED) | _flag(lines, _CHAPTER) & ~_flag(lines, r"[。！？.!?]$")
    inner_end = _flag(bare, r"[。！？]|[^\s\d.][.!?][\"”»)]*\s")
    log = _flag(lines, _LOG)
    cell = _flag(lines, _MARK_CELL) | (_flag(lines, _CSV) & ~ends)
    spaced = _count(lines, r"[,;，；]")
    pair = _flag(lines, _PAIR) & ~ends & ~inner_end
    link = _flag(lines, r"^(?:[-*+] )?\[[^\]]+\]\([^)]*\)$")
    heading = _flag(lines, _HEADING)
    machine = log & ~inner_end
    table = ~machine & (cell | pair) & ~heading & ~(bullet & ~_flag(lines, r"[|║\t]|[:：=]")) & ~inner_end
    brief = size < np.where(_flag(lines, r"\p{Han}"), LONG_ENTRY_HAN, LONG_ENTRY)
    entry = ~machine & ~table & (bullet | link | (~ends & ~inner_end & brief & (spaced < 6))) & ~heading
    prose = ~machine & ~table & ~entry & ~heading & (ends | inner_end)
    n_lines = np.maximum(by_doc(np.ones(len(at))), 1.0)
    all_size = np.maximum(by_doc(size * ~heading), 1.0)

    lower = pc.utf8_lower(texts)
    han = _chars(texts, r"\p{Han}+")
    split = pc.split_pattern_regex(lower, r"[\s\p{P}\p{S}]+")
    words, of = pc.list_flatten(split), np.asarray(pc.list_parent_indices(split)).astype(np.int64)
    wide = np.asarray(pc.utf8_length(words)).astype(np.float64)
    some = wide > 0
    words, of, wide = words.filter(pa.array(some)), of[some], wide[some]
    latin = ~_flag(words, r"\p{Han}")
    n_latin = np.bincount(of, weights=latin, minlength=n)
    n_words = n_latin + han
    common = np.asarray(pc.is_in(words, value_set=pa.array(COMMON_WORDS))).astype(float)
    common_share = (np.bincount(of, weights=common, minlength=n) + _count(texts, f"[{COMMON_CHARS}]")) / np.maximum(n_words, 1)
    codes = np.asarray(pc.dictionary_encode(words).indices if len(words) else pa.array([], pa.int32())).astype(np.int64)
    pairs = np.sort(of * (1 << 31) + codes)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    tokens = np.maximum(np.bincount(of, minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, of, wide)
    return {
        "n_chars": chars,
        "n_lines": by_doc(np.ones(len(at))),
        "n_words": n_words,
        "mean_word_length": np.bincount(of, weights=wide * latin, minlength=n) / np.maximum(n_latin, 1),
        "longest_word": longest,
        "symbol_ratio": _count(texts, r"[\p{S}#@%&*/\\_^~]") / solid,
        "digit_ratio": _count(texts, r"\p{N}") / solid,
        "letter_ratio": _chars(texts, r"\p{L}+") / solid,
        "punct_line_share": by_doc(ends) / n_lines,
        "sentence_ends_per_100": 100 * _count(texts, r"[。！？]|[^\s.!?][.!?][\"”»)]*(?:\s|$)") / solid,
        "bullet_line_share": by_doc(bullet) / n_lines,
        "common_word_share": np.minimum(common_share, 1.0),
        "distinct_word_share": np.bincount(pairs >> 31, minlength=n) / tokens,
        "distinct_gram_share": _distinct_grams(texts.to_pylist()),
        "encoded_share": by_doc(np.asarray(pc.utf8_length(pc.replace_substring_regex(lines, r"[A-Za-z0-9+/=_-]{40,}", ""))).astype(float) * -1 + size) / all_size,
        "short_line_share": by_doc(size < SHORT_LINE) / n_lines,
        "mark_line_share": by_doc(_flag(lines, _MARKED)) / n_lines,
        "ellipsis_line_share": by_doc(_flag(lines, r"(?:\.\.\.|…)$")) / n_lines,
        "duplicate_line_chars": _repeated_chars(lines, at, size, n) / np.maximum(by_doc(size), 1.0),
        "duplicate_gram_chars": _repeated_grams(codes, of, wide, n),
        "alphabetic_word_share": np.where(n_words > 0, (np.bincount(of, weights=latin & _flag(words, r"\p{L}"), minlength=n) + han) / np.maximum(n_words, 1), 0.0),
        "stop_words": np.minimum(common_share, 1.0) * n_words,
        "hash_ellipsis_ratio": _count(texts, r"#|…|\.\.\.") / np.maximum(n_words, 1),
        "row_line_share": by_doc(table | entry) / n_lines,
        "prose_share": by_doc(size * prose) / all_size,
        "entry_share": by_doc(size * entry) / all_size,
        "cell_share": by_doc(size * table) / all_size,
        "machine_share": by_doc(size * machine) / all_size,
    }


#: Fixed values, the published rules with their thresholds: statistic, least and most value allowed.
#: gopher: Rae et al. 2021, "Scaling Language Models: Methods, Analysis & Insights from Training Gopher", table A1.
#: fineweb: Penedo et al. 2024, "The FineWeb Datasets", section 3.6.
#: A Han character counts as a word in all but the mean word length.
PUBLISHED: dict[str, tuple[str, float, float]] = {
    "gopher_word_count": ("n_words", 50, 100_000),
    "gopher_mean_word_length": ("mean_word_length", 3, 10),
    "gopher_symbol_ratio": ("hash_ellipsis_ratio", 0, 0.1),
    "gopher_bullet_lines": ("mark_line_share", 0, 0.9),
    "gopher_ellipsis_lines": ("ellipsis_line_share", 0, 0.3),
    "gopher_alphabetic_words": ("alphabetic_word_share", 0.8, 1),
    "gopher_stop_words": ("stop_words", 2, np.inf),
    "gopher_duplicate_line_chars": ("duplicate_line_chars", 0, 0.2),
    "gopher_duplicate_10gram_chars": ("duplicate_gram_chars", 0, 0.10),
    "fineweb_line_punctuation": ("punct_line_share", 0.12, 1),
    "fineweb_duplicate_line_chars": ("duplicate_line_chars", 0, 0.1),
    "fineweb_short_lines": ("short_line_share", 0, 0.67),
}


def failed_rules(s: dict[str, np.ndarray], rules: dict[str, tuple[str, float, float]] | None = None) -> dict[str, np.ndarray]:
    """Which document fails which published rule."""
    out = {}
    for name, (stat, least, most) in (PUBLISHED if rules is None else rules).items():
        out[name] = (s[stat] < least - 1e-9) | (s[stat] > most + 1e-9)
        if name == "gopher_mean_word_length":
            out[name] &= s[stat] > 0  # texts of Han characters alone
        if name == "fineweb_line_punctuation":
            out[name] |= s[stat] <= least + 1e-9
    return out


def signs(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What a document mostly consists of, by the shares of its characters."""
    long = s["n_chars"] >= 60
    rows = s["n_lines"] >= LEAST_ROWS
    one = ~rows & (s["n_chars"] >= LONG_ENTRY)
    return {
        # junk
        "encoded_data": s["encoded_share"] > MOSTLY,
        "mostly_symbols": long & (s["letter_ratio"] < 0.5) & (s["cell_share"] < MOSTLY) & (s["machine_share"] < MOSTLY) & (s["entry_share"] < MOSTLY),
        "symbol_soup": long & (s["letter_ratio"] < 0.2) & (s["cell_share"] < MOSTLY),
        "machine_output": s["machine_share"] > MOSTLY,
        "repeats_itself": long & (s["distinct_gram_share"] < REPEATED) & (s["cell_share"] < MOSTLY),
        "no_sentence_end": (one | (s["n_chars"] >= LONG_LINE)) & (s["sentence_ends_per_100"] < 0.15) & (~rows | ((s["entry_share"] < MOSTLY) & (s["cell_share"] < MOSTLY))),
        "no_common_words": long & (s["common_word_share"] < 0.02) & (s["prose_share"] >= MOSTLY),
        # layout
        "mostly_cells": rows & (s["cell_share"] > s["prose_share"]) & (s["cell_share"] >= s["entry_share"]),
        "mostly_entries": rows & (s["entry_share"] > s["prose_share"]) & (s["entry_share"] > s["cell_share"]),
        "cells_and_entries": rows & (s["cell_share"] + s["entry_share"] > s["prose_share"]),
        "mostly_short_rows": rows & (s["row_line_share"] >= 0.75) & (s["cell_share"] + s["entry_share"] >= 0.4),
    }


JUNK_SIGNS = ("encoded_data", "mostly_symbols", "symbol_soup", "machine_output", "repeats_itself", "no_sentence_end", "no_common_words")


def kinds(s: dict[str, np.ndarray], failed: dict[str, np.ndarray]) -> np.ndarray:
    """'prose', 'list', 'table' or 'junk' for each document; only one that fails a published rule is no prose."""
    n = len(s["n_chars"])
    out = np.full(n, "prose", dtype=object)
    shown = signs(s)
    layout = shown["mostly_cells"] | shown["mostly_entries"] | shown["cells_and_entries"] | shown["mostly_short_rows"]
    out[layout & (s["entry_share"] >= s["cell_share"])] = "list"
    out[layout & (s["cell_share"] > s["entry_share"])] = "table"
    out[np.logical_or.reduce([shown[r] for r in JUNK_SIGNS])] = "junk"
    out[~np.logical_or.reduce([np.zeros(n, dtype=bool), *failed.values()])] = "prose"
    return out


def _schema(id_type: T.DataType) -> T.StructType:
    fields = [T.StructField("__id", id_type)] + [T.StructField(c, t) for c, t in STATS]
    return T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType()))])


def quality_statistics(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """One row per document: the statistics STATS, its ``kind`` and the ``reasons`` (published rules it fails).

    NULL and blank texts have zero statistics, kind 'empty' and the reason
    'empty'.  Repeated ids keep a row each; other columns are ignored; an empty
    table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    schema = _schema(slim.schema["__id"].dataType)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in steps(whole, [1], STEP_ROWS)):
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            blank = np.asarray(pc.utf8_length(pc.utf8_trim_whitespace(texts))) == 0
            s = text_statistics(texts)
            failed = failed_rules(s)
            kind = kinds(s, failed)
            kind[blank] = "empty"
            names, table = np.array(list(failed)), np.array(list(failed.values())).T
            reasons = [["empty"] if b else names[row].tolist() for b, row in zip(blank, table)]
            columns = [batch.column(0)]
            for name, t in STATS:
                values = np.where(blank, 0, s[name])
                columns.append(pa.array(values.astype(np.int64)) if isinstance(t, T.LongType) else pa.array(values.astype(np.float64)))
            columns += [pa.array(kind.tolist(), pa.string()), pa.array(reasons, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return slim.mapInArrow(stats, schema).withColumnRenamed("__id", id_col)
