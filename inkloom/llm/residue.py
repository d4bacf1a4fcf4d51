"""Template residue, filler and error-page text in place of content.

Character n-gram models are fitted for articles, site surroundings and
residue (error notices, placeholders, filler) on a bounded labelled sample:
pages from which text was extracted, and pages from which none could be.
Likelihood-ratio windows localise residue in a page's blocks; a page is
excluded by coverage, when residue covers more of it than article text does.
Notes are told apart by the same residue model and one of what notes say that
no page shows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm import residue_seeds
from inkloom.functions.batching import steps
from inkloom.llm.blocks import Block, parse_blocks
from inkloom.llm.ngrams import BITS, SIZES, NgramModels, counted
from inkloom.session import written

#: Pages whose blocks, labelled by the text made from them, train the article and surroundings models, at most.
TRAINING_PAGES = 2500
#: Characters of a likelihood-ratio window.
WINDOW = 48
#: Mean log-likelihood ratio per character from which a window counts as article text.
ARTICLE_RATIO = 0.3
#: Best mean log probability below which a window is of no known kind (text no class was trained on): it counts as content.
UNKNOWN = -11.5
#: Share of the judged text that article text must cover for a page to be kept.
COVERAGE = 0.5
#: Share of a block's characters in links from which it is navigation.
LINKED = 0.5

#: Characters of a block from which it may be told as article text, and how many such ones make a page an article's.
ARTICLE_BLOCK, ARTICLE_CHARS = 60, 150
#: By how much a block of a single page must be likelier as residue to be taken for it in training.
UNIQUE_MARGIN = 0.3
#: Log-likelihood ratio from which pages without text show a block oftener.
SIGNIFICANT = 15.0

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """What blocks and lines of a page and its extracted text are compared by."""
    return _NO_LETTERS.sub("", text).lower()


def labelled_blocks(blocks: list[Block], extracted: str) -> Iterator[tuple[Block, bool]]:
    """Blocks of a page with whether its extracted text holds them; blocks without letters are skipped."""
    whole = letters(extracted)
    lines = {letters(x) for line in extracted.split("\n") for x in (line, *line.split("|"))}
    for b in blocks:
        k = letters(b.text)
        if k and b.inside != "title":
            yield b, (k in lines or (len(k) >= 12 and k in whole)) and b.link_chars < LINKED * len(b.text)


def bounded_sample(rows: DataFrame, key: str, size: int) -> list:
    """At most ``size`` rows with different ``key``, picked by its hash; what reaches the driver does not grow with the data.

    Rows whose key is NULL are left out.  Equal keys are one row, so neither
    the number nor the choice depends on how often a key is repeated.
    """
    bits = 30
    hashed = rows.filter(F.col(key).isNotNull()).withColumn("__hash", F.xxhash64(key))
    # hashes alone are shuffled for the count
    total = hashed.select("__hash").distinct().count()
    if not total:
        return []
    below = min(1 << bits, -(-(1 << bits) * 2 * size // total))
    some = hashed.filter(F.shiftrightunsigned("__hash", 64 - bits) < below)
    return some.dropDuplicates(["__hash"]).orderBy("__hash").limit(size).drop("__hash").collect()


def training_rows(docs: DataFrame, html: str, extracted: str) -> DataFrame:
    """Rows with a page and its extracted text, neither NULL nor blank."""
    return docs.filter(F.col(html).rlike(r"\S") & F.col(extracted).rlike(r"\S"))


def _training_sample(docs: DataFrame, html_col: str, extracted_col: str, rows: int) -> tuple[list[tuple[str, str]], list[str]]:
    """Pages with their extracted text, and pages without any."""
    some = docs.select(F.col(html_col).alias("h"), F.col(extracted_col).alias("m"))
    return [(r["h"], r["m"]) for r in bounded_sample(training_rows(some, "h", "m"), "h", rows)], blank_sample(docs, html_col, extracted_col, rows)


def blank_sample(docs: DataFrame, html_col: str, extracted_col: str, rows: int) -> list[str]:
    """At most ``rows`` pages from which no text was extracted: the labelled residue."""
    blank = docs.select(F.col(html_col).alias("h"), F.col(extracted_col).alias("m")).filter(F.col("h").rlike(r"\S") & ~F.coalesce(F.col("m").rlike(r"\S"), F.lit(False)))
    return [r["h"] for r in bounded_sample(blank.select("h"), "h", rows)]


def _unlinked(page: str) -> list[str]:
    """Blocks of a page but its titles (unless it has no others), and those that are mostly links: these are told by their links, not by their words."""
    blocks = parse_blocks(page)
    titles = {letters(b.text) for b in blocks if b.inside in ("title", "h1")} - {""}
    told = [b for b in blocks if b.link_chars < LINKED * len(b.text)]
    return [b.text for b in told if b.inside not in ("title", "h1") and letters(b.text) not in titles] or [b.text for b in told]


def residue_texts(good: dict[str, list[str]], shown: Counter, n_good: int, blank: list[str]) -> list[str]:
    """Blocks of pages without extracted text that are the residue.

    A block that no good page shows is residue if it is not more like them,
    which is judged crosswise: blocks of each half of the pages by models that
    know the other half's.  What good pages show too (a notice beside an
    article) is residue if pages without text show it significantly oftener.
    Each page holds some residue: where none is found so, it is the block that
    pages without text show oftener, else the new one least like good pages.  ``shown`` counts the good pages that show a block,
    by its letters.
    """
    pages = [[(letters(t), t) for t in _unlinked(page)] for page in blank]
    rate = Counter(k for p in pages for k in {k for k, _ in p})
    margin: dict[str, float] = {}
    for half in (0, 1):
        own, other = ([t for i, p in enumerate(pages) if i % 2 == h for k, t in p if k not in shown] for h in (half, 1 - half))
        if own:
            scores = NgramModels({**good, "residue": [*other, *residue_seeds.residue()]}).text_scores(own)
            for t, s in zip(own, scores):
                margin[t] = max(margin.get(t, -np.inf), float(s[2] - s[:2].max()))
    return [x for page in pages for x in _residue_of([(t, rate[k], shown.get(k), margin.get(t)) for k, t in page], len(pages), n_good)]


def _residue_of(page: list[tuple[str, int, int | None, float | None]], n_pages: int, n_good: int) -> list[str]:
    """The residue of a page, from its blocks with how many pages without text and how many good ones show them, and the margin of new ones."""
    new = [(m, letters(t), t, r) for t, r, s, m in page if not s]
    own = [t for m, _, t, r in new if m >= (0 if r > 1 else UNIQUE_MARGIN)]
    own += [t for t, r, s, _ in page if s and _more_often(r, n_pages, s, n_good)]
    if not own:
        both = [(r / n_pages * n_good / s, t) for t, r, s, _ in page if s]
        own = [max(both)[1]] if both and (max(both)[0] > 1.0 or not new) else [max(new)[2]] if new else []
    return own


def _more_often(k1: int, n1: int, k2: int, n2: int) -> bool:
    """Whether k1 of n1 is a significantly higher rate than k2 of n2 (log-likelihood ratio)."""
    p, a, b = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    if a <= b or p >= 1:
        return False
    ratio = sum(k * np.log(r / p) + (n - k) * np.log(max(1 - r, 1e-12) / (1 - p)) for k, n, r in ((k1, n1, a), (k2, n2, max(b, 1e-12))))
    return 2 * ratio > SIGNIFICANT


def learnt(sample: list[tuple[str, str]], blank: list[str]) -> dict[str, list[str]]:
    """Training texts of articles, surroundings and residue from pages with their extracted text, and pages without."""
    article, around = [], []
    shown: Counter = Counter()
    for page, extracted in sample:
        keys = set()
        for b, inside in labelled_blocks(parse_blocks(page), extracted):
            if b.link_chars < LINKED * len(b.text):
                (article if inside else around).append(b.text)
                keys.add(letters(b.text))
        shown.update(keys)
    good = {"article": article, "around": around}
    found = residue_texts(good, shown, len(sample), without_articles(good, blank))
    return {**good, "residue": [*found, *residue_seeds.residue()]}


def without_articles(good: dict[str, list[str]], blank: list[str]) -> list[str]:
    """The pages that hold no article after all: a page whose extracted text is only missing is no residue.

    A long block counts as article text if it scores like those that the
    models were not fitted on.
    """
    held_out = [t for t in good["article"][1::2] if len(t) >= ARTICLE_BLOCK]
    if not held_out or not blank:
        return blank
    models = NgramModels({k: v[::2] for k, v in good.items()})
    least = np.quantile(models.text_scores(held_out)[:, 0], 0.05)
    kept = []
    for page in blank:
        long_ = [t for t in _unlinked(page) if len(t) >= ARTICLE_BLOCK]
        scores = models.text_scores(long_)
        chars = sum(len(t) for t, s in zip(long_, scores) if s[0] >= least and s[0] > s[1])
        if chars < ARTICLE_CHARS:
            kept.append(page)
    return kept


def page_models(sample: list[tuple[str, str]], blank: list[str]) -> NgramModels:
    """Models of articles, surroundings and residue from pages with their extracted text, and pages without."""
    return NgramModels(learnt(sample, blank))


def _key(text: str) -> int:
    """64-bit key of a block's letters."""
    return int.from_bytes(hashlib.blake2b(letters(text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _half(page: str) -> int:
    return zlib.crc32(page.encode("utf-8", "surrogatepass")) & 1


_SUMS = "kind long, key long, n long"


def _sums(kind, key, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (np.broadcast_to(kind, len(key)), key, n)], names=["kind", "key", "n"])


def _emitted(counts: np.ndarray, kind: int) -> pa.RecordBatch:
    flat = counts.ravel()
    at = np.flatnonzero(flat)
    return _sums(kind, at, flat[at])


def _tables(sums: DataFrame, kinds: int, bits: int = BITS) -> list[np.ndarray]:
    """Counts of n-grams by kind; what reaches the driver is bounded by the buckets."""
    rows = sums.filter(F.col("kind") < kinds).toArrow()
    kind, key, n = (np.asarray(rows.column(c)) for c in range(3))
    out = []
    for k in range(kinds):
        flat = np.zeros(len(SIZES) << bits)
        flat[key[kind == k]] = n[kind == k]
        out.append(flat.reshape(len(SIZES), -1))
    return out


def _text_counts(bits: int):
    """Sums n-gram counts of ``(kind, text)`` rows of two kinds where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(SIZES), 1 << bits), dtype=np.int64)
        for batch in batches:
            for part in steps(batch, [1], 20_000):
                kind, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                for k in set(kind):
                    total[k] += counted([t for x, t in zip(kind, texts) if x == k], bits)
        for k in (0, 1):
            yield _emitted(total[k], k)

    return run


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _good_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of article (kinds 0, 1 by half) and surroundings (2, 3); pages that show a block (4, by key); pages (5)."""
    total = np.zeros((4, len(SIZES), 1 << BITS), dtype=np.int64)
    for batch in batches:
        for part in steps(batch, [0, 1], 500):
            texts: list[list[str]] = [[], [], [], []]
            keys: Counter = Counter()
            for page, extracted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                told = [(b.text, inside) for b, inside in labelled_blocks(parse_blocks(page), extracted) if b.link_chars < LINKED * len(b.text)]
                for t, inside in told:
                    texts[2 * (not inside) + _half(page)].append(t)
                keys.update({_key(t) for t, _ in told})
            for k, own in enumerate(texts):
                if own:
                    total[k] += counted(own)
            yield _sums(4, list(keys), list(keys.values()))
            yield _sums(5, [0], [part.num_rows])
    for k in range(4):
        yield _emitted(total[k], k)


def whole_residue(docs: DataFrame, html: str, extracted: str) -> tuple[dict[str, np.ndarray], DataFrame]:
    """What ``learnt`` takes from samples, of all pages: counted n-grams of articles, surroundings and residue, and the residue's texts.

    Every page counts as often as it is stored.  The driver gets counts by
    bucket alone.
    """
    some = docs.select(F.col(html).alias("h"), F.col(extracted).alias("m")).filter(F.col("h").rlike(r"\S"))
    has = F.coalesce(F.col("m").rlike(r"\S"), F.lit(False))
    sums = written(_summed(some.filter(has).mapInArrow(_good_counts, _SUMS)), "page-counts")
    a0, a1, s0, s1 = _tables(sums, 4)
    n_good = (sums.filter("kind = 5").agg(F.sum("n")).head()[0]) or 0
    good = {"article": a0 + a1, "around": s0 + s1}
    spread = docs.sparkSession.sparkContext.broadcast
    first = spread(NgramModels.of_counts({"article": a0, "around": s0}))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, [0, 1], 500):
                rows = [(h, m) for h, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if _half(h)]
                long_ = [b.text for h, m in rows for b, inside in labelled_blocks(parse_blocks(h), m) if inside and len(b.text) >= ARTICLE_BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array(np.round(first.value.text_scores(long_)[:, 0].astype(np.float64), 4))], names=["s"])

    # scores are rounded, so that those told apart are few
    least = some.filter(has).mapInArrow(held_out, "s double").agg(F.percentile("s", F.lit(0.05))).head()[0] if n_good else None

    def blank_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, [1], 500):
                out = []
                for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    told = _unlinked(page)
                    long_ = [t for t in told if len(t) >= ARTICLE_BLOCK]
                    scores = first.value.text_scores(long_)
                    if least is None or sum(len(t) for t, s in zip(long_, scores) if s[0] >= least and s[0] > s[1]) < ARTICLE_CHARS:
                        out += [(i, _half(page), _key(t), t) for t in told] or [(i, 0, None, None)]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["page", "half", "key", "text"])

    numbered = some.filter(~has).select(F.monotonically_increasing_id().alias("page"), "h")
    blocks = written(numbered.mapInArrow(blank_blocks, "page long, half long, key long, text string"), "blank-blocks")
    n_pages = blocks.agg(F.count_distinct("page")).head()[0]
    rate = blocks.groupBy("key").agg(F.count_distinct("page").alias("rate"))
    shown = sums.filter("kind = 4").select("key", F.col("n").alias("shown"))
    facts = written(blocks.join(rate, "key").join(shown, "key", "left"), "blank-facts")
    new = facts.filter("shown is null").select("half", "text")
    h0, h1 = _tables(_summed(new.mapInArrow(_text_counts(BITS), _SUMS)), 2)
    seeds = counted(residue_seeds.residue())
    cross = spread([NgramModels.of_counts({**good, "residue": other + seeds}) for other in (h1, h0)])

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, [1], 20_000):
                half, texts = np.asarray(part.column(0)), part.column(1).to_pylist()
                out = np.zeros(len(texts))
                for h in (0, 1):
                    at = np.flatnonzero(half == h)
                    if len(at):
                        scores = cross.value[h].text_scores([texts[i] for i in at])
                        out[at] = scores[:, 2] - scores[:, :2].max(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out)], names=["text", "margin"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for page in batch.column(0).to_pylist() for t in _residue_of([(b["text"], b["rate"], b["shown"], b["margin"]) for b in page], n_pages, n_good)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    margin = new.distinct().mapInArrow(margins, "text string, margin double").groupBy("text").agg(F.max("margin").alias("margin"))
    pages = facts.join(margin, "text", "left").groupBy("page").agg(F.collect_list(F.struct("text", "rate", "shown", "margin")).alias("b"))
    texts = written(pages.select("b").mapInArrow(decide, "text string"), "residue-texts")
    found, _ = _tables(_summed(texts.select(F.lit(0).cast("long").alias("kind"), "text").mapInArrow(_text_counts(BITS), _SUMS)), 2)
    return {**good, "residue": found + seeds}, texts


def window_shares(total: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each text in windows of article text, and in windows of residue, from ``NgramModels.scores``."""
    n = len(starts)
    if not n:
        return np.zeros(0), np.zeros(0)
    length = np.diff(np.append(starts, total.shape[1]))
    # windows never cross a text: each text is cut into equal windows of about WINDOW characters
    pieces = np.maximum(np.round(length / WINDOW), 1).astype(np.int64)
    owner = np.repeat(np.arange(n), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    cuts = starts[owner] + inner * length[owner] // pieces[owner]
    size = np.diff(np.append(cuts, total.shape[1]))
    mean = np.add.reduceat(total, cuts, axis=1) / size
    residue = mean[2]
    unknown = mean.max(axis=0) < UNKNOWN
    is_article = (mean[0] - np.maximum(mean[1], residue) > ARTICLE_RATIO) | unknown
    is_residue = (residue > mean[0]) & ~unknown
    return np.bincount(owner, weights=size * is_article, minlength=n), np.bincount(owner, weights=size * is_residue, minlength=n)


def residue_pages(models: NgramModels, pages: list[list[Block]], titles: list[str], scored: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which pages hold residue instead of an article; ``scored`` are the models' scores of all blocks, if known."""
    n = len(pages)
    blocks = [b for p in pages for b in p]
    if not blocks:
        return np.zeros(n, dtype=bool)
    at = np.repeat(np.arange(n), [len(p) for p in pages])
    named = [letters(t) for t in titles]
    judged = np.array([
        b.inside != "title" and b.link_chars < LINKED * len(b.text) and not (named[i] and letters(b.text) == named[i]) for i, b in zip(at, blocks)
    ])
    headline = np.array([b.inside == "h1" for b in blocks])
    article, residue = window_shares(*(scored or models.scores([b.text for b in blocks])))
    a = np.bincount(at, weights=article * (judged & ~headline), minlength=n)
    r = np.bincount(at, weights=residue * judged, minlength=n)
    return (r > 0) & (a < COVERAGE * (a + r))


def find_residue_pages(docs: DataFrame, *, id_col: str, html_col: str, extracted_col: str, title_col: str, whole: tuple[dict[str, np.ndarray], DataFrame] | None = None) -> DataFrame:
    """``(id, is_residue)`` of every page with text.

    The models learn from all pages whose extracted text tells article from
    surroundings, and all without extracted text (``whole`` is what they gave,
    if known); every page is judged by its HTML alone.
    NULL and empty pages hold no residue and are left out; repeated ids keep a
    row each; other columns are ignored; an empty table gives no rows.
    """
    models = docs.sparkSession.sparkContext.broadcast(NgramModels.of_counts((whole or whole_residue(docs, html_col, extracted_col))[0]))
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(title_col), F.lit("")).alias("__title"), F.col(html_col).alias("__html")).filter(F.trim("__html") != "")
    schema = T.StructType([slim.schema["__id"], T.StructField("is_residue", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, [2], 500):
                flags = residue_pages(models.value, [parse_blocks(h) for h in part.column(2).to_pylist()], part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(flags)], names=schema.names)

    return slim.mapInArrow(judge, schema).withColumnRenamed("__id", id_col)


#: By how much (log probability, in all) a clause must be likelier as residue than as a report of the collector.
CLAUSE_RATIO = 14.0
#: Share of a clause's characters at which the residue model must know the n-gram: what no class has seen is no residue.
KNOWN = 0.6
#: Mean log-likelihood ratio of a character from which a clause need not be known: its signs (template brackets) tell it.
STRONG = 1.0
#: Different clauses that follow a first one which names its source.
FOLLOWERS = 3
#: Bits of the note models' n-gram buckets: enough that few n-grams share one.
NOTE_BITS = 20
_DIGITS = re.compile(r"\d+")
_CLAUSE = re.compile(r"[\r\n|；;：]+|[:\]]\s+")


def clauses(note: str) -> list[str]:
    """The parts of a note, between line ends, bars, semicolons, colons and after brackets."""
    return [c for x in _CLAUSE.split(note) if (c := x.strip())]


class NoteModel:
    """Models of residue and of the collector's reports, and what the collector puts before either."""

    def __init__(self, notes: list[str], pages: list[str]):
        """``pages`` are texts of residue as pages show them.

        Clauses of ``notes`` of which the residue knows less than KNOWN are the
        collector's.  A first clause that FOLLOWERS different ones follow is
        no report but names its source.
        """
        shown = {letters(t) for t in pages}
        parts = [clauses(n) for n in notes]
        after: dict[str, set[str]] = {}
        for p in parts:
            if len(p) > 1:
                after.setdefault(_masked(p[0]), set()).add(_masked(p[1]))
        self.sources = {k for k, v in after.items() if len(v) >= FOLLOWERS}
        told = [c for p in parts for c in self.bare(p) if letters(c) not in shown]
        own = [c for c, known in zip(told, NgramModels({"residue": pages}, NOTE_BITS).known_shares(told, "residue")) if known < KNOWN]
        self.models = NgramModels({"residue": pages, "collector": [*own, *residue_seeds.collector()]}, NOTE_BITS)

    @classmethod
    def of_counts(cls, residue: np.ndarray, collector: np.ndarray, sources: set[str]) -> NoteModel:
        """From counted n-grams."""
        model = cls.__new__(cls)
        model.sources, model.models = sources, NgramModels.of_counts({"residue": residue, "collector": collector}, NOTE_BITS)
        return model

    def bare(self, parts: list[str]) -> list[str]:
        """The clauses of a note without its sources."""
        at = 0
        while at < len(parts) - 1 and _masked(parts[at]) in self.sources:
            at += 1
        return parts[at:]


def _masked(clause: str) -> str:
    return _DIGITS.sub("0", clause.lower())


def residue_notes(model: NoteModel, notes: list[str]) -> list[bool]:
    """Which notes carry residue text of a page rather than reports of the collector: some clause is residue of a known kind."""
    parts = [model.bare(clauses(n)) for n in notes]
    flat = [c for p in parts for c in p]
    if not flat:
        return [False] * len(notes)
    mean = model.models.text_scores(flat)
    size = np.array([len(c) + 1 for c in flat])
    ratio = mean[:, 0] - mean[:, 1]
    hit = (ratio * size > CLAUSE_RATIO) & ((ratio > STRONG) | (model.models.known_shares(flat, "residue") >= KNOWN))
    owner = np.repeat(np.arange(len(notes)), [len(p) for p in parts])
    return (np.bincount(owner, weights=hit, minlength=len(notes)) > 0).tolist()


def whole_notes(notes: DataFrame, texts: DataFrame) -> NoteModel:
    """What ``NoteModel`` takes from lists, of all different ``notes`` and the residue's ``texts``."""
    notes = written(notes.select(F.col(notes.columns[0]).alias("note")).distinct(), "notes")
    spread = notes.sparkSession.sparkContext.broadcast

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {(_masked(p[0]), _masked(p[1])) for n in batch.column(0).to_pylist() if len(p := clauses(n)) > 1}
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["first", "next"])

    after = notes.mapInArrow(followed, "first string, next string").distinct().groupBy("first").count()
    sources = {r[0] for r in after.filter(F.col("count") >= FOLLOWERS).select("first").collect()}
    found, _ = _tables(_summed(texts.select(F.lit(0).cast("long").alias("kind"), "text").mapInArrow(_text_counts(NOTE_BITS), _SUMS)), 2, NOTE_BITS)
    found = found + counted(residue_seeds.residue(), NOTE_BITS)
    seeds = counted(residue_seeds.collector(), NOTE_BITS)
    model = spread(NoteModel.of_counts(found, seeds, sources))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [c for n in batch.column(0).to_pylist() for c in model.value.bare(clauses(n))]
            out = [c for c, known in zip(out, model.value.models.known_shares(out, "residue")) if known < KNOWN]
            yield pa.RecordBatch.from_arrays([pa.array([_key(c) for c in out], pa.int64()), pa.array(out, pa.string())], names=["key", "text"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["key"])

    seed_keys = [(_key(t),) for t in residue_seeds.residue()]
    shown = texts.distinct().mapInArrow(keys, "key long").union(notes.sparkSession.createDataFrame(seed_keys, "key long")).distinct()
    own = notes.mapInArrow(told, "key long, text string").join(shown, "key", "left_anti").select(F.lit(0).cast("long").alias("kind"), "text")
    reports, _ = _tables(_summed(own.mapInArrow(_text_counts(NOTE_BITS), _SUMS)), 2, NOTE_BITS)
    return NoteModel.of_counts(found, reports + seeds, sources)


def find_residue_notes(rows: DataFrame, pages: DataFrame, *, id_col: str, note_col: str, html_col: str, extracted_col: str, whole: tuple[dict[str, np.ndarray], DataFrame] | None = None) -> DataFrame:
    """``(id)`` of every row whose note carries residue text of a page.

    The models learn from all different notes and all pages with and without
    extracted text (``whole`` is what the pages gave, if known); every note is
    judged.  Equal notes of a batch are judged once, without a shuffle.  NULL
    and blank notes carry none; repeated ids keep a row each; an empty table
    gives no rows.
    """
    slim = rows.select(F.col(id_col).alias("__id"), F.col(note_col).alias("__note")).filter(F.col("__note").rlike(r"\S"))
    models = rows.sparkSession.sparkContext.broadcast(whole_notes(slim.select("__note"), (whole or whole_residue(pages, html_col, extracted_col))[1]))
    schema = T.StructType([slim.schema["__id"]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, [1], 20_000):
                notes = part.column(1).to_pylist()
                distinct = list(dict.fromkeys(notes))
                flags = dict(zip(distinct, residue_notes(models.value, distinct)))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array([flags[n] for n in notes], pa.bool_()))], names=schema.names)

    return slim.mapInArrow(judge, schema).withColumnRenamed("__id", id_col)
