"""Main content of pages from flat text blocks.

Every block is described by word counts and link densities of itself and its
neighbours, its place relative to the headline and to long text, and how much
of the corpus repeats it.  A decision tree, trained on a small labelled table
of blocks, tells main content from everything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps
from inkloom.llm.blocks import Block, parse_blocks
from inkloom.llm.ngrams import NgramModels
from inkloom.llm.residue import LINKED, blank_sample, bounded_sample, labelled_blocks, letters, page_models, residue_pages, training_rows
from inkloom.session import written

#: Pages from which the labelled table of blocks is made, at most.
LABELLED_PAGES = 2500
#: Most site names that are masked (an automaton of them is broadcast).
MAX_SITES = 1_000_000
#: Share of the articles from which a repeated block's frequency is kept; at most (blocks a page) / SHARE are.
SHARE = 0.0005
#: Share of the articles from which a block of the labelled table that the extracted text holds is still no author's.
REPEATED = 0.002
#: Depth of the tree and least blocks of a leaf.
DEPTH, LEAF = 9, 12
FEATURES = (
    "words", "link", "words_before", "link_before", "words_after", "link_after", "tag", "place", "since_headline", "is_headline",
    "frequency", "frequency_before", "frequency_after", "article_score", "around_score", "names_site", "digits", "ends", "bold",
    "since_long", "until_long", "separators", "cell", "item", "heading", "quote", "code", "framed", "score_before", "score_after", "frame_frequency",
)

_SEPARATORS = re.compile(r"[|·›»•/]")
#: Each word is looked at once, however long it is.
_NAME = re.compile(r"(?<=[^\W_]) [A-ZÀ-Þ][\w’'-]+|(?<![A-Za-z])[A-Za-z]++(?=[぀-鿿])|(?<=[぀-鿿])[A-Za-z]+")
#: Longer blocks are a page's own text by which copies of it are known; keys of shorter ones are remembered.
LONG_CHARS = 80
_KINDS = {"td": 1, "li": 2, "h1": 3, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4, "blockquote": 5, "pre": 6, "title": 7, "nav": 8, "footer": 8, "aside": 8, "header": 8}


def char_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words (two Han characters are one) and digits of each text."""
    if not texts:
        return np.zeros(0), np.zeros(0)
    codes = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    han = (codes >= 0x3040) & (codes <= 0x9FFF)
    lower = codes | 32
    letter = ((lower >= 97) & (lower <= 122)) | ((codes >= 0xC0) & (codes < 0x2000))
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    digit = (codes >= 48) & (codes <= 57)
    return np.add.reduceat(han * 0.5 + begins, starts), np.add.reduceat(digit.astype(np.float64), starts)


class SiteNames:
    """Site names, to be masked in blocks so that repeats are counted over sites."""

    def __init__(self, names: list[str]):
        self.names = sorted({n.lower() for n in names if n and n.strip()})
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"names": self.names, "_automaton": None}

    def shown_on(self, page: str) -> list[str]:
        """The names a page holds, longest first: only these need to be looked for in its blocks."""
        if not self.names:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for n in self.names:
                self._automaton.add_word(n, n)
            self._automaton.make_automaton()
        return sorted({n for _, n in self._automaton.iter(page.lower())}, key=lambda n: (-len(n), n))


def masked(text: str, names: list[str]) -> str:
    """Letters of a block, site names masked."""
    low = text.lower()
    for n in names:
        if n in low:
            low = low.replace(n, "sitename")
    return letters(low)


def frame(text: str, names: list[str]) -> str:
    """Letters of a block without the proper names in it: of offers and comments that only a name tells apart."""
    return "frame " + masked(_NAME.sub(" ", text), names)


def _hash(key: str) -> int:
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def page_keys(blocks: list[Block], page_names: list[str], known: dict) -> list[tuple[int, int]]:
    """Hashes of each block and of its frame, 0 where there is none; ``known`` remembers those of short blocks."""
    out = []
    for b in blocks:
        t = b.text
        short = len(t) <= LONG_CHARS
        got = known.get(t) if short else None
        if got is None:
            m = masked(t, page_names)
            f = frame(t, page_names)
            got = (_hash(m) if m else 0, _hash(f) if f else 0)
            if short and len(known) < 200_000:
                known[t] = got
        out.append(got)
    return out


class BlockTable:
    """Features of the blocks of several pages at once."""

    def __init__(self, models: NgramModels, shares: dict[int, float], names: SiteNames):
        self.models, self.shares, self.names = models, shares, names
        self.known: dict = {}

    def __call__(self, pages: list[list[Block]], titles: list[str], scored: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        blocks = [b for p in pages for b in p]
        n = len(blocks)
        x = np.zeros((n, len(FEATURES)), dtype=np.float32)
        if not n:
            return x
        at = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        first = np.concatenate([[0], np.cumsum([len(p) for p in pages])[:-1]])
        col = {f: i for i, f in enumerate(FEATURES)}
        size = np.array([max(len(b.text), 1) for b in blocks], dtype=np.float32)
        texts = [b.text for b in blocks]
        count, digits = char_counts(texts)
        count = count.astype(np.float32)
        link = np.minimum(np.array([b.link_chars for b in blocks], dtype=np.float32) / size, 1.0)
        rare = SHARE / 10
        keys, sites = [], []
        for p in pages:
            shown = self.names.shown_on("\n".join(b.text for b in p))
            keys += page_keys(p, shown, self.known)
            sites += [any(n in b.text.lower() for n in shown) for b in p] if shown else [False] * len(p)
        freq = np.log10(np.array([self.shares.get(k, rare) if k else 1e-5 for k, _ in keys], dtype=np.float32))
        x[:, col["frame_frequency"]] = np.log10(np.array([self.shares.get(f, rare) if f else rare for _, f in keys], dtype=np.float32))
        score = self.models.text_scores(texts, scored)

        def beside(v: np.ndarray, step: int, blank: float) -> np.ndarray:
            out = np.full(n, blank, dtype=np.float32)
            if step > 0:
                ok = at[step:] == at[:-step]
                out[step:][ok] = v[:-step][ok]
            else:
                ok = at[:step] == at[-step:]
                out[:step][ok] = v[-step:][ok]
            return out

        article = (score[:, 0] - score[:, 1]).astype(np.float32)
        x[:, col["words"]], x[:, col["link"]] = count, link
        x[:, col["words_before"]], x[:, col["words_after"]] = beside(count, 1, -1), beside(count, -1, -1)
        x[:, col["link_before"]], x[:, col["link_after"]] = beside(link, 1, -1), beside(link, -1, -1)
        x[:, col["frequency"]], x[:, col["frequency_before"]], x[:, col["frequency_after"]] = freq, beside(freq, 1, 0), beside(freq, -1, 0)
        x[:, col["article_score"]], x[:, col["around_score"]] = article, score[:, 1]
        x[:, col["score_before"]], x[:, col["score_after"]] = beside(article, 1, -9), beside(article, -1, -9)
        kind = np.array([_KINDS.get(b.inside, 0) for b in blocks])
        x[:, col["tag"]] = kind
        for f, k in (("cell", 1), ("item", 2), ("heading", 4), ("quote", 5), ("code", 6), ("framed", 8)):
            x[:, col[f]] = kind == k
        x[:, col["place"]] = (np.arange(n) - first[at]) / np.array([max(len(p), 1) for p in pages])[at]
        named = [letters(t) for t in titles]
        headline = np.zeros(n, dtype=bool)
        for i, b in enumerate(blocks):
            t = named[at[i]]
            if t and b.inside != "title" and link[i] < LINKED:
                k = letters(b.text)
                headline[i] = k == t or k + k == t or k == t + t
        x[:, col["is_headline"]] = headline
        long_ = (count >= 18) & (link < LINKED) & (article > 0)
        index = np.arange(n)

        def since(mark: np.ndarray, blank: float) -> np.ndarray:
            last = np.maximum.accumulate(np.where(mark, index, -1))
            ok = last >= first[at]
            return np.where(ok, index - last, blank)

        x[:, col["since_headline"]] = since(headline, -1)
        x[:, col["since_long"]] = since(long_, -1)
        back = since_reversed(long_, at)
        x[:, col["until_long"]] = back
        x[:, col["names_site"]] = sites
        x[:, col["digits"]] = digits / size
        x[:, col["ends"]] = [b.text[-1] in "。！？.!?…:：;；”»" for b in blocks]
        x[:, col["bold"]] = np.minimum(np.array([b.bold_chars for b in blocks]) / size, 1.0)
        x[:, col["separators"]] = [len(_SEPARATORS.findall(b.text)) for b in blocks]
        return x


def since_reversed(mark: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Blocks until the next marked one of the same page, -1 if there is none."""
    n = len(mark)
    index = np.arange(n)
    nxt = np.minimum.accumulate(np.where(mark, index, n)[::-1])[::-1]
    same = np.zeros(n, dtype=bool)
    ok = nxt < n
    same[ok] = at[nxt[ok]] == at[ok]
    return np.where(same, nxt - index, -1)


class DecisionTree:
    """A binary classification tree (Gini impurity), stored as flat arrays."""

    def __init__(self, feature: list[int], cut: list[float], left: list[int], right: list[int], value: list[float]):
        self.feature, self.cut = np.array(feature), np.array(cut, dtype=np.float32)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> DecisionTree:
        """Greedy growth; cuts are tried at up to 64 quantiles of each feature."""
        feature: list[int] = []
        cut: list[float] = []
        left: list[int] = []
        right: list[int] = []
        value: list[float] = []

        def grow(rows: np.ndarray, level: int) -> int:
            node = len(value)
            share = float(y[rows].mean()) if len(rows) else 0.0
            feature.append(-1), cut.append(0.0), left.append(-1), right.append(-1), value.append(share)
            if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
                return node
            best = (1e-7, -1, 0.0)
            total, n = y[rows].sum(), len(rows)
            whole = share * (1 - share)
            for f in range(x.shape[1]):
                v = x[rows, f]
                cuts = np.unique(np.quantile(v, np.linspace(0.01, 0.99, 64), method="lower"))
                slot = np.searchsorted(cuts, v, side="left")  # v <= cuts[slot]
                size = np.cumsum(np.bincount(slot, minlength=len(cuts) + 1))[: len(cuts)]
                hits = np.cumsum(np.bincount(slot, weights=y[rows], minlength=len(cuts) + 1))[: len(cuts)]
                ok = (size >= leaf) & (n - size >= leaf)
                if not ok.any():
                    continue
                p, q = hits / np.maximum(size, 1), (total - hits) / np.maximum(n - size, 1)
                gain = whole - (size * p * (1 - p) + (n - size) * q * (1 - q)) / n
                i = int(np.where(ok, gain, -1).argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, float(cuts[i]))
            if best[1] < 0:
                return node
            below = x[rows, best[1]] <= np.float32(best[2])
            feature[node], cut[node] = best[1], best[2]
            left[node] = grow(rows[below], level + 1)
            right[node] = grow(rows[~below], level + 1)
            return node

        grow(np.arange(len(y)), 0)
        return cls(feature, cut, left, right, value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main blocks in each row's leaf."""
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            goes = x[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(goes, self.left[node], self.right[node])


def article_keys(blocks: list[Block], title: str) -> tuple[int, int]:
    """Two hashes by which copies of an article are known: of its title, and of its long blocks in any order.

    Too few long blocks may all be the site's: then all blocks count.  A page without title is known by its blocks.
    """
    long_ = [b.text for b in blocks if len(b.text) > LONG_CHARS]
    body = _hash("\n".join(sorted(long_ if len(long_) >= 3 else [b.text for b in blocks])))
    named = letters(title)
    return _hash("title " + named) if named else body, body


def block_shares(docs: DataFrame, html_col: str, title_col: str, names: SiteNames) -> dict[int, float]:
    """Share of all articles that show a block (or its frame), for those of at least SHARE of them.

    Copies of an article, under the same title or with the same long blocks,
    are one article: their own paragraphs are not repeated.  A block counts by
    the fewer of its different titles and different bodies.
    """
    pages = docs.select(F.col(html_col).alias("h"), F.coalesce(F.col(title_col), F.lit("")).alias("t")).filter(F.trim("h") != "")

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in steps(batch, [0], 300):
                shown_keys, titles, bodies = [], [], []
                for page, title in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    blocks = [b for b in parse_blocks(page) if b.link_chars < LINKED * len(b.text)]
                    shown = names.shown_on("\n".join(b.text for b in blocks))
                    hashes = {0} | {k for pair in page_keys(blocks, shown, known) for k in pair}  # 0 stands for the page itself
                    named, body = article_keys(blocks, title)
                    shown_keys += hashes
                    titles += [named] * len(hashes)
                    bodies += [body] * len(hashes)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (shown_keys, titles, bodies)], names=["h", "title", "body"])

    shown = pages.mapInArrow(show, "h long, title long, body long")
    counted = shown.groupBy("h").agg(F.least(F.count_distinct("title"), F.count_distinct("body")).alias("n"))
    summed = written(counted, "block-counts")
    total = (summed.filter("h = 0").head() or (0, 0))[1]
    if not total:
        return {}
    return {r["h"]: r["n"] / total for r in summed.filter((F.col("n") >= max(2.0, SHARE * total)) & (F.col("h") != 0)).collect()}


def labelled_table(sample: list[tuple[str, str, str]], table: BlockTable) -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features of the sample's blocks and whether each is main.

    A block is labelled main if the page's extracted text holds it and it is not
    repeated over REPEATED of all articles (cells and code may be), or if it is
    the headline in the body.
    """
    xs, ys = [], []
    headline, freq, cell, code, first_heading, linked = (FEATURES.index(f) for f in ("is_headline", "frequency", "cell", "code", "tag", "link"))
    for page, extracted, title in sample:
        blocks = parse_blocks(page)
        x = table([blocks], [title])
        known = {id(b): held for b, held in labelled_blocks(blocks, extracted)}
        y = np.array([known.get(id(b), False) for b in blocks], dtype=float)
        bare = {t.strip() for line in extracted.split("\n") for t in (line, *line.split("|"))}
        for i, b in enumerate(blocks):
            if id(b) not in known and b.inside != "title" and b.text in bare and b.link_chars < LINKED * len(b.text):
                y[i] = 1.0  # cells of digits
        rare = x[:, freq] < np.log10(REPEATED)
        y = np.where((x[:, headline] > 0) | ((x[:, first_heading] == _KINDS["h1"]) & rare & (x[:, linked] < LINKED)), 1.0, np.where(rare | (x[:, cell] > 0) | (x[:, code] > 0), y, 0.0))
        xs.append(x)
        ys.append(y)
    if not xs:
        return np.zeros((0, len(FEATURES)), dtype=np.float32), np.zeros(0)
    return np.vstack(xs), np.concatenate(ys)


def main_blocks(docs: DataFrame, sites: DataFrame, *, id_col: str, html_col: str, extracted_col: str, title_col: str, labelled_pages: int = LABELLED_PAGES) -> DataFrame:
    """``(id, position, block)`` of every main block of every page, in page order.

    The labelled table comes from at most ``labelled_pages`` pages, block
    frequencies from all.  ``sites`` has site_name.  Pages of residue have no
    main blocks.  NULL and empty pages have none; repeated ids each give their
    blocks; other columns are ignored; an empty table gives no rows.
    """
    known = [r[0] for r in sites.select("site_name").distinct().limit(MAX_SITES + 1).collect()]
    if len(known) > MAX_SITES:
        raise ValueError(f"at most {MAX_SITES} site names")
    names = SiteNames(known)
    some = docs.select(F.col(html_col).alias("h"), F.col(extracted_col).alias("m"), F.coalesce(F.col(title_col), F.lit("")).alias("t"))
    rows = [(r["h"], r["m"], r["t"]) for r in bounded_sample(training_rows(some, "h", "m"), "h", labelled_pages)]
    models = page_models([(h, m) for h, m, _ in rows], blank_sample(docs, html_col, extracted_col, labelled_pages))
    table = BlockTable(models, block_shares(docs, html_col, title_col, names), names)
    x, y = labelled_table(rows, table)
    table.known = {}
    tree = DecisionTree.fit(x, y) if len(y) else DecisionTree([-1], [0.0], [-1], [-1], [0.0])
    shared = docs.sparkSession.sparkContext.broadcast((table, tree))
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(title_col), F.lit("")).alias("__title"), F.col(html_col).alias("__html")).filter(F.trim("__html") != "")
    schema = T.StructType([slim.schema["__id"], T.StructField("position", T.IntegerType()), T.StructField("block", T.StringType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tree = shared.value
        for batch in batches:
            for part in steps(batch, [2], 300):
                pages, titles = [parse_blocks(h) for h in part.column(2).to_pylist()], part.column(1).to_pylist()
                scored = table.models.scores([b.text for p in pages for b in p])
                x = table(pages, titles, scored)
                main = (tree.predict(x) >= 0.5) | (x[:, FEATURES.index("is_headline")] > 0)  # the headline in the body is main by definition
                gone = residue_pages(table.models, pages, titles, scored)
                owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
                position = np.concatenate([np.arange(len(p)) for p in pages]) if pages else np.zeros(0, dtype=np.int64)
                keep = np.flatnonzero(main & ~gone[owner])
                flat = [b.text for p in pages for b in p]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner[keep])), pa.array(position[keep], pa.int32()), pa.array([flat[i] for i in keep], pa.string())], names=schema.names
                )

    return slim.mapInArrow(classify, schema).withColumnRenamed("__id", id_col)
