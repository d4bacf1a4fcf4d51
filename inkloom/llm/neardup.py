"""Near-duplicate texts by improved consistent weighted sampling.

Texts become sets of character shingles, weighted by TF-IDF.  Each text is
sampled K times by improved consistent weighted sampling; samples are banded,
texts that share a band are verified by their weighted Jaccard similarity, and
by the plain one that defines the result.  Document frequencies count classes
of near-copies, not texts: each text counts by the inverse of the size of its
largest bucket in a coarse minhash banding, so the shingles of a large group of
near-copies are not taken for phrases all texts share.  Frequencies and bucket
sizes are hashed histograms of fixed size over all texts.  Equal texts are one
representative from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps
from inkloom.session import written

#: Characters of a shingle.
SHINGLE = 5
#: Bands and samples per band.
BANDS, ROWS = 40, 5
#: Buckets of the document-frequency histogram (2**DF_BITS), whatever the size of the corpus.
DF_BITS = 18
#: Power of the inverse document frequency in a shingle's weight: phrases many texts share hardly count.
IDF_POWER = 2.0
#: Weighted Jaccard similarity that candidates need before the plain one is asked for.
WEIGHTED = 0.3
#: Bands and minima per band of the coarse banding whose bucket sizes document frequencies are corrected by.
COARSE_BANDS, COARSE_ROWS = 12, 8
#: Entries of the tables of random draws, one set for each sample.
TABLE_BITS = 15
#: Texts in a bucket from which its pairs are made by several tasks.
BLOCK = 200
#: Texts whose shingles a task remembers while it compares pairs.
KNOWN_SETS = 500
#: Texts handled at a time in Python.
CHUNK = 1500
#: A sample's value is looked for up to exp(SLACK) times its expected size before a text is evaluated in full.
SLACK = 1.8

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(text index, 64-bit hash)`` of every run of ``size`` characters, in order."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    n = len(codes) - size + 1
    key = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        key = (key ^ codes[i : n + i]) * _MIX
        key ^= key >> np.uint64(29)
    at = np.repeat(np.arange(len(texts), dtype=np.int64), np.maximum(lengths - size + 1, 0))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.maximum(lengths - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    positions = np.arange(len(at)) - first[at] + starts[at]
    return at, key[positions]


def _distinct(at: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: ``(text index, hash, term frequency)``, ordered by hash."""
    if n > 1 << 12:
        raise ValueError("at most 4096 texts at a time")
    low = np.uint64((1 << 12) - 1)  # the low bits make room for the text
    packed = np.sort((key & ~low) | at.astype(np.uint64))
    where = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, dtype=np.int64)
    tf = np.diff(np.append(where, len(packed)))
    packed = packed[where]
    return (packed & low).astype(np.int64), packed >> np.uint64(12), tf


def _chunks(values: list, size: int = CHUNK) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def _histogram(texts: DataFrame, text_col: str, add_to) -> tuple[np.ndarray, int]:
    """The sum of a histogram of 2**DF_BITS buckets over all texts, and the number of texts.

    Every task sums its texts with ``add_to(histogram, texts)`` and sends the
    sum on in 64 slices; what reaches the driver has that fixed size.
    """
    slices = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS, dtype=np.float32), 0
        for batch in batches:
            for step in steps(batch, [0], CHUNK):
                part = step.column(0).to_pylist()
                n += len(part)
                add_to(total, part)
        if n:
            parts = [np.ascontiguousarray(total[i::slices]).tobytes() for i in range(slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] * slices, pa.int64())], names=["slice", "counts", "n"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in parts:
            for blob, m in zip(batch.column("counts").to_pylist(), batch.column("n").to_pylist()):
                total, n = total + np.frombuffer(blob, dtype=np.float32).astype(np.float64), n + m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total, dtype=np.float64).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["slice", "counts", "n"])

    schema = "slice int, counts binary, n long"
    sums = texts.select(text_col).mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema)
    whole, n = np.zeros(1 << DF_BITS), 0
    for row in sums.collect():  # 64 rows of 32 kB
        whole[row["slice"] :: slices] = np.frombuffer(bytes(row["counts"]), dtype=np.float64)
        n = row["n"]
    return whole, n


def coarse_keys(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """``n x COARSE_BANDS`` buckets of the histogram: bands of minima of the distinct shingles, one permutation split into bins."""
    bins = COARSE_BANDS * COARSE_ROWS
    mixed = (key ^ np.uint64(0x632BE59BD9B4E019)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    least = np.full((n, bins), np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least.ravel(), doc * bins + (mixed % np.uint64(bins)).astype(np.int64), mixed * np.uint64(0xD6E8FEB86659FD93))
    out = np.zeros((n, COARSE_BANDS), dtype=np.uint64)
    for b in range(COARSE_BANDS):
        k = np.full(n, np.uint64(b + 1), dtype=np.uint64)
        for r in range(COARSE_ROWS):
            k = (k ^ least[:, b * COARSE_ROWS + r]) * _MIX
            k ^= k >> np.uint64(31)
        out[:, b] = k
    return (out >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _df_bucket(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)


def class_sizes(coarse: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Size of the class of near-copies of each text: of its largest bucket, less what buckets hold on average."""
    return np.maximum(sizes[coarse].max(axis=1) - sizes.mean(), 1.0)


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, float]:
    """Hashed document frequencies of all shingles over classes of near-copies, and the number of classes."""

    def add_sizes(total: np.ndarray, part: list[str]) -> None:
        at, key = shingle_hashes(part)
        doc, distinct, _ = _distinct(at, key, len(part))
        np.add.at(total, coarse_keys(doc, distinct, len(part)).ravel(), 1.0)

    sizes, _ = _histogram(texts, text_col, add_sizes)
    shared = texts.sparkSession.sparkContext.broadcast(sizes)

    def add_frequencies(total: np.ndarray, part: list[str]) -> None:
        at, key = shingle_hashes(part)
        doc, distinct, _ = _distinct(at, key, len(part))
        share = 1.0 / class_sizes(coarse_keys(doc, distinct, len(part)), shared.value)
        total += np.bincount(_df_bucket(distinct), weights=share[doc], minlength=1 << DF_BITS).astype(np.float32)
        total[-1] += share.sum()  # the last bucket counts the classes

    df, _ = _histogram(texts, text_col, add_frequencies)
    return df, float(df[-1])


@cache
def _tables(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Random draws (r, log c, beta) of each sample and table entry, and the bound log c - r."""
    rng = np.random.default_rng(seed)
    shape = (samples, 1 << TABLE_BITS)
    # a gamma(2, 1) draw is the sum of two exponential ones; in single precision throughout
    r = rng.standard_exponential(shape, dtype=np.float32) + rng.standard_exponential(shape, dtype=np.float32)
    log_c = np.log(rng.standard_exponential(shape, dtype=np.float32) + rng.standard_exponential(shape, dtype=np.float32))
    beta = rng.random(shape, dtype=np.float32)
    return r, log_c, beta, log_c - r


def weighted_samples(doc: np.ndarray, key: np.ndarray, log_w: np.ndarray, n: int, samples: int, seed: int = 7) -> np.ndarray:
    """Consistent weighted samples: an ``n x samples`` array of 64-bit identities.

    ``log a = log c - r (t - beta) - r`` with ``t = floor(log w / r + beta)``;
    the shingle with the least ``a`` is the sample, identified by it and ``t``.
    ``log c - r - log w`` is a lower bound of it, so a shingle whose bound is
    above a text's limit cannot win there once a winner is below the limit;
    the bound is looked up once for each different shingle of all texts.  A
    text without a winner below its limit is evaluated in full.  The shingles
    (``doc``, ``key``, ``log_w``) are ordered by ``key``.
    """
    r_all, c_all, b_all, bound_all = _tables(samples, seed)
    out = np.zeros((n, samples), dtype=np.uint64)
    if not len(doc):
        return out
    lw = log_w.astype(np.float32)
    # the least a of a text is about 1 / its total weight
    total = np.bincount(doc, weights=np.exp(lw), minlength=n)
    filled = np.flatnonzero(total > 0)
    limit = np.full(n, -np.inf, dtype=np.float32)
    limit[filled] = SLACK - np.log(total[filled])
    slack = limit[doc] + lw
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(start, len(key)))
    unique = key[start]
    most = np.maximum.reduceat(slack, start)
    of_unique = np.repeat(np.arange(len(start)), count)
    by_doc = np.argsort(doc, kind="stable")
    edge = np.searchsorted(doc[by_doc], np.arange(n + 1))
    tie = (key & np.uint64(0xFFFFF)).astype(np.float64) * 1e-13
    for k0 in range(0, samples, 4):
        mixed = (unique ^ np.uint64(0xD6E8FEB86659FD93 * (k0 + 1) & 0xFFFFFFFFFFFFFFFF)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        for j in range(min(4, samples - k0)):
            k = k0 + j
            index = ((mixed >> np.uint64(16 * j)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.intp)

            def least(rows: np.ndarray, i: np.ndarray, best: np.ndarray, ident: np.ndarray) -> None:
                r, w = r_all[k].take(i), lw[rows]
                b = b_all[k].take(i)
                t = np.floor(w / r + b)
                # ties on the tables' entries are settled by the shingle itself
                a = (c_all[k].take(i) - r * (t - b) - r).astype(np.float64) + tie[rows]
                d = doc[rows]
                np.minimum.at(best, d, a)
                hit = np.flatnonzero(a == best[d])
                ident[d[hit]] = (key[rows[hit]] * _MIX) ^ (t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x94D049BB133111EB))

            best, ident = np.full(n, np.inf), np.zeros(n, dtype=np.uint64)
            bound = bound_all[k].take(index)
            live = np.flatnonzero(bound <= most)
            if len(live):
                size = count[live]
                rows = np.repeat(start[live] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                i = np.repeat(index[live], size)
                inside = np.flatnonzero(bound_all[k].take(i) <= slack[rows])
                least(rows[inside], i[inside], best, ident)
            open_ = filled[best[filled] > limit[filled]]
            if len(open_):
                rows = np.concatenate([by_doc[edge[d] : edge[d + 1]] for d in open_])
                least(rows, index[of_unique[rows]], best, ident)
            out[:, k] = ident
    return out


def _log_idf(df: np.ndarray, classes: float) -> np.ndarray:
    return (IDF_POWER * np.log(np.log1p(max(classes, 1.0) / np.maximum(df, 1.0)))).astype(np.float32)


def _log_weights(key: np.ndarray, tf: np.ndarray, log_idf: np.ndarray) -> np.ndarray:
    """Log TF-IDF of shingles; term frequencies count by their logarithm."""
    return log_idf[_df_bucket(key)] + np.log1p(np.log(tf)).astype(np.float32)


def band_keys(texts: list[str], log_idf: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """``len(texts) x bands`` keys and the number of distinct shingles of each text; texts shorter than a shingle have no key that is used."""
    at, key = shingle_hashes(texts)
    doc, distinct, tf = _distinct(at, key, len(texts))
    samples = weighted_samples(doc, distinct, _log_weights(distinct, tf, log_idf), len(texts), bands * rows)
    keys = np.zeros((len(texts), bands), dtype=np.uint64)
    for b in range(bands):
        k = np.full(len(texts), np.uint64(b + 1), dtype=np.uint64)
        for s in range(rows):
            k = (k ^ samples[:, b * rows + s]) * _MIX
            k ^= k >> np.uint64(31)
        keys[:, b] = k
    return keys, np.bincount(doc, minlength=len(texts))


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts lower-cased and without white space; those shorter than a shingle are no text here."""
    text = F.lower(F.regexp_replace(F.col(text_col), r"[ \t\r\n]+", ""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.length("text") >= SHINGLE)


def _bucket_pairs(keys: DataFrame, alike: float = 0.0, apart: str | None = None) -> DataFrame:
    """Distinct pairs ``a < b`` of ids that share a key.

    A key of many ids is cut into blocks of BLOCK ids; pairs of blocks are
    separate join keys, so no task and no key has more than BLOCK squared.
    With ``alike``, pairs whose ``size`` differs by more than that factor are
    left out: their sets cannot have a Jaccard similarity of ``alike``.  With
    ``apart``, so are pairs equal in that column.
    """
    size = [*(["size"] if alike else []), *([apart] if apart else [])]
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = keys.join(sizes, "key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), blocks.cast("long")).cast("int")
    cut = shared.select("key", "id", *size, own.alias("own"), blocks.alias("blocks"))
    left = cut.select("key", F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in size], F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = cut.select("key", F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in size], F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    pairs = left.join(right, ["key", "i", "j"]).filter("a < b")
    if alike:
        # a little less than the factor, so that rounding leaves no pair out
        pairs = pairs.filter(F.least("size_a", "size_b") >= F.lit(alike * (1 - 1e-6)) * F.greatest("size_a", "size_b"))
    if apart:
        pairs = pairs.filter(F.col(f"{apart}_a") != F.col(f"{apart}_b"))
    return pairs.select("a", "b").distinct()


def _star_pairs(keys: DataFrame, alike: float) -> DataFrame:
    """Pairs of each id with the least id of each of its buckets: as many as there are ids, however large a bucket is."""
    least = keys.groupBy("key").agg(F.min(F.struct("id", "size")).alias("s"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    pairs = keys.join(least.select("key", F.col("s.id").alias("a"), F.col("s.size").alias("size_a")), "key").filter("a < id")
    pairs = pairs.filter(F.least("size_a", "size") >= F.lit(alike * (1 - 1e-6)) * F.greatest("size_a", "size"))
    return pairs.select("a", F.col("id").alias("b")).distinct()


def _similarities(log_idf: np.ndarray):
    """Plain and weighted Jaccard similarity of pairs of texts, by the weights they were sampled with."""

    def weighted_set(text: str) -> tuple[np.ndarray, np.ndarray, float]:
        at, key = shingle_hashes([text])
        _, k, tf = _distinct(at, key, 1)
        w = np.exp(_log_weights(k, tf, log_idf).astype(np.float64))
        return k, w, float(w.sum())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, tuple] = {}
        for batch in batches:
            plain, weighted = [], []
            for a, b in zip(batch["text_a"], batch["text_b"]):
                for t in (a, b):
                    if t not in sets:
                        if len(sets) > KNOWN_SETS:
                            sets.clear()
                        sets[t] = weighted_set(t)
                (ka, wa, sa), (kb, wb, sb) = sets.get(a) or weighted_set(a), sets.get(b) or weighted_set(b)
                both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                shared = float(np.minimum(wa[i], wb[j]).sum())
                plain.append(len(both) / max(len(ka) + len(kb) - len(both), 1))
                weighted.append(shared / max(sa + sb - shared, 1e-12))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "jaccard": plain, "weighted": weighted})

    return compare


class NearDuplicates:
    """Classes of equal texts and the links between different, similar texts.

    ``members`` is ``(id, rep)``: every text with at least SHINGLE characters
    and the least id with the same text.  ``links()`` is ``(a, b, jaccard,
    weighted)`` between representatives, ``a < b``.  A link needs a weighted
    Jaccard similarity of ``weighted_threshold``, by the weights sampled, and a
    plain one of ``threshold``.  NULL, empty and shorter texts are in neither.
    ``ids`` must be unique.
    """

    def __init__(self, docs: DataFrame, *, id_col: str, text_col: str, threshold: float = 0.7, weighted_threshold: float = WEIGHTED, bands: int = BANDS, rows: int = ROWS):
        self.threshold, self.weighted_threshold = threshold, weighted_threshold
        self.texts = texts = _normalised(docs, id_col, text_col)
        df, classes = document_frequencies(texts, "text")
        self.log_idf = _log_idf(df, classes)
        log_idf = texts.sparkSession.sparkContext.broadcast(self.log_idf)
        id_type = texts.schema["id"].dataType
        schema = T.StructType([T.StructField("id", id_type), T.StructField("same", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, [2], CHUNK):
                    keys, size = band_keys(part.column(2).to_pylist(), log_idf.value, bands, rows)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int32()), lists], names=schema.names)

        signed = written(texts.select("id", F.unhex(F.md5("text")).alias("same"), "text").mapInArrow(sign, schema), "near-signatures")
        reps = signed.groupBy("same").agg(F.min(F.struct("id", "size", "keys")).alias("s"), F.count(F.lit(1)).alias("n"))
        reps = written(reps.select("same", F.col("s.id").alias("rep"), F.col("s.size").alias("size"), F.col("s.keys").alias("keys"), "n"), "near-representatives")
        from inkloom.operators.skew import salted_lookup

        self.members = salted_lookup(signed.select("id", "same"), reps.select("same", "rep"), ["same"], reps.select("same", "n"), F.xxhash64("id"), how="inner").select("id", "rep")
        self.keys = reps.select(F.col("rep").alias("id"), "size", F.explode("keys").alias("key"))

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, with their similarities."""
        id_type = self.texts.schema["id"].dataType
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        needed = written(self.texts.join(wanted, "id", "left_semi"), "near-texts")
        both = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        out = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("jaccard", T.DoubleType()), T.StructField("weighted", T.DoubleType())])
        compared = both.mapInPandas(_similarities(self.log_idf), out)
        return compared.filter((F.col("weighted") >= self.weighted_threshold) & (F.col("jaccard") >= self.threshold))

    def links(self) -> DataFrame:
        """All links between representatives."""
        return self._verified(written(_bucket_pairs(self.keys, self.threshold), "near-candidates"))

    def row_pairs(self) -> DataFrame:
        """All similar pairs of rows, ``(a, b)`` with ``a < b``: links between the members of two classes, and within a class."""
        m = self.members
        left, right = m.select(F.col("id").alias("x"), F.col("rep").alias("a")), m.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        between = self.links().select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        same = _bucket_pairs(m.select("id", F.col("rep").alias("key")))
        return between.unionByName(same)

    def groups(self) -> DataFrame:
        """``(id, group)``: the least id connected to each text by links.

        Each text is first compared with the least of its buckets only, so a
        bucket of any size costs no more than its texts.  Where the texts of a
        bucket do not all come out in one group, its pairs from different
        groups are compared as well: no link between groups is left out.
        """
        stars = written(self._verified(written(_star_pairs(self.keys, self.threshold), "near-stars")).select("a", "b"), "near-star-links")
        found = written(self._labelled(stars), "near-first-groups")
        keyed = self.keys.join(found, self.keys["id"] == found["node"], "left").select("key", "id", "size", F.coalesce("label", "id").alias("label"))
        open_ = keyed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        rest = written(_bucket_pairs(keyed.join(open_, "key").select("key", "id", "size", "label"), self.threshold, apart="label"), "near-rest")
        links = written(stars.union(self._verified(rest).select("a", "b")), "near-links")
        labels = self._labelled(links)
        joined = self.members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
        return joined.select("id", F.coalesce("label", "rep").alias("group"))

    def _labelled(self, links: DataFrame) -> DataFrame:
        return components(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` with the least node of each connected component; ``edges`` (a, b) in both directions.

    Labels spread along edges and jump to their label's label, each round
    written to the shared folder, until none changes.
    """
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        ahead = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
        new = step.join(ahead, step["label"] == F.col("__n"), "left").select("node", F.least("label", F.coalesce("__l", "label")).alias("label"), "before")
        new = written(new, "labels")
        if not new.filter("label <> before").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
