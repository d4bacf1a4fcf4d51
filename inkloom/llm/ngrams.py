"""Character n-gram models of text classes, scored as log-likelihood ratios."""

from __future__ import annotations

import numpy as np

#: Characters of an n-gram, hash buckets, and the pseudo count of each.
SIZES, BITS, ALPHA = (2, 4), 17, 0.05
#: All classes are scaled to this many n-grams, so that a small training text is no vaguer than a large one.
MASS = 50_000.0
#: No n-gram counts more than this share of what the counts would be if none were above the MANY-th largest.
TOP, MANY = 0.02, 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts, each after a boundary mark, and where each text begins."""
    joined = "\x02" + "\x02".join(texts) if texts else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    digits = (codes >= 48) & (codes <= 57)
    codes = np.where(digits, np.uint64(48), codes)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    return codes, starts


def _buckets(codes: np.ndarray, size: int, bits: int = BITS) -> np.ndarray:
    """Bucket of the n-gram that begins at each character (shorter at the end)."""
    key = np.full(len(codes), np.uint64(size), dtype=np.uint64)
    padded = np.concatenate([codes, np.zeros(size, dtype=np.uint64)])
    for i in range(size):
        key = (key ^ padded[i : len(codes) + i]) * _MIX
        key ^= key >> np.uint64(31)
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def counted(texts: list[str], bits: int = BITS) -> np.ndarray:
    """Counts (n-gram size x bucket) of the texts' n-grams; none goes from one text into the next."""
    codes, starts = _codes([t.lower() for t in [*texts, ""]])
    after = np.repeat(np.append(starts[1:], len(codes)), np.diff(np.append(starts, len(codes))))
    at = np.arange(len(codes))
    return np.array([np.bincount(_buckets(codes, size, bits)[at + size - 1 <= np.minimum(after, len(codes) - 1)], minlength=1 << bits) for size in SIZES])


class NgramModels:
    """Log probabilities of hashed character n-grams in each class."""

    def __init__(self, classes: dict[str, list[str]], bits: int = BITS):
        lower = [[t.lower() for t in texts] for texts in classes.values()]
        self._fit(list(classes), bits, [[np.bincount(_buckets(_codes(x)[0], size, bits), minlength=1 << bits).astype(np.float64) if x else np.zeros(1 << bits) for size in SIZES] for x in lower])

    @classmethod
    def of_counts(cls, classes: dict[str, np.ndarray], bits: int = BITS) -> NgramModels:
        """Models of texts that were ``counted``."""
        model = cls.__new__(cls)
        model._fit(list(classes), bits, list(classes.values()))
        return model

    def _fit(self, names: list[str], bits: int, counted: list) -> None:
        self.names, self.bits, self.logs = names, bits, []
        for i in range(len(SIZES)):
            rows = []
            for own in counted:
                counts = np.asarray(own[i], dtype=np.float64)
                # one endless run of a character is not the whole class
                counts = np.minimum(counts, max(TOP * np.minimum(counts, np.sort(counts)[-MANY]).sum(), 1.0))
                counts *= MASS / max(counts.sum(), 1.0)
                rows.append(np.log((counts + ALPHA) / (MASS + ALPHA * (1 << bits))))
            self.logs.append(np.array(rows, dtype=np.float32))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(class x character scores, start of each text)``: mean of the n-gram sizes at each character."""
        codes, starts = _codes([t.lower() for t in texts])
        total = np.zeros((len(self.names), len(codes)), dtype=np.float32)
        for size, logs in zip(SIZES, self.logs):
            total += logs[:, _buckets(codes, size, self.bits)]
        return total / len(SIZES), starts

    def text_scores(self, texts: list[str], scored: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Score of each class per character, one row a text."""
        if not texts:
            return np.zeros((0, len(self.names)))
        total, starts = scored or self.scores(texts)
        sums = np.add.reduceat(total, starts, axis=1)
        return (sums / np.maximum(np.diff(np.append(starts, total.shape[1])), 1)).T

    def known_shares(self, texts: list[str], name: str) -> np.ndarray:
        """Share of each text's characters at which a class knows the longest n-gram."""
        if not texts:
            return np.zeros(0)
        codes, starts = _codes([t.lower() for t in texts])
        row = self.logs[-1][self.names.index(name)]
        known = row[_buckets(codes, SIZES[-1], self.bits)] > row.min() + 0.5
        # the last characters of a text begin n-grams that reach into the next one
        last = np.append(starts[1:], len(codes)) - 1
        ok = np.ones(len(codes), dtype=bool)
        for i in range(SIZES[-1] - 1):
            ok[np.maximum(last - i, starts)] = False
        return np.add.reduceat(known & ok, starts) / np.maximum(np.add.reduceat(ok, starts), 1)
