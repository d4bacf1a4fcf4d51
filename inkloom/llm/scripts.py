"""How likely a text is as clean text, whatever script it is written in.

Trigrams, bigrams and characters of a clean sample, backed off to a model of
scripts: within a word letters are of one script and of one case, so text in
a script the sample does not hold is still likelier than the same characters
mixed at random.
"""

from __future__ import annotations

import numpy as np

#: Scripts by code points: (name, first, last).  Later ranges win.
_RANGES = (
    ("sign", 0x20, 0x7F), ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("control", 0x00, 0x1F), ("control", 0x7F, 0x9F), ("mark", 0xA0, 0xBF),
    ("latin", 0xC0, 0x24F), ("mark", 0xD7, 0xD7), ("mark", 0xF7, 0xF7), ("mark", 0x2B0, 0x36F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x4FF), ("armenian", 0x531, 0x58F), ("hebrew", 0x5D0, 0x5EA),
    ("arabic", 0x621, 0x6FF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("mark", 0x2000, 0x24FF), ("punct", 0x2010, 0x203A), ("punct", 0xA1, 0xA1), ("punct", 0xAB, 0xAB), ("punct", 0xBB, 0xBB), ("punct", 0xBF, 0xBF), ("math", 0x2200, 0x22FF), ("box", 0x2500, 0x259F), ("mark", 0x25A0, 0x2DFF), ("han", 0x2E80, 0x2FDF), ("mark", 0x3000, 0x303F), ("kana", 0x3041, 0x30FF), ("bopomofo", 0x3100, 0x312F),
    ("mark", 0x3130, 0x33FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("private", 0xE000, 0xF8FF), ("han", 0xF900, 0xFAFF), ("mark", 0xFE00, 0xFE6F), ("full", 0xFF01, 0xFF5E), ("digit", 0xFF10, 0xFF19), ("halfkana", 0xFF61, 0xFF9F), ("lost", 0xFFFC, 0xFFFF),
)
_NAMES = ["other", *dict.fromkeys(r[0] for r in _RANGES)]
#: Letters of one word are of one of these scripts; those of East Asia stand beside each other and beside Latin ones.
_EAST = {"han", "kana", "bopomofo", "hangul", "halfkana"}
_LETTERS = _EAST | {"latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian"}
#: Probability of a letter after one of its script and case, at the start of a word, with a change of case or script.
WITHIN, START, CASE, CHANGE = 0.8, 0.02, 0.01, 0.0005
#: The same of signs, after a like one and otherwise; of characters no clean text holds.
SIGNS, SIGN, NEVER = 0.5, 0.02, 1e-6
#: The same of a sign that repeats the one before.
AGAIN = 0.2
#: Weight of the backed-off probability in counts of a bigram's and a trigram's context.
BACK_TWO, BACK_THREE = 5.0, 3.0
#: What the count of a run of two or three is discounted by, which its backed-off probability makes good: once among many texts says little.
DISCOUNT = 0.75
#: What a sample's character loses where the one before is a letter of another script, or one of them is a sign that stands in no word.
MIXED = 0.02
#: How likely a letter is one of its script's everyday ones.
_EVERYDAY = 0.95
#: The same of Han characters: those the sample does not hold are none that stand everywhere.
_EVERYDAY_HAN = 0.2


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    script = np.zeros(65536, dtype=np.uint8)
    for name, a, b in _RANGES:
        script[a : b + 1] = _NAMES.index(name)
    upper = np.zeros(65536, dtype=bool)
    small = np.ones(65536)
    size = np.bincount(script, minlength=len(_NAMES)).astype(float)
    for name in ("latin", "greek", "cyrillic", "armenian"):
        codes = np.flatnonzero(script == _NAMES.index(name))
        upper[codes] = [chr(c).isupper() for c in codes]
    # letters of the basic alphabet are the everyday ones
    everyday = {"cyrillic": (0x400, 0x45F), "greek": (0x391, 0x3CE), "hebrew": (0x5D0, 0x5EA), "arabic": (0x621, 0x64A), "latin": (0xDF, 0x17F)}
    for name in _NAMES[1:]:
        codes = np.flatnonzero(script == _NAMES.index(name))
        if name in everyday:
            common = (codes >= everyday[name][0]) & (codes <= everyday[name][1])
        elif name == "han":
            common = np.array([_everyday_han(c) for c in codes])
        elif name == "hangul":
            common = np.array([_in_charset(c, "euc_kr") for c in codes])
        else:
            continue
        n, share = common.sum(), _EVERYDAY_HAN if name == "han" else _EVERYDAY
        if name in ("latin", "greek", "cyrillic"):
            n /= 2  # a case is given by the letter before
        small[codes] = np.where(common, share / n, (1 - share) / max(len(codes) - n, 1)) * len(codes)
    return script, upper, small / size[script]


def _in_charset(code: int, charset: str) -> bool:
    try:
        return bool(chr(code).encode(charset))
    except UnicodeEncodeError:
        return False


def _everyday_han(code: int) -> bool:
    """Whether a Chinese character is in the first level of a national character set (simplified, traditional or Japanese)."""
    for charset, first, last in (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("euc_jp", 0xB0, 0xCF)):
        try:
            raw = chr(code).encode(charset)
        except UnicodeEncodeError:
            continue
        if len(raw) == 2 and first <= raw[0] <= last:
            return True
    return False


_SCRIPT, _UPPER, _SHARE = _tables()


def _weights() -> np.ndarray:
    """Probability of a script and case after another: (script before x 2 cases) x (script x 2 cases)."""
    n = len(_NAMES)
    out = np.full((2 * n, 2 * n), SIGN)
    for i, a in enumerate(_NAMES):
        for j, b in enumerate(_NAMES):
            for u in (0, 1):
                for v in (0, 1):
                    if b in ("control", "private", "lost", "other"):
                        w = NEVER if b != "other" else SIGN / 10
                    elif b not in _LETTERS:
                        w = SIGNS if a == b or {a, b} == {"full", "digit"} else SIGN
                    elif a not in _LETTERS:
                        w = START
                    elif a == b:
                        w = CASE if v and not u else WITHIN
                    elif a in _EAST and b in _EAST or {a, b} & _EAST and "latin" in (a, b):
                        w = START
                    else:
                        w = CHANGE
                    out[2 * i + u, 2 * j + v] = w
    return out


_WEIGHTS = _weights()
_IS_LETTER = np.array([a in _LETTERS for a in _NAMES])
#: Signs that stand in no word.
_APART = {"mark", "math", "box", "private", "control", "lost"}


def _mixes(a: str, b: str) -> bool:
    """Whether two characters of these kinds side by side are unusual."""
    if a in _LETTERS and b in _LETTERS:
        return a != b and not {a, b} & _EAST
    return {a, b} <= _APART | _LETTERS - _EAST and bool({a, b} & _APART) and a != b and not {a, b} <= _APART


_MIXES = np.array([[_mixes(a, b) for b in _NAMES] for a in _NAMES])


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    return np.where((codes >= 48) & (codes <= 57), 48, codes)


class CleanText:
    """Log probability of texts as clean text."""

    def __init__(self, texts: list[str]):
        """Runs of one to three characters of each text and the line ends around it; none goes from one text into the next."""
        codes = _codes("\n" + "\n".join(texts) + "\n" if texts else "")
        between = np.zeros(len(codes), dtype=bool)
        between[np.cumsum([len(t) + 1 for t in texts])[:-1]] = True
        tables = [np.unique(codes[1:], return_counts=True), np.unique(codes[:-1] << 21 | codes[1:], return_counts=True)]
        three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[~between[1:-1]] if len(codes) > 2 else np.zeros(0, np.int64)
        self._hold([*tables, np.unique(three, return_counts=True)])

    @classmethod
    def counted(cls, tables: list[tuple[np.ndarray, np.ndarray]]) -> CleanText:
        """From the ``tables`` of others, added up."""
        model = cls.__new__(cls)
        model._hold(tables)
        return model

    def _hold(self, tables: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.tables = tables
        self.one, self.two, self.three = tables
        self.total = max(float(self.one[1].sum()), 1.0)

    def with_texts(self, texts: list[str], scale: float = 1.0) -> CleanText:
        """The model of these texts as well, its own counts times ``scale``."""
        out = []
        for (keys, n), (more, m) in zip(self.tables, CleanText(texts).tables):
            known, at = np.unique(np.concatenate([keys, more]), return_inverse=True)
            out.append((known, np.bincount(at, weights=np.concatenate([n * scale, m]), minlength=len(known))))
        return self.counted(out)

    @staticmethod
    def _count(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        known, counts = table
        if not len(known):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, counts[at], 0).astype(float)

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text, read after a line end."""
        joined = _codes("".join("\n\n" + t for t in texts))
        lengths = np.array([len(t) + 2 for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        p2, p1, ch = joined[:-2], joined[1:-1], joined[2:]
        low, before = np.minimum(ch, 65535), np.minimum(p1, 65535)
        s, t = _SCRIPT[low], _SCRIPT[before]
        by_script = _WEIGHTS[2 * t.astype(np.int64) + _UPPER[before], 2 * s.astype(np.int64) + _UPPER[low]] * _SHARE[low]
        base = 0.5 * self._count(self.one, ch) / self.total * np.where(_MIXES[t, s], MIXED, 1.0) + 0.5 * by_script
        base += AGAIN * ((ch == p1) & ~_IS_LETTER[s] & (ch >= 0x80) & (ch != 0xFFFD))
        two = (np.maximum(self._count(self.two, p1 << 21 | ch) - DISCOUNT, 0) + BACK_TWO * base) / (self._count(self.one, p1) + BACK_TWO)
        three = (np.maximum(self._count(self.three, p2 << 42 | p1 << 21 | ch) - DISCOUNT, 0) + BACK_THREE * two) / (self._count(self.two, p2 << 21 | p1) + BACK_THREE)
        three = np.where(ch == 48, three / 10, three)
        sums = np.concatenate([[0.0], np.cumsum(np.log(three))])
        # three[i] is the character at i + 2; a text's own begin two after its start
        return sums[starts + lengths - 2] - sums[starts]
