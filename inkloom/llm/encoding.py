"""Text decoded with a wrong character encoding.

A hidden Markov model labels characters: one clean state, and one state for
each pair of the encoding a text was written in and the one it was read in.
Emissions are character frequencies, counted in all clean texts and in the same
texts garbled by each pair.  Each labelled span gets the inverse transform of
its state; what was lost stays U+FFFD.  A span is garbled only if the inverse
is the likelier text under a clean model that also knows scripts the texts do
not hold, by more than the state's prior costs.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.batching import steps
from inkloom.llm.scripts import CleanText
from inkloom.session import written

#: Steps of encodings: written in the first, read in the second, and so on by twos.
PAIRS: dict[str, tuple[str, ...]] = {
    "utf8>cp1252": ("utf-8", "cp1252"),
    "utf8>latin1": ("utf-8", "latin-1"),
    "utf8>cp1252 twice": ("utf-8", "cp1252", "utf-8", "cp1252"),
    "utf8>latin1 twice": ("utf-8", "latin-1", "utf-8", "latin-1"),
    "utf8>gb18030": ("utf-8", "gb18030"),
    "utf8>gbk": ("utf-8", "gbk"),
    "utf8>gbk twice": ("utf-8", "gbk", "utf-8", "gbk"),
    "utf8>big5": ("utf-8", "big5"),
    "utf8>sjis": ("utf-8", "cp932"),
    "utf8>euckr": ("utf-8", "cp949"),
    "utf8>cp437": ("utf-8", "cp437"),
    "utf8>cp850": ("utf-8", "cp850"),
    "utf8>cp1250": ("utf-8", "cp1250"),
    "utf8>cp1251": ("utf-8", "cp1251"),
    "utf8>cp1254": ("utf-8", "cp1254"),
    "utf8>koi8r": ("utf-8", "koi8-r"),
    "utf8>macroman": ("utf-8", "mac-roman"),
    "gbk>cp1252": ("gbk", "cp1252"),
    "gbk>latin1": ("gbk", "latin-1"),
    "gbk>cp1251": ("gbk", "cp1251"),
    "gbk>koi8r": ("gbk", "koi8-r"),
    "gbk>cp437": ("gbk", "cp437"),
    "gbk>macroman": ("gbk", "mac-roman"),
    "gbk>big5": ("gbk", "big5"),
    "gbk>sjis": ("gbk", "cp932"),
    "gbk>euckr": ("gbk", "cp949"),
    "gbk>cp1252>utf8>cp1252": ("gbk", "cp1252", "utf-8", "cp1252"),
    "gbk>utf8": ("gbk", "utf-8"),
    "gbk>utf8>gbk": ("gbk", "utf-8", "utf-8", "gbk"),
    "big5>gbk": ("big5", "gbk"),
    "big5>cp1252": ("big5", "cp1252"),
    "big5>utf8": ("big5", "utf-8"),
    "cp1252>utf8": ("cp1252", "utf-8"),
    "cp1252>utf8>gbk": ("cp1252", "utf-8", "utf-8", "gbk"),
    "cp1252>utf8>cp1252": ("cp1252", "utf-8", "utf-8", "cp1252"),
    "cp1252>cp1251": ("cp1252", "cp1251"),
    "cp1252>cp1250": ("cp1252", "cp1250"),
    "cp1252>gbk": ("cp1252", "gbk"),
    "cp1252>cp437": ("cp1252", "cp437"),
    "cp1252>cp850": ("cp1252", "cp850"),
    "cp1252>macroman": ("cp1252", "mac-roman"),
    "cp1252>big5": ("cp1252", "big5"),
    "cp1252>sjis": ("cp1252", "cp932"),
}
#: Characters of clean text among which the seed sentences and backed-off counts weigh as they are set; the counts of more text are scaled to so many, none is left out.
MASS = 900_000
#: Log probabilities of the clean state turning into any garbled one, and back.
ENTER, LEAVE = -11.0, -3.0
#: Log probability of a character no training text showed, in the clean state and in a garbled one.
UNSEEN, UNSEEN_GARBLED = -16.0, -20.0
#: The same in the clean state for a Chinese character of everyday use.
UNSEEN_EVERYDAY = -11.5
#: Characters that may lie between two suspicious ones of one window.
GAP = 24
#: Log-odds a suspicious character of another script gains among Latin letters, in the states it speaks for.
AMONG_LATIN = 8.0
#: By how much (log probability) the spans of a state must be likelier restored, in all: the prior of a text being garbled in just this way.
PRIOR = 8.0
#: The same of one span.
LEAST = 2.5
#: What a character costs that the state's wrong reading cannot have given.
DROPPED = 12.0
#: Characters on either side of a span that are read with it.
AROUND = 2
#: Cells of a table of best paths (windows x characters); longer windows are labelled in stretches of this many characters.
CELLS = 1 << 18
#: An enclosed span up to this length is a shown example, not garbled text.
EXAMPLE = 8
LOST = "�"

_SEED = (
    "我们决定先放着，因为这些文章的作者一直在写关于时间和工作的事情。“你好”，他说：为什么不在这里看看？（完）——很好！《书名》、；…… "
    "Où était l’élève ? « Ça va », dit-il à Noël : cœur, hôtel, naïve, août, être. À Âge École Ô Ù. "
    "Straße, Äpfel, Öl, Übung, größer, für – „schön“. ¿Qué pasó mañana? ¡Ñandú, acción, pingüino, Ángel, Úrsula, Éxito! “quoted” it’s — done… © ® ™ € £ § ° › ‹  ± × ½ ² ³ · • → ★ ☆ ■ □ ● ○ ◆ ▪ │ ║ ① ② ③ 🙂"
)
#: One or two characters of another script, or a mathematical sign within a word, among Latin letters.
_OTHER = "[\u0400-\u04ff\u2e80-\u2fdf\u3041-\u30ff\u3105-\u318f\u3400-\u9fff\uac00-\ud7af\ue000-\uf8ff\uf900-\ufaff]{1,2}"
_LONE = re.compile(rf"(?<=[A-Za-z]){_OTHER}(?=[\x00-\x7f]|\Z)|(?<![^\x00-\x7f]){_OTHER}(?=[A-Za-z])|(?<=[A-Za-z])[±×÷√∞∩≈≡≤≥](?=[A-Za-z])")
#: A short stretch beyond ASCII between marks of quotation.
_SHOWN = re.compile(rf"(?<=[“\"'‘«„「『‹])[^\x00-\x7f”’»“」』›]{{1,{EXAMPLE}}}(?=[”\"'’»“」』›])")
_OPEN, _CLOSE = "“\"'‘«„「『‹（([`", "”\"'’»“」』›）)]`"


#: Stands for U+FFFD on the way to bytes: no encoding has it.
_NO_BYTE = "\udcff"


def _own_bytes(e: UnicodeEncodeError) -> tuple[bytes, int]:
    """Control characters by their own byte, what was lost by 0xFF; what has no byte is dropped."""
    left = (0xFF if ch == _NO_BYTE else ord(ch) for ch in e.object[e.start : e.end] if ch == _NO_BYTE or "\x80" <= ch < "\xa0")
    return bytes(left), e.end


codecs.register_error("inkloom-own-bytes", _own_bytes)


def _to_bytes(text: str, encoding: str) -> bytes:
    """Encode, control characters by their own byte, what has no byte dropped."""
    if encoding != "utf-8":
        text = text.replace(LOST, _NO_BYTE)
    return text.encode(encoding, "inkloom-own-bytes")


@cache
def _single_bytes(encoding: str) -> str:
    """Characters of all bytes; those the encoding leaves undefined stay control characters."""
    out = []
    for b in range(0x100):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _from_bytes(raw: bytes, encoding: str) -> str:
    if encoding in ("cp1252", "cp1250", "cp1254", "cp1251"):
        return codecs.charmap_decode(raw, "strict", _single_bytes(encoding))[0]
    return raw.decode(encoding, "replace")


def garble(text: str, pair: str) -> str:
    """A text as it looks after the wrong reading of ``pair``."""
    steps = PAIRS[pair]
    for written, read in zip(steps[::2], steps[1::2]):
        text = _from_bytes(_to_bytes(text, written), read)
    return text


def restore(span: str, pair: str, whole: bool = False) -> str:
    """The inverse of ``garble``; lost characters are U+FFFD, a run of them one unless ``whole``."""
    steps = PAIRS[pair]
    for written, read in reversed(list(zip(steps[::2], steps[1::2]))):
        # a replacement character that was read is lost, it has no bytes
        span = LOST.join(_from_bytes(_to_bytes(x, read), written) for x in span.split(LOST))
    return span if whole else re.sub(f"{LOST}+", LOST, span)


@cache
def _longer(pair: str) -> bool:
    """Whether some pair has the steps of this one after others."""
    steps = PAIRS[pair]
    return any(len(other) > len(steps) and other[-len(steps) :] == steps for other in PAIRS.values())


@cache
def _known_to(ch: str, encoding: str) -> bool:
    return bool(_to_bytes(ch, encoding))


def _alien(span: str, encoding: str) -> bool:
    """Whether more than a tenth of a span's characters cannot come from reading in ``encoding``."""
    beyond = {ch for ch in span if ch >= "\xa0" and ch != LOST}
    return sum(not _known_to(ch, encoding) for ch in beyond) > 0.1 * len(beyond)


def _lost_in(span: str, pair: str) -> bool:
    """Whether a span shows lost characters, or the bytes of them read once more."""
    return LOST in span or any(LOST.encode() in _to_bytes(span, read) for read in PAIRS[pair][1::2] if read != "utf-8")


def lossy(pair: str) -> bool:
    """Whether the wrong reading itself destroys the text."""
    return "utf-8" in PAIRS[pair][1::2]


def _unseen(ch: str) -> float:
    """Clean log probability of a character no training text showed."""
    try:
        first = ch.encode("gb2312")[0]
    except UnicodeEncodeError:
        return UNSEEN
    # rows 16 to 55 are the characters of everyday use, rows 1 and 3 signs
    return UNSEEN_EVERYDAY if 0xB0 <= first <= 0xD7 or first in (0xA1, 0xA3) else UNSEEN


class EncodingModel:
    """Log-odds of every character in each garbled state against the clean one."""

    def __init__(self, states: list[str], odds: dict[str, np.ndarray], clean: CleanText):
        self.states, self.odds, self.clean = states, odds, clean
        self.known: dict = {}
        best = {ch: float(row.max()) for ch, row in odds.items()}
        suspicious = sorted(ch for ch, top in best.items() if top > 1.0)
        self.suspicious = re.compile("[" + "".join(map(re.escape, suspicious)) + "]") if suspicious else re.compile(r"(?!)")
        self.chars = {ch: i for i, ch in enumerate(odds)}
        self.matrix = np.array(list(odds.values()), dtype=np.float32).reshape(-1, len(states))
        self.matrix = np.vstack([self.matrix, np.full((1, len(states)), UNSEEN_GARBLED - UNSEEN), np.zeros((1, len(states)))]).astype(np.float32)
        self.unknown, self.neutral, self.lone = len(self.chars), len(self.chars) + 1, len(self.chars) + 2
        # the same rows once more, for characters among Latin letters
        self.matrix = np.vstack([self.matrix, self.matrix + AMONG_LATIN * (self.matrix > 1.0)]).astype(np.float32)

    @classmethod
    def train(cls, texts: list[str]) -> EncodingModel:
        """A model of these texts and the seed sentences."""
        words = [w for t in texts for w in _words(t)]
        held = Counter(words)
        return cls.counted(_garbled_counts([w for w, _ in held], [han for _, han in held], list(held.values())), CleanText(texts))

    @classmethod
    def counted(cls, garbled: dict[int, tuple[np.ndarray, np.ndarray]], clean: CleanText) -> EncodingModel:
        """Emissions over the characters beyond ASCII, which alone tell the states apart, from counts; the seed sentences are added.

        ``garbled`` holds the characters each pair (by its number) gives, with
        how often.  A character that was seen, however seldom among many, is
        no less likely than one never seen.
        """
        scale = min(1.0, MASS / clean.total)
        counts = Counter({chr(c): n * scale for c, n in zip(clean.one[0].tolist(), clean.one[1].tolist()) if c >= 0x80})
        counts.pop(LOST, None)
        for ch, n in Counter(_SEED).items():
            if ch >= "\x80":
                counts[ch] += 21 * n
        total = sum(counts.values())
        log_clean = {ch: max(float(np.log(n / total)), _unseen(ch)) for ch, n in counts.items()}
        garbled = {i: (codes, often * scale) for i, (codes, often) in garbled.items()}
        seed = _garbled_counts(*zip(*((w, han, 1) for w, han in _words(_SEED))))
        names, tables = [], []
        for i, pair in enumerate(PAIRS):
            held: Counter = Counter()
            for codes, n in (x[i] for x in (garbled, seed) if i in x):
                held.update(dict(zip(map(chr, codes.tolist()), n.tolist())))
            if not held:
                continue
            n = sum(held.values())
            names.append(pair)
            tables.append({ch: max(float(np.log(k / n)), UNSEEN_GARBLED) for ch, k in held.items()})
        chars = set(log_clean).union(*tables) if tables else set(log_clean)
        odds = {ch: np.array([t.get(ch, UNSEEN_GARBLED) for t in tables], dtype=np.float32) - np.float32(log_clean.get(ch, _unseen(ch))) for ch in sorted(chars)}
        return cls(names, odds, clean.with_texts([_SEED] * 20, scale))

    def _windows(self, text: str) -> list[tuple[int, int]]:
        """Stretches around suspicious characters, each labelled as one piece."""
        found: list[list[int]] = []
        for m in self.suspicious.finditer(text):
            i = m.start()
            if found and i - found[-1][1] <= GAP:
                found[-1][1] = i + 1
            else:
                found.append([i, i + 1])
        return [(a, b) for a, b in found]

    def _codes(self, text: str, a: int, b: int, lone: set[int]) -> np.ndarray:
        return np.fromiter((self.neutral if ch < "\x80" else self.chars.get(ch, self.unknown) + (self.lone if i in lone else 0) for i, ch in enumerate(text[a:b], a)), dtype=np.int64, count=b - a)

    def _apart(self, text: str, a: int, b: int) -> bool:
        """Whether no best path stays garbled from ``a`` to ``b``: leaving and entering anew costs less in every state."""
        total = np.zeros(len(self.states))
        while a < b:
            end = min(a + 4 * GAP, b)
            codes = self._codes(text, a, end, set())
            total += self.matrix[codes[codes != self.neutral]].sum(axis=0)
            if total.max() <= ENTER + LEAVE:
                return True
            a = end
        return False

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text the garbled spans ``(start, end, pair)`` of the best path.

        A window is labelled by itself if it bears that alone.  Windows that do
        not are labelled together with their neighbours: ASCII is neutral, so
        weak characters any number of ASCII characters apart add up.
        """
        work, weak = [], []
        for i, text in enumerate(texts):
            windows = self._windows(text)
            lone = {k for m in _LONE.finditer(text) for k in range(m.start(), m.end())} if windows else set()
            coded = [(a, self._codes(text, a, b, lone)) for a, b in windows]
            bears = [self._bears(codes) for _, codes in coded]
            work += [(i, a, codes) for (a, codes), ok in zip(coded, bears) if ok]
            if len(coded) > 1 and not all(bears):
                weak.append((i, coded))
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        marked = self._label([codes for _, _, codes in work])
        alone = set()
        for (i, a, codes), path in zip(work, marked):
            if path.max() >= 0:
                alone.add((i, a))
                out[i] += self._pieces(a, path)
        joined = []
        for i, coded in weak:
            group: list[tuple[int, np.ndarray]] = []
            for a, codes in coded:
                if group and self._apart(texts[i], group[-1][0] + len(group[-1][1]), a):
                    joined.append((i, group))
                    group = []
                group.append((a, codes))
            joined.append((i, group))
        joined = [(i, group) for i, group in joined if len(group) > 1 and any((i, a) not in alone for a, _ in group)]
        long_, kept = [], []
        for i, group in joined:
            first, last = group[0][0], group[-1][0] + len(group[-1][1])
            # windows' own codes, and those of what lies between them; ASCII is left out
            parts, at = [], first
            for a, codes in group:
                parts += [self._codes(texts[i], at, a, set()), codes]
                at = a + len(codes)
            whole = np.concatenate(parts)
            where = np.flatnonzero(whole != self.neutral)
            if self._bears(whole[where]):
                long_.append(whole[where])
                kept.append((i, group, first, last, where))
        for (i, group, first, last, where), path in zip(kept, self._label(long_)):
            full = np.full(last - first, -1, dtype=np.int64)
            full[where] = path
            # ASCII between two characters of one state is in it
            for x, y in zip(where[:-1], where[1:]):
                if full[x] == full[y]:
                    full[x:y] = full[x]
            out[i] += [x for a, codes in group if (i, a) not in alone for x in self._pieces(a, full[a - first : a - first + len(codes)])]
        return [sorted(s) for s in out]

    def _bears(self, codes: np.ndarray) -> bool:
        """Whether some state can pay for its entry."""
        return float(np.maximum(self.matrix[codes], 0).sum(axis=0).max(initial=0)) + ENTER > 0

    def _label(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Best paths of all windows, windows of like length at a time, at most CELLS characters with padding."""
        out: list = [None] * len(windows)
        order = sorted(range(len(windows)), key=lambda w: len(windows[w]))
        part: list[int] = []
        for w in order:
            size = len(windows[w])
            if part and (len(part) + 1) * size > CELLS:
                for v, path in zip(part, self._viterbi([windows[v] for v in part])):
                    out[v] = path
                part = []
            if size > CELLS:
                out[w] = self._long(windows[w])
            else:
                part.append(w)
        if part:
            for v, path in zip(part, self._viterbi([windows[v] for v in part])):
                out[v] = path
        return out

    def _long(self, window: np.ndarray) -> np.ndarray:
        """The path of a window of any length, in stretches that begin with the scores the last one ended with."""
        paths, clean, bad = [], None, None
        for at in range(0, len(window), CELLS):
            (path,), clean, bad = self._viterbi([window[at : at + CELLS]], clean, bad, scores=True)
            paths.append(path)
        return np.concatenate(paths)

    def _pieces(self, a: int, path: np.ndarray) -> list[tuple[int, int, str]]:
        edges = np.flatnonzero(np.diff(np.concatenate([[-2], path, [-2]])))
        return [(a + int(x), a + int(y), self.states[path[x]]) for x, y in zip(edges[:-1], edges[1:]) if path[x] >= 0]

    def _viterbi(self, windows: list[np.ndarray], clean: np.ndarray | None = None, bad: np.ndarray | None = None, scores: bool = False):
        """Best paths (-1 clean, else the state), all windows at once; ``clean`` and ``bad`` are the scores to begin with."""
        n, length, s = len(windows), max(map(len, windows)), len(self.states)
        codes = np.full((n, length), self.neutral, dtype=np.int64)
        for i, w in enumerate(windows):
            codes[i, : len(w)] = w
        begun = clean is not None
        if not begun:
            clean, bad = np.zeros(n), np.full((n, s), ENTER)
        from_bad = np.zeros((length, n), dtype=np.int16)  # state the clean one came from, -1 itself
        from_clean = np.zeros((length, n, s), dtype=bool)
        for t in range(length):
            e = self.matrix[codes[:, t]]
            if t or begun:
                top = bad.argmax(axis=1)
                back = bad[np.arange(n), top] + LEAVE
                from_bad[t] = np.where(back > clean, top, -1)
                enter = clean[:, None] + ENTER
                from_clean[t] = enter > bad
                bad = np.maximum(bad, enter) + e
                clean = np.maximum(clean, back)
            else:
                from_bad[t] = -1
                bad = bad + e
        paths = []
        for i, w in enumerate(windows):
            end = len(w) - 1
            path = np.full(len(w), -1, dtype=np.int64)
            # padding is neutral, so the last values are those of the window's end
            state = int(bad[i].argmax()) if bad[i].max() > clean[i] else -1
            for t in range(end, -1, -1):
                path[t] = state
                if t == 0:
                    break
                if state >= 0:
                    state = -1 if from_clean[t, i, state] else state
                else:
                    state = int(from_bad[t, i])
            paths.append(path)
        return (paths, clean, bad) if scores else paths

    def judged(self, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
        """Spans that are garbled text indeed, each with its restored text.

        A span takes the state whose inverse fits and gives the likeliest
        text; the spans of a state have to gain PRIOR together.  A short span
        enclosed in marks may be an example that a correct text shows: it
        counts only beside others of its state.
        """
        found: list[tuple[int, int, str, str]] = []
        gains: Counter = Counter()
        for a, b, pair in spans:
            while b < len(text) and text[b] == LOST:
                b += 1
            for c, d in self._cut(text, a, b, pair):
                span, gain = text[c:d], np.inf
                if lossy(pair) and _lost_in(span, pair):
                    found.append((c, d, pair, restore(span, pair)))
                elif best := self._best_inverse(span, text[max(c - AROUND, 0) : c], text[d : d + AROUND], pair):
                    found.append((c, d, *best[:2]))
                    gain = best[2]
                elif LOST in span:
                    found.append((c, d, pair, restore(span, pair)))
                else:
                    continue
                if LOST in span:
                    gain = np.inf
                if not self._example(text, c, d):
                    gains[found[-1][2]] += gain
        return [x for x in found if gains[x[2]] > PRIOR]

    def _cut(self, text: str, a: int, b: int, pair: str) -> list[tuple[int, int]]:
        """A span, or its stretches beside and between the examples in it, unless its own inverse is whole."""
        shown = [(max(m.start() - 1, a), min(m.end() + 1, b)) for m in _SHOWN.finditer(text, a, b)]
        shown = [s for i, s in enumerate(shown) if not i or s[0] >= shown[i - 1][1]]
        if not shown or lossy(pair) or (LOST not in (fixed := restore(text[a:b], pair)) and garble(fixed, pair) == text[a:b]):
            return [(a, b)]
        edges = [a, *[x for s in shown for x in s], b]
        return [(c, d) for c, d in zip(edges[:-1], edges[1:]) if c < d]

    def _example(self, text: str, a: int, b: int) -> bool:
        """Whether a span is short and stands between marks of quotation or brackets, with nothing lost; marks and ASCII may be in it."""
        while a < b and text[a] < "\x80":
            a += 1
        while a < b and text[b - 1] < "\x80":
            b -= 1
        if b - a > 2 and text[a] in _OPEN and text[b - 1] in _CLOSE:
            a, b = a + 1, b - 1
        return 0 < b - a <= EXAMPLE and 0 < a and b < len(text) and text[a - 1] in _OPEN and text[b] in _CLOSE and LOST not in text[a:b]

    def _best_inverse(self, span: str, before: str, after: str, pair: str) -> tuple[str, str, float] | None:
        """The state whose inverse fits and gives the likeliest text, the restored text, and by how much it is likelier."""
        key = (before, span, after, pair)
        if key not in self.known:
            # short spans come again and again
            if len(self.known) > 50_000:
                self.known.clear()
            found = self._inverse(*key)
            if len(span) > 64:
                return found
            self.known[key] = found
        return self.known[key]

    def _inverse(self, before: str, span: str, after: str, pair: str) -> tuple[str, str, float] | None:
        codes = [i for ch in span if (i := self.chars.get(ch)) is not None]
        order = [self.states[i] for i in np.argsort(-self.matrix[codes].sum(axis=0), kind="stable")] if codes else []
        fits = []
        for state in dict.fromkeys([pair, *order]):
            if lossy(state) or _alien(span, PAIRS[state][-1]) or not self._inverts(span, fixed := restore(span, state, whole=True), state):
                continue
            fits.append((state, fixed))
            # nothing reads better than a whole inverse without control characters, unless it is garbled itself
            if len(fits) == 1 and len(span) > 4 * EXAMPLE and not _longer(state) and not any("\x80" <= ch < "\xa0" or ch == LOST for ch in fixed) and garble(fixed, state) == span:
                break
        if not fits:
            return None
        scores = self.clean.totals([before + span + after, *[before + f + after for _, f in fits]])
        # characters that the state's reading cannot give are no gain
        scores[1:] -= [DROPPED * sum(ch >= "\x80" and ch != LOST and not _known_to(ch, PAIRS[state][-1]) for ch in span) for state, _ in fits]
        i = int(scores[1:].argmax())
        gain = float(scores[1 + i] - scores[0])
        return (fits[i][0], re.sub(f"{LOST}+", LOST, fits[i][1]), gain) if gain > LEAST and fits[i][1] != span else None

    def _inverts(self, span: str, fixed: str, pair: str) -> bool:
        """Whether the inverse transform fits: garbled again it is the span, or all but a few characters come out."""
        if garble(fixed, pair) == span:
            return True
        wide = [ch for ch in fixed if ch >= "\x80"]
        return bool(wide) and wide.count(LOST) - span.count(LOST) <= 0.34 * len(wide) and len(wide) >= 0.25 * sum(ch >= "\x80" for ch in span)


_REFERENCE = re.compile(r"&#[xX]?[0-9a-fA-F]+;")


def _visible(text: str, is_html: bool) -> str:
    """A text with its numeric character references resolved, one character each kept."""
    if not is_html or "&#" not in text:
        return text
    return _REFERENCE.sub(lambda m: _reference(m.group()), text)


def _reference(ref: str) -> str:
    body = ref[2:-1]
    try:
        code = int(body[1:], 16) if body[:1] in "xX" else int(body)
    except ValueError:
        return ref
    # HTML reads these as cp1252; garbled text needs the raw code
    return chr(code) if 0x80 <= code < 0x110000 and not 0xD800 <= code < 0xE000 else ref


#: Stretches with characters beyond ASCII, cut at signs that no encoding has as a second byte: each is garbled as it is in its text.
_WORD = re.compile(r"[^\x00-/]*[^\x00-\x7f][^\x00-/]*")


def _words(text: str) -> list[tuple[str, bool]]:
    """The stretches of a text that garbling changes, each with whether the text is Chinese."""
    if text.isascii():
        return []
    han = sum(ch > "\u2dff" for ch in text) > 0.1 * len(text)
    return [(w, han) for w in _WORD.findall(text)]


def _garbled_counts(words: list[str], han: list[bool], n: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By the number of a pair the characters beyond ASCII that it makes of the words, with how often; ``n`` is how often each word stands."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    han, n = np.array(han, dtype=bool), np.array(n, dtype=np.int64)
    held = {}
    for written_in, mask in (("utf-8", np.ones(len(n), dtype=bool)), ("cp1252", ~han), ("", han)):
        at = np.flatnonzero(mask)
        held[written_in] = "\n".join([words[i] for i in at]), n[at]
    for i, (pair, steps_) in enumerate(PAIRS.items()):
        text, often = held.get(steps_[0]) or held[""]
        if not len(often):
            continue
        # line ends outlast every wrong reading
        codes = np.frombuffer(garble(text, pair).encode("utf-32-le"), dtype=np.uint32)
        weights = often[np.cumsum(codes == 10)]
        wide = codes >= 0x80
        counts = np.bincount(codes[wide], weights=weights[wide])
        found = np.flatnonzero(counts)
        if len(found):
            out[i] = found, counts[found].astype(np.int64)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one to three characters (kinds 1 to 3, by key) of texts, and their words (kind 0)."""
    for batch in batches:
        for part in steps(batch, [0], 10_000):
            texts = part.column(0).to_pylist()
            words = Counter(w for t in texts for w in _words(t))
            kind, key, n = [np.zeros(len(words), dtype=np.int64)], [np.zeros(len(words), dtype=np.int64)], [np.fromiter(words.values(), dtype=np.int64, count=len(words))]
            for k, (keys, counts) in enumerate(CleanText(texts).tables, 1):
                kind.append(np.full(len(keys), k, dtype=np.int64))
                key.append(keys)
                n.append(counts)
            rest = sum(map(len, key)) - len(words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(kind)), pa.array(np.concatenate(key)), pa.array([w for w, _ in words] + [None] * rest, pa.string()),
                    pa.array([h for _, h in words] + [None] * rest, pa.bool_()), pa.array(np.concatenate(n)),
                ],
                names=["kind", "key", "word", "han", "n"],
            )


def _garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, [0], 100_000):
            for pair, (codes, n) in _garbled_counts(*(part.column(c).to_pylist() for c in range(3))).items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), pair)), pa.array(codes), pa.array(n)], names=["pair", "code", "n"])


def train_model(clean: DataFrame, text_col: str) -> EncodingModel:
    """A model of all clean texts, equal ones counted once; an empty table leaves the seed sentences.

    Texts are counted where they lie and every different word of them is
    garbled once.  The driver gets sums alone: the different characters of
    each pair, and the different runs of up to three characters.
    """
    texts = clean.select(F.col(text_col).alias("t")).filter("t is not null").distinct()
    counts = texts.mapInArrow(_counted, "kind long, key long, word string, han boolean, n long").groupBy("kind", "key", "word", "han").agg(F.sum("n").alias("n"))
    counts = written(counts, "clean-counts")
    runs = counts.filter("kind > 0").select("kind", "key", "n").toArrow()
    kind, key, n = (np.asarray(runs.column(c)) for c in range(3))
    tables = []
    for k in (1, 2, 3):
        order = np.argsort(key[kind == k])
        tables.append((key[kind == k][order], n[kind == k][order]))
    sums = counts.filter("kind = 0").select("word", "han", "n").mapInArrow(_garbled, "pair long, code long, n long").groupBy("pair", "code").agg(F.sum("n").alias("n")).toArrow()
    pair, code, n = (np.asarray(sums.column(c)) for c in range(3))
    return EncodingModel.counted({int(i): (code[pair == i], n[pair == i]) for i in np.unique(pair)}, CleanText.counted(tables))


def find_garbled(docs: DataFrame, clean: DataFrame, *, id_col: str, fields: dict[str, bool], clean_col: str) -> DataFrame:
    """``(id, field, restored, n_spans, pairs)`` of every field that holds garbled text.

    ``fields`` maps column names to whether they are HTML (numeric references
    are then read as characters).  Whole texts are labelled.  NULL and empty
    fields are never garbled; repeated ids keep a row each; other columns are
    ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train_model(clean, clean_col))
    slim = docs.select(F.col(id_col).alias("__id"), *[F.col(f).alias(f"__{f}") for f in fields])
    schema = T.StructType(
        [slim.schema["__id"], T.StructField("field", T.StringType()), T.StructField("restored", T.StringType()), T.StructField("n_spans", T.IntegerType()), T.StructField("pairs", T.ArrayType(T.StringType()))]
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in steps(batch, list(range(1, batch.num_columns)), 500):
                at_row, field, restored, n_spans, pairs = [], [], [], [], []
                for c, (name, is_html) in enumerate(fields.items(), 1):
                    texts = [_visible(t, is_html) if t else "" for t in part.column(c).to_pylist()]
                    for i, (text, spans) in enumerate(zip(texts, m.spans(texts))):
                        kept = m.judged(text, spans) if spans else []
                        if kept:
                            out, last = [], 0
                            for a, b, _, fixed in kept:
                                out += [text[last:a], fixed]
                                last = b
                            at_row.append(i)
                            field.append(name)
                            restored.append("".join([*out, text[last:]]))
                            n_spans.append(len(kept))
                            pairs.append(sorted({p for _, _, p, _ in kept}))
                if at_row:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at_row)), pa.array(field), pa.array(restored), pa.array(n_spans, pa.int32()), pa.array(pairs, pa.list_(pa.string()))], names=schema.names
                    )

    return slim.mapInArrow(label, schema).withColumnRenamed("__id", id_col)
