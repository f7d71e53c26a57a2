"""Sentence units of texts in any language and script, by a hidden-event n-gram model.

Layout comes first: blank lines, headings (one line of at most HEADING characters without a sentence mark) and list
items end units. Inside a paragraph every gap that may hide a boundary (after sentence punctuation and what closes
behind it, at a single line break, at a space of a script without sentence punctuation, and between all words of a
paragraph without any sentence mark) is an event of a hidden-event language model over words: the event given
the words and punctuation to its left, and the words to its right given the event. Words are lower case,
numbers are classes, rare words are one class; runs of a script without spaces count by their first and last
characters. The model is trained on the corpus itself by expectation maximisation: the certain boundaries are
the ends and starts of paragraphs, and first guesses follow punctuation and capitals. Posteriors along a
paragraph come from forward-backward, where units of one word are unlikely; a gap is a boundary if its
posterior is above one half.

Training counts each distinct pattern of a gap once with its number over the whole corpus; the tables that go
to the workers keep what makes up at least a share `RARE` of all gaps, so their size is bounded by its inverse.

Null, empty and blank texts have no units. Texts are read whole, of any length. Repeated rows give repeated
units. Ties (posterior of exactly one half) are no boundary. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import checkpointed

RARE = 2e-6
WORD_SHARE = 2e-5
LEAST = 3
ROUNDS = 3
HEADING = 100

_LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_BULLET = regex.compile(r"\s*(?:[-*+•‣▪◦●○∙·–—]|☐|☑|✓|→)[ \t ]+\S")
_NUMBERED = regex.compile(r"\s*(\d{1,3})[.)]\s+\S")
_TOKEN = regex.compile(
    r"(?P<url>(?:https?://|www\.)[^\s<>\"“”„«»]*[^\s<>\"“”„«».,;:!?…)\]'’]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<run>[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+)"
    r"|(?P<char>[\p{Han}\p{Hiragana}\p{Katakana}ー々])"
    r"|(?P<num>\p{Nd}+(?:[.,:/]\p{Nd}+)*)"
    r"|(?P<word>[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*)"
    r"|(?P<end>[.!?…。！？｡।॥؟۔]+)"
    r"|(?P<other>\S)"
)
_TERMINAL = frozenset(".!?…。！？｡।॥؟۔")
_OPEN = {"„": "“”", "“": "”", "«": "»", "»": "«", '"': '"', "‘": "’", "‚": "‘’", "「": "」", "『": "』", "《": "》", "〈": "〉", "(": ")", "[": "]", "（": "）", "【": "】", "‹": "›"}
_CLOSING = frozenset("”“»«\"’‘」』》〉)]）】›")
_QUOTES = frozenset("„“«»\"‘‚「『‹")
#: Abbreviations that stand before a name or a number, for the first guess only.
BEFORE = frozenset("dr prof mr mrs ms mme mlle capt cap st g gđa gdja gdin ing inž mag akad sv ul br str v no nr num vol fig gen lt col sgt rev hon tzv npr tj odn tel vs cf ca cca kb approx bzw okt nov dec jan feb febr mar márc apr ápr jún júl aug sep sept szept oct ул проф бр стр гђа др им тзв нпр тј одн см рис डॉ श्री د أ κ αρ".split())


def layout(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """Blocks of lines: ('line', [span]) is one unit, ('text', spans) is a paragraph. Spans are without outer white space."""
    out: list[tuple[str, list[tuple[int, int]]]] = []
    block: list[tuple[int, int]] = []
    at = 0
    spans = []
    for m in _LINE.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))

    def close() -> None:
        if block:
            out.extend(_blocks(text, block))
            block.clear()

    for s, e in spans:
        a, b = s, e
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            close()
        else:
            block.append((a, b))
    close()
    return out


def _blocks(text: str, lines: list[tuple[int, int]]) -> list[tuple[str, list[tuple[int, int]]]]:
    numbers = [int(m[1]) if (m := _NUMBERED.match(text, a, b)) else None for a, b in lines]
    numbered = {i for i in range(len(lines)) for j in (i - 1, i + 1) if 0 <= j < len(lines) and numbers[i] is not None and numbers[j] is not None and numbers[j] - numbers[i] == j - i}
    items = {i for i, (a, b) in enumerate(lines) if _BULLET.match(text, a, b)} | numbered
    if len(lines) == 1 and not items and heading(text[lines[0][0] : lines[0][1]]):
        return [("line", lines[:])]
    out, rest = [], []
    for i, line in enumerate(lines):
        if i in items:
            if rest:
                out.append(("text", rest))
                rest = []
            out.append(("line", [line]))
        else:
            rest.append(line)
    if rest:
        out.append(("text", rest))
    return out


_INNER = regex.compile(r"[!?…。！？।؟][\p{Pf}\p{Pe}\p{Pi}\"]*\s+\S")
_UNSPACED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def heading(line: str) -> bool:
    """A paragraph of one short line that no sentence punctuation ends."""
    if len(line) > HEADING or _UNSPACED.search(line):
        return False
    end = line.rstrip("”“»«\"’‘」』》)]）")
    return bool(end) and end[-1] not in _TERMINAL and end[-1] not in ",;" and not _INNER.search(line)


@dataclass
class Gap:
    end: int  # where the unit would end
    start: int  # where the next one would start
    key: tuple[str, str, str, str, str, str]  # two words before, punctuation, capital, two words after
    guess: float
    words: int  # words since the gap before


def _class(kind: str, s: str) -> str:
    if kind == "num":
        return "<n>" if any(not c.isdigit() for c in s) else f"<n{min(len(s), 5)}>"
    if kind == "url":
        return "<url>"
    if kind == "word":
        if len(s) == 1 and s.isupper():
            return "<I>"
        if len(s) < 6 and len(s) > 1 and all(c in "IVXLC" for c in s):
            return "<rom>"
        return s.lower()
    return s


def _terminal(s: str) -> str:
    if "…" in s or s.startswith(".."):
        return "…"
    for c, t in (("?", "?"), ("？", "？"), ("؟", "?"), ("!", "!"), ("！", "！"), ("。", "。"), ("｡", "。"), ("।", "।"), ("॥", "।"), ("۔", ".")):
        if c in s:
            return t
    return "."


_GREEK = regex.compile(r"\p{Greek}")


WORDS = frozenset(("word", "num", "url", "run", "char"))
#: Words from which a paragraph without any sentence mark has a gap between all of its words.
UNMARKED = 20


def _left(kind: str, s: str) -> str:
    return "t:" + s[-6:] if kind == "run" else _class(kind, s)


def scan(text: str, lines: list[tuple[int, int]]) -> tuple[list[Gap], tuple[str, str], tuple[str, str, str]]:
    """Of a paragraph: the gaps that may hide a boundary, in order; its first two words; its last two words and mark.

    A text is tokenised once, here. Only signs, line ends and runs are looked at one by one; words are classed where
    a gap needs them. A paragraph of UNMARKED words or more without any sentence mark has a gap (`·`) between all words.
    """
    first, last = lines[0][0], lines[-1][1]
    toks = [(m.lastgroup, m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, first, last)]
    n = len(toks)
    body = text[first:last]
    cased = body.upper() != body and body.lower() != body
    starts = {a for a, _ in lines[1:]}
    kinds = [t[0] for t in toks]
    marked = "end" in kinds
    look = [i for i, k in enumerate(kinds) if k not in WORDS]
    if starts or "run" in kinds:
        look = sorted({*look, *(i for i in range(n - 1) if kinds[i] in WORDS and (toks[i + 1][1] in starts or kinds[i + 1] == "run"))})
    if not marked and n >= UNMARKED and sum(k in WORDS for k in kinds) >= UNMARKED:
        look = range(n)
        everywhere = True
    else:
        everywhere = False
    out: list[Gap] = []
    opened: list[tuple[str, str]] = []  # what closes it, and where it opened: 0 at a start, 1 after a colon, 2 elsewhere
    since = 0  # token behind the gap before

    def right(j: int) -> tuple[str, str]:
        found = []
        while j < n and len(found) < 2:
            kind, _, _, s = toks[j]
            if s in _OPEN:
                pass
            elif s == "." and found and found[0][:2] == "<n" and j + 1 < n and kinds[j + 1] == "word":
                found.append("." + _class("word", toks[j + 1][3]))  # an ordinal and its noun
            elif kind == "run":
                found.append("t:" + s[:6])
                if len(s) > 6:
                    found.append("t:" + s[6:11])
            else:
                found.append(_class(kind, s))
            j += 1
        return (found + ["", ""])[0], (found + ["", ""])[1]

    def left(i: int) -> tuple[str, str]:
        """The last two words up to token i."""
        found = []
        while i >= 0 and len(found) < 2:
            if kinds[i] in WORDS:
                found.append(_left(kinds[i], toks[i][3]))
            i -= 1
        return (found + ["", ""])[1], (found + ["", ""])[0]

    def started(i: int) -> bool:
        """Whether a unit may start at token i, as far as punctuation tells."""
        i -= 1
        while i >= 0:
            if kinds[i] == "end" or (toks[i][3] == ";" and i and kinds[i - 1] == "word" and _GREEK.match(toks[i - 1][3][-1])):
                return True
            if kinds[i] in WORDS or toks[i][3] in ":：":
                return False
            i -= 1
        return True

    def case_of(j: int) -> str:
        kind, _, _, s = toks[j]
        if kind == "num":
            return "D"
        if kind == "word":
            c = s[0]
            return ("U" if c.isupper() else "L" if c.islower() else "X") if cased or c.upper() == c.lower() else "M"
        return "Q" if s in _OPEN else "X" if kind in ("run", "char") else "P"

    def add(end: int, i: int, j: int, punct: str) -> None:
        """A gap behind token i and before token j."""
        nonlocal since
        case = case_of(j)
        w2, w = left(i)
        words = 0
        while i >= since and words < 2:
            words += kinds[i] in WORDS
            i -= 1
        out.append(Gap(end, toks[j][1], (w2, w, punct, case, *right(j)), first_guess(w2, w, punct, case), words))
        since = j

    upto = 0
    for i in look:
        if i < upto:
            continue
        kind, s0, e0, s = toks[i]
        upto = i + 1
        if kind in WORDS:
            if upto < n:
                k2, s2 = kinds[upto], toks[upto][1]
                if s2 in starts and k2 != "end":
                    add(e0, i, upto, "⏎")
                elif s2 > e0 and k2 == "run" and kind in ("run", "num", "char"):
                    add(e0, i, upto, "␣")
                elif everywhere and k2 in WORDS and (s2 > e0 or kind == "char"):
                    add(e0, i, upto, "·␣" if s2 > e0 and kind == "char" else "·")
            continue
        if s in _OPEN or s in _CLOSING:
            if opened and s in opened[-1][0] or (s in _CLOSING and any(s in o[0] for o in opened)):
                while opened and s not in opened[-1][0]:
                    opened.pop()
                opened.pop()
            elif s in _OPEN:
                fresh = started(i)
                before = text[first:s0].rstrip()[-1:] if not fresh else ""
                opened.append((_OPEN[s], "0" if fresh else "1" if before in ":：" else "2"))
            if upto < n and toks[upto][1] in starts and s not in _OPEN:
                add(e0, i, upto, "⏎")
            continue
        greek = s == ";" and i and kinds[i - 1] == "word" and _GREEK.match(toks[i - 1][3][-1])
        if kind == "end" or greek:
            mark = "?" if greek else _terminal(s)
            end, j = e0, i + 1
            closed = ""
            while j < n:
                k2, s2, e2, t2 = toks[j]
                gap = text[end:s2]
                if t2 in _CLOSING and any(t2 in o[0] for o in opened) and (gap == "" or (t2 in "»«›" and not regex.search(r"[\n\r]", gap))):
                    while opened and t2 not in opened[-1][0]:
                        opened.pop()
                    closed += opened.pop()[1] if t2 not in ")]）" else ")"
                    end, j = e2, j + 1
                elif gap == "" and k2 == "end" and closed:
                    mark, end, j = _terminal(t2), e2, j + 1
                else:
                    break
            if j < n:
                k2, s2, _, t2 = toks[j]
                spaced = s2 > end
                # signs that go on with the sentence; behind anything else the model decides
                if t2 not in ",;:：，、；)]）" and not (k2 == "other" and t2 in _CLOSING and t2 not in _OPEN):
                    if spaced or mark in "。！？":
                        tight = ""
                    else:
                        tight = "∅" if _apart(toks, i, j, mark, closed, cased) else "∅∅"
                    if tight != "∅∅" or k2 in WORDS:
                        add(end, j - 1 if closed else i - 1, j, mark + ("”" + closed if closed else "") + tight)
            upto = j
            continue
        # other punctuation
        if upto < n and toks[upto][1] in starts and kinds[upto] != "end":
            add(e0, i, upto, s + "⏎" if s in ":：,;" else "⏎")
    return out, _start(toks), _end(toks)


def _apart(toks: list[tuple], i: int, j: int, mark: str, closed: str, cased: bool) -> bool:
    """Whether what stands right behind a mark looks like a sentence of its own and not like a part of a name or number."""
    k2, _, _, t2 = toks[j]
    if mark == ".":
        left = toks[i - 1] if i else None
        word = left is not None and left[0] == "word"
        lone = word and len(left[3]) == 1 and left[3].isupper()
        if closed and k2 == "word" and t2[0].isupper():
            return True
        if k2 != "word" or left is None or left[0] not in ("word", "num", "other") or not (t2[0].isupper() or not cased):
            return False
        if len(t2) == 1 and len(left[3]) <= 2 or left[0] == "num" and not t2[0].isupper():
            return False
        return not word or len(left[3]) > 2 or (cased and not lone and t2[1:2].islower())
    if mark in "!?…" and not closed:
        return k2 in WORDS or t2 in _OPEN
    return k2 in ("word", "char", "num") and (k2 != "word" or t2[0].isupper())


def _start(toks: list[tuple]) -> tuple[str, str]:
    """The first two words."""
    found: list[str] = []
    some = [t for t in toks[:12] if t[3] not in _OPEN]  # what stands before the third word, quotes left out
    if len(some) > 2 and some[0][0] == "num" and some[1][3] == "." and some[2][0] == "word":
        return _class("num", some[0][3]), "." + _class("word", some[2][3])
    for kind, _, _, s in some[:3]:
        found += ["t:" + s[:6]] + (["t:" + s[6:11]] if len(s) > 6 else []) if kind == "run" else [_class(kind, s)]
    return (found + ["", ""])[0], (found + ["", ""])[1]


def _end(toks: list[tuple]) -> tuple[str, str, str]:
    """The last two words and the mark behind them; no mark where none is certain."""
    if toks and toks[-1][0] == "end":
        ws = [_left(k, s) for k, _, _, s in toks[-4:-1] if k in WORDS]
        return ws[-2] if len(ws) > 1 else "", ws[-1] if ws else "", _terminal(toks[-1][3])
    if toks and toks[-1][0] == "run":
        return "t:" + toks[-2][3][-6:] if len(toks) > 1 and toks[-2][0] == "run" else "", "t:" + toks[-1][3][-6:], "␣"
    return "", "", ""


def gaps(text: str, lines: list[tuple[int, int]]) -> list[Gap]:
    """The gaps of a paragraph that may hide a boundary, in order."""
    return scan(text, lines)[0]


def first_guess(w2: str, w: str, punct: str, case: str) -> float:
    """Probability of a boundary before anything is known of the corpus."""
    mark = punct[0]
    if punct in (",⏎", ";⏎"):
        return 0.02
    if "⏎" in punct:
        return {"U": 0.4, "L": 0.02, "M": 0.15, "D": 0.2}.get(case, 0.3)
    if mark == "·":
        return 0.3 if punct == "·␣" else 0.08 if case == "U" and w == w.lower() and w[:1] != "<" else 0.005
    if punct.endswith("∅∅"):
        return 0.01
    if mark == "␣":
        return 0.2 if w.startswith("<n") else 0.6
    low = case == "L"
    if "”" in punct:
        place = punct.split("”")[1][:1]
        if place == ")":
            return 0.05 if low else 0.9
        if mark in "!?！？…" and place == "0":
            return 0.02 if low else 0.3
        return 0.03 if low else {"1": 0.95, "0": 0.8, "2": 0.7}.get(place, 0.8)
    if mark in "!?！？。।":
        return 0.05 if low else 0.97
    if mark == "…":
        return 0.02 if low else {"U": 0.8, "M": 0.3, "X": 0.2}.get(case, 0.5)
    if w in BEFORE:
        return 0.02
    if w == "<I>":
        return 0.05
    if w.startswith("<n"):
        return 0.02 if low else {"U": 0.6, "M": 0.4, "D": 0.2}.get(case, 0.5)
    if len(w) == 1:
        return 0.03 if low else 0.6 if w2.startswith("<n") else 0.2
    if low:
        return 0.03
    if case == "M":
        return 0.8 if len(w) > 3 else 0.5
    return 0.93 if len(w) > 3 else 0.75


@dataclass
class Model:
    """Counts of the hidden-event model; `event` by left context, `after` by event and right context."""

    vocabulary: frozenset[str] = frozenset()
    event: dict[tuple, list[float]] = field(default_factory=dict)  # context: [no boundary, boundary]
    after: dict[tuple, float] = field(default_factory=dict)
    unigram: dict[str, float] = field(default_factory=dict)
    total: float = 1.0
    back: float = 4.0
    _memo: dict = field(default_factory=dict, repr=False)

    def known(self, w: str) -> str:
        return w if w in self.vocabulary or w[:1] == "<" or len(w) < 2 else "t:" if w[:2] == "t:" else "<oov>"

    def _one(self, w: str) -> float:
        return (self.unigram.get(w, 0.0) + 0.5) / (self.total + 0.5 * (len(self.unigram) + 1))

    def log_odds(self, key: tuple, guess: float) -> float:
        got = self._memo.get(key)
        if got is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            got = self._memo[key] = self._log_odds(key, guess)
        return got

    def odds_of(self, pattern: str) -> float:
        """Log odds of the gap of a pattern."""
        got = self._memo.get(pattern)
        if got is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            _, key, guess = read_pattern(pattern)
            got = self._memo[pattern] = self._log_odds(key, guess)
        return got

    def _log_odds(self, key: tuple, guess: float) -> float:
        w2, w, punct, case, r1, r2 = key
        w2, w, r1, r2 = map(self.known, (w2, w, r1, r2))
        p = guess
        for context in ((punct, case), (w, punct), (w, punct, case), (w2, w, punct, case)):
            n, b = self.event.get(context, (0.0, 0.0))
            p = (b + self.back * p) / (n + b + self.back)
        p = min(max(p, 1e-6), 1 - 1e-6)

        def chain(contexts, word, base):
            q = base
            for c in contexts:
                q = (self.after.get((*c, word), 0.0) + self.back * q) / (self.after.get(c, 0.0) + self.back)
            return q

        u1, u2 = self._one(r1), self._one(r2)
        place = punct[0] + script(key[4])
        b1 = chain([("B", place)], r1, u1)
        n1 = chain([("N", place)], r1, u1)
        b2 = chain([("B", place, r1)], r2, u2)
        n2 = chain([("N", place, r1)], r2, u2)
        return math.log(p / (1 - p)) + 0.8 * (math.log(b1 / n1) + math.log(b2 / n2))


_SCRIPTS = [("l", regex.compile(r"\p{Latin}")), ("c", regex.compile(r"\p{Cyrillic}")), ("g", regex.compile(r"\p{Greek}")), ("j", regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")), ("k", regex.compile(r"\p{Hangul}")), ("a", regex.compile(r"\p{Arabic}")), ("d", regex.compile(r"\p{Devanagari}"))]


@lru_cache(maxsize=100_000)
def script(word: str) -> str:
    """A letter for the script of a word, `n` for classes and signs."""
    if word[:1] == "<" or not word:
        return "n"
    if word[:2] == "t:":
        return "t"
    return next((k for k, r in _SCRIPTS if r.match(word)), "n")


def observe(model: Model, rows: list[tuple], hard: bool = False) -> dict[tuple, float]:
    """Expected counts of (table, context...) from rows (w2, w, punct, case, r1, r2, guess, kind, n)."""
    out: Counter = Counter()
    for w2, w, punct, case, r1, r2, guess, kind, n in rows:
        a, b, x, y = map(model.known, (w2, w, r1, r2))
        if kind == "start":
            post, left = 1.0, False
        elif kind == "end":
            post, left = 1.0, True
        else:
            left = True
            odds = model.log_odds((w2, w, punct, case, r1, r2), guess) if model.event else math.log(guess / (1 - guess))
            post = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if left and kind != "end":
            for c in ((punct, case), (b, punct), (b, punct, case), (a, b, punct, case)):
                out[("E", *c, "1")] += n * post
                out[("E", *c, "0")] += n * (1 - post)
        if kind == "end":
            for c in ((b, punct), (b, punct, "U"), (a, b, punct, "U"), (b, punct, "M"), (a, b, punct, "M"), (b, punct, "X"), (a, b, punct, "X")):
                out[("E", *c, "1")] += n * 0.3
        if kind != "end":
            out[("U", x)] += n
            out[("U", y)] += n
            # starts of paragraphs stand behind every mark that can end one
            marks = [punct[0]] if kind == "gap" else [".", "!", "?", "…", "。", "।", "␣", "⏎", "·"]
            for mark in marks:
                m = mark + script(r1)
                for e, q in (("B", post), ("N", 1 - post)) if kind == "gap" else (("B", 1.0),):
                    out[("A", e, m, x)] += n * q
                    out[("T", e, m)] += n * q
                    out[("A", e, m, x, y)] += n * q
                    out[("T", e, m, x)] += n * q
    return out


def build(vocabulary: frozenset[str], counts: list[tuple[tuple, float]]) -> Model:
    m = Model(vocabulary)
    for key, n in counts:
        table, rest = key[0], tuple(key[1:])
        if table == "E":
            m.event.setdefault(rest[:-1], [0.0, 0.0])[int(rest[-1])] += n
        elif table in ("A", "T"):
            m.after[rest] = m.after.get(rest, 0.0) + n
        else:
            m.unigram[rest[0]] = m.unigram.get(rest[0], 0.0) + n
    m.total = sum(m.unigram.values()) or 1.0
    return m


#: Penalty (log odds) of a unit of one word between two boundaries.
SHORT = -1.5


def decide(odds: list[float], words: list[int]) -> list[bool]:
    """Whether each gap of a paragraph is a boundary: posterior above one half by forward-backward.

    odds: log odds of each gap by its contexts; words: how many words stand between it and the gap before (2: or more).
    """
    odds = [max(-30.0, min(30.0, o)) for o in odds]
    if not any(w <= 1 for w in words[1:]):  # then no gap depends on another
        return [o > 0 for o in odds]
    k = len(odds)
    pair = [0.0] + [math.exp(SHORT) if w <= 1 else 1.0 for w in words[1:]]
    f = [(1.0, math.exp(odds[0]))]
    for i in range(1, k):
        a, b = f[-1]
        x, y = a + b, (a + b * pair[i]) * math.exp(odds[i])
        f.append((x / (x + y), y / (x + y)))
    back = (1.0, 1.0)
    out = [False] * k
    for i in range(k - 1, -1, -1):
        n, b = f[i][0] * back[0], f[i][1] * back[1]
        out[i] = b > n
        if i:
            e = math.exp(odds[i])
            x, y = back[0] + e * back[1], back[0] + pair[i] * e * back[1]
            back = (x / (x + y), y / (x + y))
    return out


#: A document as its layout and gaps: spans of units by layout, and of paragraphs with their number of gaps, both flat; the
#: gaps' ends, starts, words and patterns; patterns of the certain starts and ends of paragraphs.
SCANNED = "key bigint, lines array<int>, paragraphs array<int>, gap_end array<int>, gap_start array<int>, gap_words array<int>, patterns array<string>, certain array<string>"


def scanned(key, text: str) -> tuple:
    """The row of SCANNED of a text."""
    lines: list[int] = []
    paragraphs: list[int] = []
    found: list[Gap] = []
    certain: list[str] = []
    for kind, spans in layout(text):
        if kind == "line":
            lines += spans[0]
            continue
        new, start, end = scan(text, spans)
        paragraphs += (spans[0][0], spans[-1][1], len(new))
        found += new
        certain.append("\t".join(("start", "", "", "", "", *start)))
        if end[2]:
            certain.append("\t".join(("end", *end, "", "", "")))
    return key, lines, paragraphs, [g.end for g in found], [g.start for g in found], [g.words for g in found], ["\t".join(("gap", *g.key)) for g in found], certain


def units_of(row: tuple, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a scanned document, in order."""
    _, lines, paragraphs, ends, starts, words, keys, _ = row
    out = [(int(lines[i]), int(lines[i + 1])) for i in range(0, len(lines), 2)]
    at = 0
    for i in range(0, len(paragraphs), 3):
        start, end, n = paragraphs[i : i + 3]
        if n:
            for g, yes in enumerate(decide([model.odds_of(k) for k in keys[at : at + n]], list(words[at : at + n])), at):
                if yes:
                    out.append((int(start), int(ends[g])))
                    start = starts[g]
        out.append((int(start), int(end)))
        at += n
    return sorted(out)


def units(model: Model, text: str | None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text."""
    return [] if text is None else units_of(scanned(None, text), model)


def scan_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of non-null text as SCANNED rows: texts are laid out and tokenised once, for training and decision."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SCANNED.split(", ")]
        for b in batches:
            rows, held = [], 0
            for k, t in zip(b["key"], b["text"]):
                rows.append(scanned(k, t))
                held += len(rows[-1][3])
                if held > 20_000:
                    yield pd.DataFrame(rows, columns=cols).astype({"key": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=cols).astype({"key": "Int64"})

    return checkpointed(docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, SCANNED))


def patterns(scan: DataFrame) -> DataFrame:
    """(pattern, n): distinct patterns of gaps, starts and ends with their number over the corpus, counted in the JVM."""
    return scan.select(F.explode(F.concat("patterns", "certain")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


def read_pattern(pattern: str) -> tuple[str, tuple[str, ...], float]:
    """(kind, key, first guess) of a pattern."""
    kind, *key = pattern.split("\t")
    return kind, tuple(key), first_guess(*key[:4]) if kind == "gap" else 1.0


def train(scan: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of scanned documents, by `rounds` of expectation maximisation over the distinct patterns."""
    table = checkpointed(patterns(scan))
    total = table.agg(F.sum("n")).collect()[0][0] or 0
    parts = F.split("pattern", "\t")
    words = table.select(F.explode(F.array(*[F.get(parts, F.lit(i)) for i in (1, 2, 5, 6)])).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    vocabulary = frozenset(r["word"] for r in words.where(F.col("n") >= max(LEAST, total * WORD_SHARE)).select("word").collect())  # at most 4 / WORD_SHARE words
    model = Model(vocabulary)
    for _ in range(rounds):
        model = _round(table, model, total)
    return model


def _round(table: DataFrame, model: Model, total: int) -> Model:
    sent = table.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: Counter = Counter()
        for b in batches:
            rows = []
            for pattern, n in zip(b["pattern"], b["n"]):
                kind, key, guess = read_pattern(pattern)
                rows.append((*key, guess, kind, n))
            out.update(observe(sent.value, rows))
        yield pd.DataFrame([("\t".join(k), v) for k, v in out.items()], columns=["key", "n"])

    sums = table.mapInPandas(run, "key string, n double").groupBy("key").agg(F.sum("n").alias("n"))
    kept = sums.where(F.col("n") >= max(0.3, total * RARE)).collect()  # a gap adds to 18 sums: at most 18 / RARE of them, in practice far fewer
    return build(model.vocabulary, [(tuple(r["key"].split("\t")), r["n"]) for r in kept])


def split_documents(scan: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, sent_start, sent_end) of every unit of every scanned document."""
    sent = scan.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, starts, ends = [], [], []
            for row in b.itertuples(index=False, name=None):
                found = units_of(row, sent.value)
                keys += [row[0]] * len(found)
                starts += [a for a, _ in found]
                ends += [e for _, e in found]
                if len(keys) > 50_000:
                    yield pd.DataFrame({"key": pd.array(keys, "Int64"), "sent_start": starts, "sent_end": ends})
                    keys, starts, ends = [], [], []
            yield pd.DataFrame({"key": pd.array(keys, "Int64"), "sent_start": pd.array(starts, "int32"), "sent_end": pd.array(ends, "int32")})

    return scan.mapInPandas(run, "key bigint, sent_start int, sent_end int").withColumnRenamed("key", key)
