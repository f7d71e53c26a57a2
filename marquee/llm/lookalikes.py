"""Text that looks the same but is spelt with other characters, in one form.

1. Ignorable characters (zero width, soft hyphen, marks of direction, variation selectors) are deleted.
2. Compatibility forms (full width, mathematical, ligatures, digraph letters) and decomposed accents become
   ordinary letters (NFKC); spaces other than the ordinary one become it, and so do hyphens.
3. In every word that mixes scripts or has letters that only stand in for others, the look-alike lattice (each
   letter with the Latin and Cyrillic letters it looks like) is searched with Viterbi, one script per path, under
   character trigram scores of that script and a penalty per change. The trigrams are counted over all words of
   the corpus that are wholly in one script; the table is bounded by the cube of the alphabets.

Text whose encoding is broken (UTF-8 read in another encoding, replacement characters) is left as it is, and so
are capitals, missing accents, misspellings, ordinary spaces and words wholly in Latin or Cyrillic. So is a word
wholly in a third script if the text is written in it: if it has letters of that script that look like no others, or
no word in Latin or Cyrillic beside it. Null gives
null; empty text is its own form; texts of any length are read whole; repeated rows come out as often as they
came in; ties go to fewer changes, then to Latin.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATIN, CYRILLIC = 0, 1
_LOWER = ("abcdefghijklmnopqrstuvwxyzčćžšđ", "абвгдђежзијклљмнњопрстћуфхцчџш")
USUAL = tuple(frozenset(a + a.upper()) for a in _LOWER)
#: Letters that look alike, each group in the order Latin; Cyrillic; letters that only stand in for them.
GROUPS = [
    "A;А;ΑᎪ", "B;В;ΒᏴ", "C;С;ϹᏟ", "E;Е;ΕᎬ", "H;Н;ΗᎻ", "I;;ІΙӀᏆ", "J;Ј;ᎫͿ", "K;К;ΚᏦ", "M;М;ΜᎷ", "N;;Ν", "O;О;ΟՕ", "P;Р;ΡᏢ", "S;;ЅՏᏚ", "T;Т;ΤᎢ", "X;Х;Χ", "Y;;ΥҮ", "Z;;ΖᏃ", "D;;ᎠꓓԀ", "G;;ԌᏀ", "L;;Ꮮ", "V;;ѴᏙ", "W;;ԜᎳ", "Q;;Ԛ", "R;;ᏒƦ", "U;;ՍԱ", "F;;ϜҒ", "Đ;;ÐƉ",
    "a;а;αɑ", "b;;ЬƄ", "c;с;ϲᴄ", "d;;ԁᏧ", "e;е;ҽ", "g;;ɡց", "h;;һհ", "i;;іιıӏɩ", "j;ј;ϳ", "k;;κ", "l;;ӏ", "n;;ոπ", "o;о;οσօᴏ", "p;р;ρ", "q;;ԛգ", "r;;ᴦ", "s;;ѕꜱ", "u;;υսᴜ", "v;;νѵᴠ", "w;;ԝѡᴡ", "x;х;χ", "y;у;γүʏ", "z;;ᴢ", "đ;;ðɖ", "к;к;κk", "т;т;τ", "м;м;ᴍ", "н;н;ʜ", "в;в;ʙ", "У;У;Y", "у;у;y", "З;З;Ʒ",
]


def _tables() -> tuple[dict[str, tuple[str, ...]], dict[str, tuple[str, ...]]]:
    latin: dict[str, list[str]] = {}
    cyrillic: dict[str, list[str]] = {}
    for group in GROUPS:
        la, cy, other = group.split(";")
        for c in la + cy + other:
            for target, table, script in ((la, latin, LATIN), (cy, cyrillic, CYRILLIC)):
                for t in target:
                    if t in USUAL[script] and t not in table.setdefault(c, []):
                        table[c].append(t)
    return {c: tuple(t) for c, t in latin.items()}, {c: tuple(t) for c, t in cyrillic.items()}


TO = _tables()
#: Letters outside the two alphabets that only stand in for letters of them.
STAND_INS = frozenset(c for g in GROUPS for c in g.split(";")[2]) - USUAL[LATIN] - USUAL[CYRILLIC]
HYPHENS = dict.fromkeys(map(ord, "‐‑‒⁃−﹘﹣－"), "-")
ORDINARY = frozenset("…™№")
_INVISIBLE = frozenset("͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ⁥") | frozenset(map(chr, range(0xFE00, 0xFE10))) | frozenset(map(chr, range(0xE0100, 0xE01F0)))
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–—‘-„†-•…‰‹›€™]{1,3}")
_WORD = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or c in _INVISIBLE or (c < " " and c not in "\t\n\r\x0b\x0c") or c == "\x7f"


def broken_spans(text: str) -> list[tuple[int, int]]:
    """Where `text` is UTF-8 that was read as Windows-1252 or Latin-1."""
    out = []
    for m in _MOJIBAKE.finditer(text):
        for end in range(m.end(), m.start() + 1, -1):
            raw = bytearray()
            for c in text[m.start() : end]:
                raw += bytes([ord(c)]) if ord(c) < 256 else c.encode("cp1252", "ignore")
            try:
                raw.decode()
                out.append((m.start(), end))
                break
            except UnicodeDecodeError:
                if end == m.start() + 2 and text[m.start()] in "ÂÃÄÅâãäå" and text[m.start() + 1] <= "\u00bf":
                    out.append((m.start(), end))
    return out


class Model:
    """Trigram scores of the two scripts."""

    def __init__(self, counts: dict[tuple[int, str], int], change: float = 2.0) -> None:
        self.change = change
        self.tri: list[dict[str, int]] = [{}, {}]
        self.bi: list[Counter] = [Counter(), Counter()]
        for (script, gram), n in counts.items():
            self.tri[script][gram] = n
            self.bi[script][gram[:2]] += n

    def score(self, script: int, before: str, c: str) -> float:
        """Log probability of the lower-case letter `c` after the two letters `before`."""
        return math.log((self.tri[script].get(before + c, 0) + 0.1) / (self.bi[script][before] + 0.1 * (len(_LOWER[script]) + 1)))

    @lru_cache(maxsize=200_000)  # noqa: B019
    def word(self, word: str) -> str:
        """The form of a word: unchanged if wholly of one script's usual letters, else the best path of the lattice."""
        stand_in = any(c in STAND_INS for c in word)
        if not stand_in and (all(c not in USUAL[CYRILLIC] for c in word) or all(c in USUAL[CYRILLIC] for c in word) or not any(c.isascii() or c in USUAL[LATIN] for c in word)):
            return word
        found = [p for s in (LATIN, CYRILLIC) if (p := self._viterbi(word, s)) is not None]
        return unicodedata.normalize("NFC", max(found, key=lambda p: p[0])[1]) if found else word

    def _viterbi(self, word: str, script: int) -> tuple[float, str] | None:
        states: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
        for c in word:
            options = [c] if c in USUAL[script] else []
            options += [t for t in TO[script].get(c, ()) if t != c]
            if unicodedata.combining(c):
                states = {b: (v, path + c) for b, (v, path) in states.items()}
                continue
            if not options:
                if script == LATIN and unicodedata.name(c, "").startswith("LATIN") and c not in STAND_INS:
                    options = [c]  # foreign Latin letters
                else:
                    return None
            nxt: dict[str, tuple[float, str]] = {}
            for before, (s, path) in states.items():
                for o in options:
                    low = o.lower() if o.lower() in USUAL[script] else "?"
                    v = s + self.score(script, before, low) - (0 if o == c else self.change)
                    key = before[1] + low
                    if key not in nxt or v > nxt[key][0]:
                        nxt[key] = (v, path + o)
            states = nxt
        return max(((s + self.score(script, b, "$"), p) for b, (s, p) in states.items()), key=lambda x: x[0])

    def text(self, value: str | None) -> str | None:
        """The one form of `value`."""
        if value is None or value.isascii() and value.isprintable():
            return value
        out, at = [], 0
        for start, end in [*broken_spans(value), (len(value), len(value))]:
            out.append(self._plain(value[at:start]))
            out.append(value[start:end])
            at = end
        return "".join(out)

    def _plain(self, s: str) -> str:
        if not s or s.isascii() and s.isprintable():
            return s
        s = "".join(c for c in s if not invisible(c))
        s = "".join(p if p in ORDINARY else unicodedata.normalize("NFKC", p) for p in re.split("([…™№])", s))
        s = "".join(" " if c != " " and unicodedata.category(c) in ("Zs", "Zl", "Zp") else c for c in s).translate(HYPHENS)
        own = _own_scripts(s) if any(c in STAND_INS for c in s) else frozenset()
        return _WORD.sub(lambda m: m[0] if own and _script(m[0]) in own else self.word(m[0]), s)


@lru_cache(maxsize=100_000)
def _script(word: str) -> str | None:
    """The script that a whole word is written in; None for a mix, for Latin and for Cyrillic."""
    names = {unicodedata.name(c, "?").split()[0] for c in word if not unicodedata.combining(c)}
    return next(iter(names)) if len(names) == 1 and not names & {"LATIN", "CYRILLIC", "?"} else None


def _own_scripts(text: str) -> frozenset[str]:
    """Scripts other than Latin and Cyrillic that a text is written in, not only disguised with: no word of two letters or
    more is in Latin or Cyrillic, or a word of that script has letters that look like none of them."""
    words = _WORD.findall(text)
    ordinary = any(len(w) > 1 and any(c in USUAL[LATIN] or c in USUAL[CYRILLIC] for c in w) for w in words)
    found: dict[str, bool] = {}
    for w in words:
        if (script := _script(w)) is not None:
            found[script] = found.get(script, False) or any(c not in STAND_INS and not unicodedata.combining(c) for c in unicodedata.normalize("NFD", w))
    return frozenset(s for s, real in found.items() if real or not ordinary)


MAX_GRAMS = (len(_LOWER[0]) + 2) ** 3 + (len(_LOWER[1]) + 2) ** 3


def grams(values: DataFrame, column: str = "value") -> DataFrame:
    """(script, gram, n): lower-case trigrams of all words wholly in one script; `^` and `$` mark the ends."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for v in b["value"]:
                if v is not None:
                    words.update(w.lower() for w in _WORD.findall(v))
            for w, n in words.items():
                for script in (LATIN, CYRILLIC):
                    if all(c in USUAL[script] for c in w):
                        t = f"^^{w}$"
                        for i in range(len(t) - 2):
                            seen[script, t[i : i + 3]] += n
        yield pd.DataFrame([(s, g, n) for (s, g), n in seen.items()], columns=["script", "gram", "n"])

    return values.select(F.col(column).alias("value")).mapInPandas(count, "script int, gram string, n bigint").groupBy("script", "gram").agg(F.sum("n").alias("n"))


def train(values: DataFrame, column: str = "value") -> Model:
    """The model of a corpus. The table of trigrams is bounded by the alphabets, whatever the corpus."""
    rows = grams(values, column).limit(MAX_GRAMS + 1).collect()
    return Model({(r["script"], r["gram"]): r["n"] for r in rows})


def unify(df: DataFrame, model: Model, column: str = "value", into: str = "form") -> DataFrame:
    """`df` with the column `into`: the one form of `column`. A column of that name in `df` is replaced."""
    broadcast = df.sparkSession.sparkContext.broadcast(({(s, g): n for s in (0, 1) for g, n in model.tri[s].items()}, model.change))

    @F.pandas_udf("string")
    def form(v: pd.Series) -> pd.Series:
        return pd.Series(_model(broadcast).text(x) for x in v)

    return df.withColumn(into, form(F.col(column)))


_models: dict[int, Model] = {}


def _model(broadcast) -> Model:
    """The worker's copy of a broadcast model."""
    key = broadcast._jid if getattr(broadcast, "_jid", None) is not None else id(broadcast)
    if key not in _models:
        _models.clear()
        _models[key] = Model(*broadcast.value)
    return _models[key]


def values_of(listing: DataFrame, title_dim: DataFrame) -> DataFrame:
    """(src, row_id, field, pos, value) of the titles and genres."""
    a = listing.select(F.lit("listing").alias("src"), F.col("listing_id").cast("bigint").alias("row_id"), F.lit("raw_title").alias("field"), F.lit(0).alias("pos"), F.col("raw_title").alias("value"))
    g = listing.select(F.lit("listing").alias("src"), F.col("listing_id").cast("bigint").alias("row_id"), F.lit("genres").alias("field"), F.posexplode("genres").alias("pos", "value"))
    t = title_dim.select(F.lit("title_dim").alias("src"), F.col("id").cast("bigint").alias("row_id"), F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value"))
    return a.unionByName(g).unionByName(t).where("value is not null")


#: Values of printable ASCII and the five Latin letters with marks are their own form.
PLAIN = r"^[\x20-\x7EčćžšđČĆŽŠĐ]*\z"


def disguised(values: DataFrame) -> DataFrame:
    """The values (src, row_id, field, pos, value, form) whose one form differs from them."""
    model = train(values)
    return unify(values.where(~F.col("value").rlike(PLAIN)), model).where("form <> value")
