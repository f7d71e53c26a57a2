"""Titles as column expressions, all inside the JVM: cleaning, transliteration, comparison keys, bigram similarity.

Null gives null throughout. Titles are cut at `CAP` characters before the patterns run, as their cost grows with
the square of the length.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 300
#: White space as browsers understand it, for engines that differ about it.
WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EDGE = WS[:-1] + r":;,.\-–—]"
#: Markers that venues add to titles, in the order in which they are taken away.
NOISE = [
    "produ[zž]ena verzija", "specijalna projekcija", "s?inhronizovano na srpski", "sinhronizovan[oai]?", "titlovan[oai]?", "sa titlovima", "nasinhronizovano", "screen ?x", "gold ?class", "4dx", "imax",
    "dolby ?(?:atmos|cinema)", "real ?d", "3d", "2d", "hfr", "vip", "ov", "omu", "ds", "kids", "matine", "pretpremijera", "premijera", "marat[oa]n",
]
BRACKETS = r"\((?:[^)]*(?:3d|2d|imax|4dx|sinhron|titlov|ov|omu)[^)]*)\)"
#: Words that say a screening is dubbed (anywhere) or subtitled (as a word).
DUBBED = ["sinhronizovano", "sinhronizovan", "sinhronizovana", "sinhronizovani", "sinkronizirano", "sinhro", "sinh", "sync", "sink", "nasinhronizovano", "srpska sinhronizacija", "na srpskom"]
SUBTITLED = ["titlovano", "titlovan", "titlovana", "sa titlovima", "titl", "subtitle", "ov", "omu"]
#: Serbian Cyrillic in Latin letters, with and without marks.
CYRILLIC = "абвгдђежзијклљмнњопрстћуфхцчџш"
LATIN = ["a", "b", "v", "g", "d", "đ", "e", "ž", "z", "i", "j", "k", "l", "lj", "m", "n", "nj", "o", "p", "r", "s", "t", "ć", "u", "f", "h", "c", "č", "dž", "š"]


def word(pattern: str) -> str:
    """`pattern` between ASCII word boundaries, whatever the letters around it."""
    return rf"(?iu)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", " ")


def without_noise(c: Column) -> Column:
    c = F.regexp_replace(c, f"(?iu){BRACKETS}", " ")
    return reduce(lambda x, p: F.regexp_replace(x, word(p), " "), NOISE, c)


def clean_title(raw: Column) -> Column:
    """The words a person would call the film: marks of format and version, underscores and hyphens away."""
    c = trimmed(F.regexp_replace(squeezed(F.substring(raw, 1, CAP)), "_+", " "))
    c = without_noise(F.replace(c, F.lit("-"), F.lit(" ")))
    c = F.regexp_replace(c, f"{WS}{{2,}}", " ")
    return trimmed(F.regexp_replace(c, f"^{EDGE}+|{EDGE}+$", ""))


def tidy_title(raw: Column) -> Column:
    """As `clean_title` for titles that are shown: hyphens and underscores stay, no space before `: , ;`."""
    c = without_noise(trimmed(squeezed(F.substring(raw, 1, CAP))))
    c = F.regexp_replace(F.regexp_replace(c, f"{WS}{{2,}}", " "), f"{WS}+([:,;])", "$1")
    return trimmed(F.regexp_replace(c, f"^{EDGE}+|{EDGE}+$", ""))


@cache
def accents() -> tuple[str, str]:
    """Letters of the Latin, Greek and Cyrillic blocks whose decomposition is a letter and marks of U+0300-036F, and these letters."""
    pairs = []
    for cp in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(cp))
        base = "".join(c for c in d if not 0x300 <= ord(c) <= 0x36F)
        if len(d) > 1 and len(base) == 1:
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def unaccented(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *accents()), r"[\x{0300}-\x{036F}]", "")


def transliterate(c: Column) -> Column:
    """ASCII-like Latin for comparison: Cyrillic to Latin, no marks, đ as dj; capitals keep a first capital."""
    plain = [s.replace("đ", "dj").replace("dž", "dz").translate(str.maketrans("čćžš", "cczs")) for s in LATIN]
    one = [(a, b) for a, b in zip(CYRILLIC, plain) if len(b) == 1] + list(zip("čćžš", "cczs"))
    src, dst = "".join(a for a, _ in one), "".join(b for _, b in one)
    c = F.translate(c, src + src.upper(), dst + dst.upper())
    for a, b in [*((a, b) for a, b in zip(CYRILLIC, plain) if len(b) > 1), ("đ", "dj")]:
        c = F.replace(F.replace(c, F.lit(a), F.lit(b)), F.lit(a.upper()), F.lit(b.capitalize()))
    return unaccented(c)


def serbian_latin(c: Column) -> Column:
    """Serbian Latin with its marks; a capital two-letter sign is all capitals before another capital."""
    one = [(a, b) for a, b in zip(CYRILLIC, LATIN) if len(b) == 1]
    src, dst = "".join(a for a, _ in one), "".join(b for _, b in one)
    for a, b in zip(CYRILLIC, LATIN):
        if len(b) > 1:
            up = a.upper()
            c = F.regexp_replace(c, f"{up}(?=[\\p{{Lu}}\\p{{Lt}}])", b.upper())
            c = F.replace(F.replace(c, F.lit(up), F.lit(b.capitalize())), F.lit(a), F.lit(b))
    return F.translate(c, src + src.upper(), dst + dst.upper())


def normalize_title(raw: Column) -> Column:
    """The key for fuzzy comparison: clean, transliterated, lower case, letters and digits, no articles."""
    c = F.lower(transliterate(clean_title(raw)))
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" i ")), "[^a-z0-9]+", " ")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9_])(?:the|a|an)(?![A-Za-z0-9_])", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def bigrams(key: Column) -> Column:
    """The pairs of neighbouring characters of a key without spaces, the n-th same pair with the number n."""
    c = F.replace(key, F.lit(" "), F.lit(""))
    n = F.length(c)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda x: x == g)).cast("string")))


def dice(a: Column, b: Column, ga: Column, gb: Column) -> Column:
    """Sørensen-Dice of two keys with their numbered bigrams `ga` and `gb`."""
    flat = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    total = F.size(ga) + F.size(gb)
    return F.when((a == "") | (b == ""), 0.0).when(flat(a) == flat(b), 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(ga, gb)) / total)


def extract_year(c: Column, latest: int) -> Column:
    """The first year 1900-2099 standing alone, if it is at most `latest`."""
    y = F.regexp_extract(c, r"(?<![A-Za-z0-9_])(19[0-9]{2}|20[0-9]{2})(?![A-Za-z0-9_])", 1)
    year = F.when(y != "", y).try_cast("int")
    return F.when(year <= latest, year)
