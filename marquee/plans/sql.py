"""Building blocks of the SQL that states what the queries mean, for an engine without our functions."""

from __future__ import annotations

from marquee.functions.text import BRACKETS, CAP, CYRILLIC, DUBBED, EDGE, LATIN, NOISE, SUBTITLED, WS, accents


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


WSQ = WS.replace(r"\x0B", r"\x{0B}")
EDGEQ = EDGE.replace(r"\x0B", r"\x{0B}")


def trimmed(x: str) -> str:
    return sub(x, f"^{WSQ}+|{WSQ}+$", "")


def squeezed(x: str) -> str:
    return sub(x, f"{WSQ}+", " ")


def without_noise(x: str) -> str:
    x = sub(x, BRACKETS, " ", "gi")
    for p in NOISE:
        x = sub(x, rf"\b(?:{p})\b", " ", "gi")
    return x


def clean_title(x: str) -> str:
    x = trimmed(sub(squeezed(f"substring({x}, 1, {CAP})"), "_+", " "))
    x = without_noise(f"replace({x}, '-', ' ')")
    return trimmed(sub(sub(x, f"{WSQ}{{2,}}", " "), f"^{EDGEQ}+|{EDGEQ}+$", ""))


def tidy_title(x: str) -> str:
    x = without_noise(trimmed(squeezed(f"substring({x}, 1, {CAP})")))
    x = sub(sub(x, f"{WSQ}{{2,}}", " "), f"{WSQ}+([:,;])", r"\1")
    return trimmed(sub(x, f"^{EDGEQ}+|{EDGEQ}+$", ""))


def _letters(plain: bool) -> tuple[str, str, list[tuple[str, str]]]:
    latin = [s.replace("đ", "dj").replace("dž", "dz").translate(str.maketrans("čćžš", "cczs")) for s in LATIN] if plain else LATIN
    pairs = list(zip(CYRILLIC, latin)) + ([("đ", "dj"), *zip("čćžš", "cczs")] if plain else [])
    one = [(a, b) for a, b in pairs if len(b) == 1]
    src, dst = "".join(a for a, _ in one), "".join(b for _, b in one)
    return src + src.upper(), dst + dst.upper(), [(a, b) for a, b in pairs if len(b) > 1]


def transliterate(x: str) -> str:
    src, dst, many = _letters(True)
    x = f"translate({x}, {lit(src)}, {lit(dst)})"
    for a, b in many:
        x = f"replace(replace({x}, {lit(a)}, {lit(b)}), {lit(a.upper())}, {lit(b.capitalize())})"
    return sub(f"translate({x}, {lit(accents()[0])}, {lit(accents()[1])})", r"[\x{0300}-\x{036F}]", "")


def serbian_latin(x: str) -> str:
    src, dst, many = _letters(False)
    for a, b in many:
        for _ in range(2):
            x = sub(x, f"{a.upper()}([\\p{{Lu}}\\p{{Lt}}])", b.upper() + r"\1")
        x = f"replace(replace({x}, {lit(a.upper())}, {lit(b.capitalize())}), {lit(a)}, {lit(b)})"
    return f"translate({x}, {lit(src)}, {lit(dst)})"


def normalize_title(x: str) -> str:
    x = f"lower({transliterate(clean_title(x))})"
    x = sub(f"replace({x}, '&', ' i ')", "[^a-z0-9]+", " ")
    return f"trim({sub(sub(x, r'\b(?:the|a|an)\b', ' '), ' +', ' ')})"


def haystack(*xs: str) -> str:
    return f"lower({transliterate('concat_ws(' + lit(' ') + ', ' + ', '.join(f'nullif({x}, {lit('')})' for x in xs) + ')')})"


def detect_audio(*xs: str) -> str:
    h = haystack(*xs)
    return f"CASE WHEN regexp_matches({h}, {lit('|'.join(DUBBED))}) THEN 'dubbed' WHEN regexp_matches({h}, {lit(rf'\b(?:{'|'.join(SUBTITLED)})\b')}) THEN 'subtitled' ELSE 'unknown' END"


def detect_format(*xs: str) -> str:
    h = haystack(*xs)
    rules = [(r"\b4dx\b", "4DX"), (r"\bimax\b", "IMAX"), ("screen ?x", "ScreenX"), ("gold ?class", "Gold"), (r"\bvip\b", "VIP"), (r"\b3d\b", "3D")]
    return "CASE " + " ".join(f"WHEN regexp_matches({h}, {lit(p)}) THEN '{v}'" for p, v in rules) + " ELSE '2D' END"


def grams(keys: str) -> str:
    """A query of (key, g, r): numbered bigrams of the column `key` of the query `keys`."""
    one = f"SELECT key, unnest(CASE WHEN length(c) >= 2 THEN list_transform(range(1, length(c)), lambda i: substring(c, i, 2)) ELSE [] END) AS g FROM (SELECT key, replace(key, ' ', '') AS c FROM ({keys}))"
    return f"SELECT key, g, row_number() OVER (PARTITION BY key, g) AS r FROM ({one})"


def dice_pairs(left: str, right: str | None, threshold: float) -> str:
    """(a, b, score) of the pairs of keys of two queries (or one, a < b) with Dice >= threshold."""
    r = right or left
    order = "AND x.key < y.key" if right is None else ""
    return f"""
    WITH l AS ({left}), r AS ({r}), gl AS MATERIALIZED ({grams('SELECT key FROM l')}), gr AS MATERIALIZED ({grams('SELECT key FROM r')}),
    shared AS (SELECT x.key AS a, y.key AS b, count(*) AS n FROM gl x JOIN gr y ON x.g = y.g AND x.r = y.r {order} GROUP BY 1, 2),
    flat AS (SELECT x.key AS a, y.key AS b FROM l x JOIN r y ON replace(x.key, ' ', '') = replace(y.key, ' ', '') {order}),
    every AS (SELECT a, b, 2.0 * n / (length(replace(a, ' ', '')) + length(replace(b, ' ', '')) - 2) AS score FROM shared UNION ALL SELECT a, b, 1.0 FROM flat)
    SELECT a, b, max(score) AS score FROM every GROUP BY a, b HAVING max(score) >= {threshold}"""
