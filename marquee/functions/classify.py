"""Formats, audio and suitability of listings as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import DUBBED, SUBTITLED, transliterate, word

#: Countries by nearness and what their labels mean as a least age (-1: says nothing).
COUNTRIES = ["RS", "HR", "SI", "DE", "AT", "GB", "US"]
LABELS = {
    "HR": {"N7": 7, "N12": 12, "N15": 15, "N18": 18},
    "SI": {"VS": 0, "12": 12, "15": 15, "18": 18},
    "DE": {"0": 0, "6": 6, "12": 12, "16": 16, "18": 18},
    "AT": {"0": 0, "6": 6, "10": 10, "12": 12, "14": 14, "16": 16},
    "GB": {"U": 0, "PG": 8, "12": 12, "12A": 12, "15": 15, "18": 18, "R18": 18},
    "US": {"G": 0, "PG": 8, "PG-13": 13, "R": 17, "NC-17": 17, "NR": -1},
}
#: Words of genres for children and for adults. Results depend on exactly these.
KID_GENRES = ["animation", "family", "animirani", "animacija", "porodični", "porodicni", "dečji", "decji", "crtani"]
ADULT_GENRES = ["horror", "horor", "thriller", "triler", "erotski"]
KID_AGE = 12


def haystack(*labels: Column) -> Column:
    return F.lower(transliterate(F.concat_ws(" ", *[F.when(x != "", x) for x in labels])))


def audio_in(h: Column) -> Column:
    """dubbed if a marker is anywhere in a haystack, else subtitled if one is a word, else unknown."""
    return F.when(h.rlike("|".join(DUBBED)), "dubbed").when(h.rlike(word("|".join(SUBTITLED))), "subtitled").otherwise("unknown")


def detect_audio(*labels: Column) -> Column:
    return audio_in(haystack(*labels))


def detect_format(*labels: Column) -> Column:
    return format_in(haystack(*labels))


def format_in(h: Column) -> Column:
    rules = [(word("4dx"), "4DX"), (word("imax"), "IMAX"), ("screen ?x", "ScreenX"), ("gold ?class", "Gold"), (word("vip"), "VIP"), (word("3d"), "3D")]
    return F.coalesce(*[F.when(h.rlike(p), v) for p, v in rules], F.lit("2D"))


def code_parts(code: Column) -> Column:
    return F.filter(F.split(F.upper(code), "[^A-Z0-9]+"), lambda x: x != "")


def audio_of_code(code: Column) -> Column:
    parts = code_parts(code)
    among = lambda *x: F.arrays_overlap(parts, F.array(*map(F.lit, x)))
    return F.when(among("SINH", "SINK"), "dubbed").when(among("TITL", "OV", "OMU"), "subtitled").otherwise("unknown")


def format_of_code(code: Column) -> Column:
    parts = code_parts(code)
    premium = F.coalesce(*[F.when(F.array_contains(parts, k), v) for k, v in (("4DX", "4DX"), ("SCREENX", "ScreenX"), ("IMAX", "IMAX"), ("GOLD", "Gold"))])
    dimension = F.when(F.array_contains(parts, "3D"), "3D")
    both = F.concat_ws(" ", premium, dimension)
    return F.when(both != "", both).otherwise("2D")


def age_of_label(country: str, label: Column) -> Column:
    """Least age that a country's label means, null if it says nothing."""
    clean = F.upper(F.trim(label))
    listed = [F.when(clean == k, F.lit(v)) for k, v in LABELS.get(country, {}).items()]
    known = F.coalesce(*listed, F.lit(None).cast("int")) if listed else F.lit(None).cast("int")
    number = F.when(clean.rlike(r"^[0-9]{1,2}\s*\+?$"), F.regexp_extract(clean, "^([0-9]{1,2})", 1).try_cast("int"))
    return F.when(known < 0, F.lit(None).cast("int")).otherwise(F.coalesce(known, F.when(clean.isin("AL", "A", "T", "U", "VS", "BEZ"), 0), number))


def has_genre(genres: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(genres, lambda g: reduce(lambda a, b: a | b, [F.contains(F.lower(g), F.lit(w)) for w in words])), F.lit(False))


def age_rating(adult: Column, certifications: Column, genres: Column, dubbed: Column) -> tuple[Column, Column, Column]:
    """(least age, source, confident): the adult mark, else the nearest country's label, else a guess by genre."""
    certified = [(c, age_of_label(c, F.try_element_at(certifications, F.lit(c)))) for c in COUNTRIES]
    kid, grown = has_genre(genres, KID_GENRES), has_genre(genres, ADULT_GENRES)
    guess = F.when(kid & ~grown, F.when(dubbed, 0).otherwise(6)).when(grown, 16)
    is_adult = F.coalesce(adult, F.lit(False))
    age = F.when(is_adult, 18).otherwise(F.coalesce(*[a for _, a in certified], guess))
    source = F.when(is_adult, "US").otherwise(F.coalesce(*[F.when(a.isNotNull(), c) for c, a in certified], F.when(guess.isNotNull(), "heuristic")))
    confident = F.when(is_adult, True).otherwise(F.when(F.coalesce(*[a for _, a in certified]).isNotNull(), True).when(guess.isNotNull(), False))
    return age, source, confident


def age_label(age: Column) -> Column:
    return F.when(age <= 0, "Bez ograničenja").otherwise(F.concat(age.cast("string"), F.lit("+")))


def kid_friendly(age: Column) -> Column:
    return F.coalesce(age <= KID_AGE, F.lit(False))


def age_badge(age: Column) -> Column:
    return F.when(age.isNull(), "unknown").when(age <= KID_AGE, "kid").when(age >= 16, "adult").otherwise("teen")


def runtime_bucket(minutes: Column) -> Column:
    return F.when(minutes < 90, "short").when(minutes < 120, "medium").when(minutes.isNotNull(), "long")


def format_runtime(minutes: Column) -> Column:
    hours = F.floor(minutes / 60).cast("int")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h "), (minutes % 60).cast("string"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    ten, hundred = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)


def audio_label(audio: Column) -> Column:
    return F.when(audio == "dubbed", "sinhronizovano").when(audio == "subtitled", "titlovano").when(audio == "original", "domaći film").otherwise("nije naznačeno")
