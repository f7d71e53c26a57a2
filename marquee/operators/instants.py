"""Timestamps written in many formats, precisions and zones, as one instant (microseconds since 1970, UTC).

Parsing: `read_date`, `read_time` and `read_stamp` turn a text into parts, once per distinct text and worker.
Zones: `estimate_zones` finds, for each source, the offset history (a zone of the tz database) that its records
violate least: local days against ingestion times, and offsets printed with the stamps. All fixed offsets are tried
first, then the zones near the best of them; a source without clear evidence keeps the default.
Conversion: `to_instants` is vectorised; a wall time that occurs twice is the first, a skipped one moves on by
the gap.

Null, empty or unreadable texts and dates or times that do not exist give null, never an error; texts
longer than every format denote nothing; repeated rows come out as often as
they came in; columns other than those named are not touched.
"""

from __future__ import annotations

import bisect
import datetime as dt
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import as_micros

HOME = "Europe/Belgrade"
#: Zones that name an offset history where several zones share it; all others of the database are tried too.
CANDIDATES = (HOME, "UTC", "Europe/London", "Europe/Athens", "Europe/Istanbul", "America/New_York", "Asia/Tokyo")
DAY = 86_400
US = 1_000_000
#: No format is as long as this after white space is squeezed, so longer texts denote nothing.
LONGEST = 400
EPOCH = dt.date(1970, 1, 1)
YEARS = (1990, 2090)

_LATIN = str.maketrans({**dict(zip("абвгдђежзијклмнопрстћуфхцчш", "abvgdđežzijklmnoprstćufhcčš")), "љ": "lj", "њ": "nj", "џ": "dž"})
_PLAIN = str.maketrans("čćžšđ", "cczsd")
#: First letters of month names (Serbian, Croatian, English, Hungarian and German), in the order of the year.
MONTHS = (
    ("jan", "sij", "sije"), ("feb", "velj"), ("mar", "ozu", "mär", "márc"), ("apr", "tra", "ápr"), ("maj", "may", "svi", "mai", "máj"), ("jun", "lip", "jún"),
    ("jul", "srp", "júl"), ("avg", "aug", "kol"), ("sep", "ruj", "szept"), ("okt", "oct", "lis"), ("nov", "stu"), ("dec", "pro", "dez"),
)
#: First letters of weekday names, Monday first.
WEEKDAYS = (("pon", "mon"), ("uto", "tue"), ("sre", "sri", "wed"), ("cet", "thu"), ("pet", "fri"), ("sub", "sat"), ("ned", "sun"))
RELATIVE = {"danas": 0, "today": 0, "veceras": 0, "sutra": 1, "tomorrow": 1, "sutradan": 1, "prekosutra": 2}
ABBREVIATED = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "cet": 3600, "mez": 3600, "cest": 7200, "mesz": 7200, "bst": 3600, "eet": 7200, "eest": 10800, "msk": 10800, "est": -18000, "edt": -14400}


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def fold(text: str) -> str:
    return squeeze(text).lower().translate(_LATIN).translate(_PLAIN)


@lru_cache(maxsize=4096)
def month_of(word: str) -> int | None:
    word = word.rstrip(".")
    return next((i + 1 for i, names in enumerate(MONTHS) if any(word.startswith(n) for n in names)), None) if len(word) > 2 else None


def weekday_of(word: str) -> int | None:
    return next((i for i, names in enumerate(WEEKDAYS) if any(word.startswith(n) for n in names)), None) if len(word) > 2 else None


def day_number(y: int, m: int, d: int) -> int | None:
    """Days since 1970-01-01, None if there is no such date or it is far from any programme."""
    if y < 100:
        y += 2000
    if not YEARS[0] <= y <= YEARS[1]:
        return None
    try:
        return (dt.date(y, m, d) - EPOCH).days
    except ValueError:
        return None


@lru_cache(maxsize=256)
def offset_named(text: str) -> int | None:
    """Seconds east of UTC for `+02:00`, `+0200`, `GMT+1`, `Z`, `CEST`; None if it is no fixed offset."""
    t = text.strip().lower()
    if t in ABBREVIATED:
        return ABBREVIATED[t]
    m = re.fullmatch(r"(?:utc|gmt)?\s*([+\-−])(\d{1,2})(?::?(\d{2}))?(?::?00)?", t)
    if not m:
        return None
    h, mi = int(m[2]), int(m[3] or 0)
    return (h * 3600 + mi * 60) * (1 if m[1] == "+" else -1) if h <= 15 and mi < 60 else None


def zone_named(text: str) -> str | None:
    return text if "/" in text and transitions(text) is not None else None


@lru_cache(maxsize=64)
def transitions(zone: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of `zone`: UTC seconds from which an offset holds, the offsets, and wall seconds from which a new offset is read.

    The first start is minus infinity. A wall time is read with the offset before a change up to the end of that
    offset's own wall time: the first of two equal times, and the time moved on by the gap of a skipped one.
    """
    try:
        z = ZoneInfo(zone)
    except Exception:
        return None
    at = lambda s: int((dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())
    lo, hi = ((dt.date(y, 1, 1) - EPOCH).days * DAY for y in (YEARS[0] - 1, YEARS[1] + 2))
    starts, offsets = [-(1 << 60)], [at(lo)]
    s = lo
    while s < hi:
        t = min(s + 7 * DAY, hi)
        if at(t) != offsets[-1]:
            a, b = s, t
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if at(mid) == offsets[-1] else (a, mid)
            starts.append(b)
            offsets.append(at(b))
        s = t
    walls = [starts[0]] + [starts[i] + max(offsets[i - 1], offsets[i]) for i in range(1, len(starts))]
    # between a change's old and new wall time: a gap reads with the old offset, an overlap too
    return np.array(starts), np.array(offsets), np.array(walls)


def wall_to_utc(wall: np.ndarray, zone: str) -> np.ndarray:
    """UTC seconds of wall seconds."""
    _, offsets, walls = transitions(zone)
    return wall - offsets[np.searchsorted(walls, wall, side="right") - 1]


def utc_to_wall(utc: np.ndarray, zone: str) -> np.ndarray:
    starts, offsets, _ = transitions(zone)
    return utc + offsets[np.searchsorted(starts, utc, side="right") - 1]


def change_days(zone: str = HOME) -> list[str]:
    """The local days on which the clocks of `zone` change, as YYYY-MM-DD."""
    starts, offsets, _ = transitions(zone)
    return sorted({(EPOCH + dt.timedelta(days=int((s + o) // DAY))).isoformat() for s, o in zip(starts[1:], offsets[1:])})


# ---- texts to parts -------------------------------------------------------------------------------------------------

#: kinds of date: a day number, an instant (its home day counts), day and month without year, days after the fetch, a weekday
D_DAY, D_INSTANT, D_MONTHDAY, D_AFTER, D_WEEKDAY = range(5)


@lru_cache(maxsize=200_000)
def read_date(text: str) -> tuple[int, int] | None:
    """(kind, value) of a date: D_DAY day number, D_INSTANT UTC seconds, D_MONTHDAY month*100+day, D_AFTER days, D_WEEKDAY index."""
    t = fold(text)
    if not t or len(t) > LONGEST:
        return None
    if m := re.fullmatch(r"(\d{4})\s*([-./])\s*(\d{1,2})\s*\2\s*(\d{1,2})\.?(?:[t ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?\s*(\S+)?)?", t):
        day = day_number(int(m[1]), int(m[3]), int(m[4]))
        if day is None or m[5] is None:
            return None if day is None else (D_DAY, day)
        h, mi, s = int(m[5]), int(m[6]), int(m[7] or 0)
        if h > 23 or mi > 59 or s > 59:
            return None
        if m[8] is None:
            return D_DAY, day
        off = offset_named(m[8])
        return None if off is None else (D_INSTANT, day * DAY + h * 3600 + mi * 60 + s - off)
    if m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})", t):
        day = day_number(int(m[1]), int(m[2]), int(m[3]))
        return None if day is None else (D_DAY, day)
    word = ""
    if m := re.match(r"([^\W\d]{3,})\.?\s*,?\s*", t):
        if m[1] in RELATIVE:
            after = RELATIVE[m[1]]
            rest = t[m.end() :]
            if not rest:
                return D_AFTER, after
            inner = read_date(rest)
            return inner if inner is not None else None
        if weekday_of(m[1]) is not None and month_of(m[1]) is None or (weekday_of(m[1]) is not None and t[m.end() :][:1].isdigit()):
            word, t = m[1], t[m.end() :]
            if not t:
                return D_WEEKDAY, weekday_of(word)
    t = t.removesuffix(" godine").removesuffix(" god.").removesuffix(" g.").strip()
    if m := re.fullmatch(r"(\d{1,2})\s*([./\-])\s*(\d{1,2})\s*(?:\2\s*(\d{4}|\d{2})\s*\.?|\2?)", t):
        d, mo = int(m[1]), int(m[3])
        if m[4]:
            day = day_number(int(m[4]), mo, d)
            return None if day is None else (D_DAY, day)
        return (D_MONTHDAY, mo * 100 + d) if day_number(2024, mo, d) is not None else None
    if m := re.fullmatch(r"(\d{1,2})\s*[.\-]?\s*([^\W\d]{3,})\.?\s*[,\-]?\s*(\d{4}|\d{2})?\s*\.?", t):
        mo = month_of(m[2])
        if mo is None:
            return None
        if m[3]:
            day = day_number(int(m[3]), mo, int(m[1]))
            return None if day is None else (D_DAY, day)
        return (D_MONTHDAY, mo * 100 + int(m[1])) if day_number(2024, mo, int(m[1])) is not None else None
    if m := re.fullmatch(r"([^\W\d]{3,})\.?\s*(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(\d{4})?", t):
        mo = month_of(m[1])
        if mo is None:
            return None
        if m[3]:
            day = day_number(int(m[3]), mo, int(m[2]))
            return None if day is None else (D_DAY, day)
        return (D_MONTHDAY, mo * 100 + int(m[2])) if day_number(2024, mo, int(m[2])) is not None else None
    return None


def clock(h: str, m: str | None, s: str | None = None, half: str | None = None, fraction: str | None = None) -> int | None:
    """Microseconds after midnight, None if there is no such time."""
    hh, mm, ss = int(h), int(m or 0), int(s or 0)
    if half:
        if not 1 <= hh <= 12:
            return None
        hh = hh % 12 + (12 if half[0] == "p" else 0)
    if hh > 23 or mm > 59 or ss > 59:
        return None
    return (hh * 3600 + mm * 60 + ss) * US + int((fraction or "0").ljust(6, "0")[:6])


@lru_cache(maxsize=50_000)
def read_time(text: str) -> tuple[int, int | None, str | None] | None:
    """(microseconds after midnight, fixed offset in seconds or None, zone name or None) of a time of day."""
    t = squeeze(text)
    if not t or len(t) > LONGEST:
        return None
    zone, offset = None, None
    if m := re.search(r"\s*[\[(]?([A-Z][A-Za-z]+/[A-Za-z_/]+)[\])]?$", t):
        zone = zone_named(m[1])
        if zone is None:
            return None
        t = t[: m.start()]
    low = fold(t)
    if m := re.search(r"(?<=[\dm])\s*\(?((?:utc|gmt)?\s*[+−-]\d{1,2}(?::?\d{2})?|z|utc|gmt|cest|cet|mez|mesz|bst|eet|eest|msk)\)?$", low):
        offset = offset_named(m[1])
        if offset is None:
            return None
        low = low[: m.start()]
    low = re.sub(r"^(?:u|od|at|pocetak|oko)\s+", "", low.strip())
    low = re.sub(r"\s*(?:casova|cas|casa|sati|sat|uhr|h\.?|c\.?)$", "", low)
    half = None
    if m := re.search(r"\s*([ap])\.?\s?m\.?$", low):
        half, low = m[1], low[: m.start()]
    if m := re.fullmatch(r"(\d{1,2})\s*[:.h,]\s*(\d{2})(?:\s*[:.]\s*(\d{2})(?:[.,](\d{1,9}))?)?\s*h?", low):
        us = clock(m[1], m[2], m[3], half, m[4])
    elif m := re.fullmatch(r"(\d{2})(\d{2})(\d{2})?", low):
        us = clock(m[1], m[2], m[3], half)
    elif (m := re.fullmatch(r"(\d{1,2})", low)) and (half or low != fold(t)):
        us = clock(m[1], None, None, half)
    else:
        return None
    return None if us is None else (us, offset, zone)


#: kinds of stamp: an instant in UTC microseconds, wall time in microseconds
S_INSTANT, S_WALL = range(2)


def epoch(text: str, fraction: str = "") -> int | None:
    """Microseconds of a number of seconds, milliseconds, microseconds or nanoseconds since 1970, by its digits."""
    n = len(text)
    scale = {10: US, 13: 1000, 16: 1}.get(n)
    if n == 19:
        return int(text) // 1000
    if scale is None or (YEARS[0] - 1970) * 365 * DAY > int(text) * scale // US:
        return None
    return int(text) * scale + (int(fraction.ljust(9, "0")[:9]) * scale // 10**9 if fraction else 0)


@lru_cache(maxsize=200_000)
def read_stamp(text: str) -> tuple[int, int, str | None] | None:
    """(S_INSTANT, UTC microseconds, None) or (S_WALL, wall microseconds, zone named in the text or None)."""
    t = squeeze(text)
    if not t or len(t) > LONGEST:
        return None
    if m := re.fullmatch(r"(\d{10}|\d{13}|\d{16}|\d{19})(?:\.(\d+))?", t):
        us = epoch(m[1], m[2] or "")
        return None if us is None else (S_INSTANT, us, None)
    if m := re.fullmatch(r"\\?/Date\((-?\d+)([+-]\d{4})?\)\\?/", t):
        return S_INSTANT, int(m[1]) * 1000, None
    if m := re.fullmatch(r"(\d{4})(\d{2})(\d{2})[Tt]?(\d{2})(\d{2})(\d{2})?\s*(\S+)?", t):
        day, us, rest = day_number(int(m[1]), int(m[2]), int(m[3])), clock(m[4], m[5], m[6]), m[7]
        return _stamp(day, us, rest)
    if m := re.fullmatch(r"(\d{4})-?[Ww](\d{2})-?(\d)[Tt ](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?\s*(.*)", t):
        try:
            day = (dt.date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])) - EPOCH).days
        except ValueError:
            return None
        return _stamp(day, clock(m[4], m[5], m[6], None, m[7]), m[8])
    if m := re.fullmatch(r"(\d{4})([-./])(\d{1,2})\2(\d{1,2})(?:\s*[Tt]\s*|\s+)(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s*(.*)", t):
        return _stamp(day_number(int(m[1]), int(m[3]), int(m[4])), clock(m[5], m[6], m[7], None, m[8]), m[9])
    low = fold(t)
    # day first, or with the month's name, then the time of day
    if m := re.fullmatch(r"(?:([^\W\d]{3,})\.?,?\s+)?(\d{1,2}\s*[./\-]\s*\d{1,2}\s*[./\-]\s*\d{2,4}\.?|\d{1,2}\.?\s+[^\W\d]{3,}\.?,?\s+\d{4}\.?|[^\W\d]{3,}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})\s*,?\s*(?:u |at |od )?\s*(\d.*)", low):
        if m[1] and weekday_of(m[1]) is None:
            return None
        date, time = read_date(m[2]), read_time(re.sub(r"(?<=[\d ])(utc|gmt|cest|cet|z)\b", lambda x: x[1].upper(), m[3]))
        if date is None or time is None or date[0] != D_DAY:
            return None
        if time[1] is not None:
            return S_INSTANT, (date[1] * DAY - time[1]) * US + time[0], None
        return S_WALL, date[1] * DAY * US + time[0], time[2]
    return None


def _stamp(day: int | None, us: int | None, zone: str | None) -> tuple[int, int, str | None] | None:
    if day is None or us is None:
        return None
    wall = day * DAY * US + us
    zone = (zone or "").strip()
    if not zone:
        return S_WALL, wall, None
    if m := re.fullmatch(r"(.*?)\s*[\[(]([A-Za-z_]+/[A-Za-z_/]+)[\])]", zone):
        if not m[1]:
            return (S_WALL, wall, m[2]) if zone_named(m[2]) else None
        zone = m[1]
    offset = offset_named(zone)
    if offset is not None:
        return S_INSTANT, wall - offset * US, None
    return (S_WALL, wall, zone) if zone_named(zone) else None


# ---- parts to instants ----------------------------------------------------------------------------------------------


@lru_cache(maxsize=100_000)
def dated(kind: int, value: int, fetched_day: int | None) -> int | None:
    """Day number of a date that is relative to the day of the fetch: 0 to 7 days after it."""
    if fetched_day is None:
        return None
    if kind == D_AFTER:
        return fetched_day + value
    for k in range(8):
        date = EPOCH + dt.timedelta(days=fetched_day + k)
        if (date.month * 100 + date.day == value) if kind == D_MONTHDAY else date.weekday() == value:
            return fetched_day + k
    return None


def _codes(texts: pd.Series, read) -> tuple[np.ndarray, list]:
    """Index into the list of what `read` makes of each distinct text; -1 for null."""
    codes, values = pd.factorize(texts, use_na_sentinel=True)
    return codes, [read(v) for v in values]


def split_instants(date: pd.Series, time: pd.Series, fetched: pd.Series, zone: pd.Series) -> np.ndarray:
    """UTC microseconds (float NaN-free int64, MIN for none) of date and time texts that belong together."""
    n = len(date)
    none = np.iinfo(np.int64).min
    home = zone.fillna(HOME).to_numpy(object)
    dc, dv = _codes(date, read_date)
    tc, tv = _codes(time, read_time)
    ok = (dc >= 0) & (tc >= 0)
    dk = np.array([-1 if v is None else v[0] for v in dv] + [-1])[dc]
    dval = np.array([0 if v is None else v[1] for v in dv] + [0], dtype=np.int64)[dc]
    tus = np.array([none if v is None else v[0] for v in tv] + [none], dtype=np.int64)[tc]
    toff = np.array([none if v is None or v[1] is None else v[1] for v in tv] + [none], dtype=np.int64)[tc]
    tzone = np.array([None if v is None else v[2] for v in tv] + [None], dtype=object)[tc]
    ok &= (dk >= 0) & (tus != none)
    fetched_s = (fetched.fillna(0).to_numpy("int64")) // US
    has_fetch = fetched.notna().to_numpy()
    days = np.where(dk == D_DAY, dval, 0)
    for z in pd.unique(home):
        at = ok & (home == z) & (dk == D_INSTANT)
        days[at] = utc_to_wall(dval[at], z) // DAY
        fetched_day = utc_to_wall(fetched_s, z) // DAY
        for i in np.flatnonzero(ok & (home == z) & (dk >= D_MONTHDAY)):
            d = dated(int(dk[i]), int(dval[i]), int(fetched_day[i]) if has_fetch[i] else None)
            if d is None:
                ok[i] = False
            else:
                days[i] = d
    wall = days * DAY + tus // US
    out = np.full(n, none, dtype=np.int64)
    fixed = ok & (toff != none)
    out[fixed] = wall[fixed] - toff[fixed]
    rest = ok & ~fixed
    zones = np.where(pd.isna(tzone), home, tzone)
    for z in pd.unique(zones[rest]) if rest.any() else ():
        at = rest & (zones == z)
        out[at] = wall_to_utc(wall[at], z)
    good = out != none
    out[good] = out[good] * US + tus[good] % US
    return out


def stamp_instants(text: pd.Series, zone: pd.Series) -> np.ndarray:
    none = np.iinfo(np.int64).min
    home = zone.fillna(HOME).to_numpy(object)
    c, v = _codes(text, read_stamp)
    kind = np.array([-1 if x is None else x[0] for x in v] + [-1])[c]
    val = np.array([0 if x is None else x[1] for x in v] + [0], dtype=np.int64)[c]
    named = np.array([None if x is None else x[2] for x in v] + [None], dtype=object)[c]
    kind[c < 0] = -1
    out = np.where(kind == S_INSTANT, val, none)
    zones = np.where(pd.isna(named), home, named)
    at_wall = kind == S_WALL
    for z in pd.unique(zones[at_wall]) if at_wall.any() else ():
        at = at_wall & (zones == z)
        out[at] = wall_to_utc(val[at] // US, z) * US + val[at] % US
    return out


OUT = "src string, row_id bigint, instant_us bigint"


def to_instants(df: DataFrame, src: str) -> DataFrame:
    """`df` (row_id, zone, and either date, time, fetched_us or stamp) as (src, row_id, instant_us) where it denotes a moment."""
    split = "date" in df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            us = split_instants(b["date"], b["time"], b["fetched_us"], b["zone"]) if split else stamp_instants(b["stamp"], b["zone"])
            good = us != np.iinfo(np.int64).min
            yield pd.DataFrame({"src": src, "row_id": b["row_id"].to_numpy()[good], "instant_us": us[good]})

    return df.mapInPandas(run, OUT)


# ---- zones of sources -----------------------------------------------------------------------------------------------


STEP = 900  # seconds; offsets are whole quarters of an hour
FAR = 14 * 3600


def day_evidence(df: DataFrame, source: str, wall_day: Column, ingested_s: Column, horizon: int) -> DataFrame:
    """(source, kind, t, a, n): how many records of a source could violate an offset, by quarter hours, and (kind `all`) how many there are.

    A record announces a start 0 to `horizon` local days after its ingestion, so under an offset of `a` seconds or more
    its day is over before the ingestion, and under one of less than `a` - (horizon + 1) days it is beyond the horizon.
    Most records violate no offset at all; they are counted only. Counts are combined before the shuffle.
    """
    ends = (F.datediff(wall_day, F.lit(EPOCH)).cast("bigint") + 1) * DAY - ingested_s
    x = df.select(F.col(source).alias("source"), F.floor(ingested_s / STEP).alias("t"), F.floor(ends / STEP).alias("a")).where("source is not null and t is not null and a is not null")
    near = F.col("a").between(-FAR // STEP, FAR // STEP) | (F.col("a") - (horizon + 1) * DAY // STEP).between(-FAR // STEP, FAR // STEP)
    # days outside of what any offset allows say nothing about offsets
    kept = x.where(F.col("a").between(-FAR // STEP, ((horizon + 1) * DAY + FAR) // STEP))
    each = F.when(near, F.struct(F.lit("day").alias("kind"), "t", "a")).otherwise(F.struct(F.lit("all").alias("kind"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("a")))
    return kept.select("source", each.alias("x")).groupBy("source", "x").agg(F.count("*").alias("n")).select("source", "x.*", "n")


def offset_evidence(df: DataFrame, source: str, instant_s: Column, offset_s: Column) -> DataFrame:
    """(source, kind, t, a, n): offsets printed with stamps, by hour of the instant; an offset history that says otherwise is violated."""
    x = df.select(F.col(source).alias("source"), F.lit("offset").alias("kind"), (F.floor(instant_s / 3600) * (3600 // STEP)).alias("t"), offset_s.cast("bigint").alias("a")).where("source is not null and t is not null and a is not null")
    return x.groupBy("source", "kind", "t", "a").agg(F.count("*").alias("n"))


def violations(kind: np.ndarray, t: np.ndarray, a: np.ndarray, n: np.ndarray, offsets: np.ndarray, horizon: int) -> int:
    """Records that contradict the offsets (seconds, one for each entry)."""
    day = kind == "day"
    late = offsets >= (a + 1) * STEP
    early = offsets < a * STEP - (horizon + 1) * DAY
    return int(n[(day & (late | early)) | ((kind == "offset") & (offsets != a))].sum())


@lru_cache(maxsize=1)
def all_zones() -> tuple[str, ...]:
    """The zones of the database, well-known ones first."""
    return (*CANDIDATES, *sorted(z for z in available_timezones() if "/" in z and not z.startswith(("Etc/", "SystemV/", "posix/", "right/")) and z not in CANDIDATES))


def best_zone(evidence: pd.DataFrame, horizon: int = 7, default: str = HOME, margin: float = 0.02) -> str | None:
    """The zone whose offset history the evidence of one source violates least, None for the default.

    First all fixed offsets of whole quarter hours are tried; only if one of them does clearly better than the default
    are the zones that have an offset within an hour of it tried with their whole histories. Clearly better: by at
    least `margin` of all records, and by more than three standard deviations of what chance could do.
    """
    kind, t, a, n = (evidence[c].to_numpy() for c in ("kind", "t", "a", "n"))
    total, at = int(n.sum()), t * STEP
    home = violations(kind, t, a, n, utc_to_wall(at, default) - at, horizon)
    clearly = lambda v: home - v >= margin * total and home - v > 3 * math.sqrt(home + v + 1)
    fixed = {o: violations(kind, t, a, n, np.full(len(t), o), horizon) for o in range(-12 * 3600, FAR + 1, STEP)}
    least = min(fixed.values())
    # a history with two offsets may do better than either, but then either does better than the default's
    if not clearly(least):
        return None
    near = [o for o, v in fixed.items() if clearly(v)]
    middle = np.array([int(np.median(at[kind != "all"]))])
    best = (home, default)
    for z in all_zones():
        o = int((utc_to_wall(middle, z) - middle)[0])
        if z != default and min(near) - 3600 <= o <= max(near) + 3600:
            v = violations(kind, t, a, n, utc_to_wall(at, z) - at, horizon)
            if v < best[0]:
                best = (v, z)
    return best[1] if best[1] != default and clearly(best[0]) else None


def estimate_zones(evidence: DataFrame, horizon: int = 7, default: str = HOME, margin: float = 0.02) -> DataFrame:
    """(source, zone) of the sources whose evidence (of `day_evidence` and `offset_evidence`) fits another offset history than `default` better.

    The evidence of a source is counts by quarter hours of the calendar, so a source of any number of records fits a task.
    """

    def run(b: pd.DataFrame) -> pd.DataFrame:
        z = best_zone(b, horizon, default, margin)
        return pd.DataFrame({"source": b["source"].iloc[:1], "zone": [z]} if z else {"source": [], "zone": []}).astype(str)

    return evidence.groupBy("source").applyInPandas(run, "source string, zone string")


def with_zone(df: DataFrame, source: str, zones: DataFrame, rows: int = 10_000) -> DataFrame:
    """`df` with a column zone (null: the default). Exceptions are few; beyond `rows` of them they are joined instead."""
    few = zones.limit(rows + 1).collect()  # one row per source with another zone than the default
    if not few:
        return df.withColumn("zone", F.lit(None).cast("string"))
    if len(few) <= rows:
        table = F.create_map(*[F.lit(x) for r in few for x in (r["source"], r["zone"])])
        return df.withColumn("zone", F.try_element_at(table, F.col(source)))
    return df.join(zones.withColumnRenamed("source", "_zone_source"), F.col(source) == F.col("_zone_source"), "left").drop("_zone_source")


def wrong_or_changing(day: Column) -> Column:
    return day.isin(change_days())


def found(showtime: DataFrame, api_session: DataFrame) -> DataFrame:
    """src, row_id, instant_us of starts not in plain form or on a day of clock change; see TESTDATA.md, p2_found.

    The zone of a showtime's source is estimated from the days it announces and the times of its fetches; that of an
    api_session's source from the offsets its stamps print and from the days it announces, as far as it landed in time.
    """
    plain = F.col("date").rlike(r"^\d{4}-\d\d-\d\d\z") & F.col("time").rlike(r"^\d\d:\d\d\z")
    fetched_us = as_micros(showtime, "fetched_at")
    plain_day = F.when(plain, F.try_to_date(F.col("date"), "yyyy-MM-dd"))
    zones = estimate_zones(day_evidence(showtime, "cinema_id", plain_day, F.floor(fetched_us / US), 7))
    shown = showtime.where(F.col("date").isNotNull() & F.col("time").isNotNull() & (~plain | wrong_or_changing(F.col("date"))))
    shown = with_zone(shown.select(F.col("showtime_id").cast("bigint").alias("row_id"), "cinema_id", "date", "time", fetched_us.alias("fetched_us")), "cinema_id", zones)
    a = to_instants(shown.select("row_id", "date", "time", "fetched_us", "zone"), "showtime")

    t = F.col("showtime")
    shape = t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+\d\d:\d\d\z")
    at = F.when(shape, F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    at_utc = at if showtime.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC" else F.to_utc_timestamp(at, F.current_timezone())
    home = F.date_format(F.from_utc_timestamp(at_utc, HOME), "yyyy-MM-dd'T'HH:mm:ss")
    usual = F.coalesce(home == F.substring(t, 1, 19), F.lit(False)) & ~wrong_or_changing(F.substring(t, 1, 10))
    printed = F.when(shape, F.substring(t, 21, 2).cast("int") * 3600 + F.substring(t, 24, 2).cast("int") * 60)
    offsets = offset_evidence(api_session, "cinema_id", F.unix_seconds(at), printed)
    wall_day = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?\z"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    days = day_evidence(api_session, "cinema_id", wall_day, F.floor(as_micros(api_session, "landed_at") / US), 7)
    zones = estimate_zones(offsets.unionByName(days))
    told = with_zone(api_session.where(t.isNotNull() & ~usual).select(F.col("landing_id").cast("bigint").alias("row_id"), "cinema_id", t.alias("stamp")), "cinema_id", zones)
    return a.unionByName(to_instants(told.select("row_id", "stamp", "zone"), "api_session"))
