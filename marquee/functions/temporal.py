"""Dates and times of a programme as column expressions. "Now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME = "Europe/Belgrade"
#: Names of days (Sunday first) and months.
WEEKDAYS = ["nedelja", "ponedeljak", "utorak", "sreda", "četvrtak", "petak", "subota"]
MONTHS = ["januar", "februar", "mart", "april", "maj", "jun", "jul", "avgust", "septembar", "oktobar", "novembar", "decembar"]


def local(ts: Column, zone: str = HOME) -> Column:
    """Wall time in `zone` of an instant; the session's time zone must be UTC."""
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column) -> Column:
    return F.date_format(local(ts), "yyyy-MM-dd")


def local_time(ts: Column) -> Column:
    return F.date_format(local(ts), "HH:mm")


def utc_offset(ts: Column) -> Column:
    """`+01:00` or `+02:00`: what the home zone has at that instant."""
    minutes = F.timestamp_diff("MINUTE", ts, local(ts))
    return F.format_string("+%02d:%02d", F.expr("1") * (minutes / 60).cast("int"), minutes % 60)


def timestamp_label(ts: Column) -> Column:
    return F.date_format(local(ts), "dd.MM.yyyy. 'u' HH:mm")


def day_label(day: Column, today: Column) -> Column:
    """danas, sutra, or weekday, day. month."""
    delta = F.datediff(day, today)
    name = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.when(delta == 0, "danas").when(delta == 1, "sutra").otherwise(F.concat(name, F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(". "), month))


def day_short(day: Column, today: Column) -> Column:
    delta = F.datediff(day, today)
    date = F.concat(F.dayofmonth(day).cast("string"), F.lit("."), F.month(day).cast("string"), F.lit("."))
    name = F.substring(F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(day)), 1, 3)
    return F.concat(F.when(delta == 0, "danas").when(delta == 1, "sutra").otherwise(name), F.lit(" "), date)


def normalize_time(raw: Column) -> Column:
    """HH:mm of the first `9:05`, `09.05` or `9h05` in a text, null if there is none or it is no time."""
    p = r"([0-9]{1,2})[\t\n\x0B\f\r ]*[:.hH][\t\n\x0B\f\r ]*([0-9]{2})"
    h, m = F.regexp_extract(raw, p, 1).try_cast("int"), F.regexp_extract(raw, p, 2).try_cast("int")
    return F.when((h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))


def minutes_of(time: Column) -> Column:
    """Minutes after midnight of HH:mm, -1 for anything else."""
    ok = time.rlike(r"^[0-9]{2}:[0-9]{2}$")
    return F.when(ok, F.substring(time, 1, 2).try_cast("int") * 60 + F.substring(time, 4, 2).try_cast("int")).otherwise(-1)


def resolve_date(label: Column, days: Column) -> Column:
    """The first of `days` (array of YYYY-MM-DD in order) that a label such as `petak 21.08.` means, else null."""
    p = r"([0-9]{1,2})[ ]*\.[ ]*([0-9]{1,2})[ ]*\."
    d, m = F.regexp_extract(label, p, 1), F.regexp_extract(label, p, 2)
    suffix = F.concat(F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return F.when(d != "", F.get(F.filter(days, lambda x: x.endswith(suffix)), F.lit(0)))


def wall_parts(stamp: Column) -> tuple[Column, Column]:
    """Date and HH:mm as printed in an ISO stamp, without conversion."""
    p = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2})"
    part = lambda i: F.when(stamp.rlike(p), F.regexp_extract(stamp, p, i))
    return part(1), part(2)
