"""Values read out of the text of a page or label, as column expressions; null where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def original_title(paragraph: Column) -> Column:
    """The part before the first `|` of the paragraph beside the heading, unless it is a label or of no title's length."""
    t = F.trim(F.element_at(F.split(paragraph, r"\|"), 1))
    return F.when(~t.rlike("(?iu)trajanje|žanr|zanr") & F.length(t).between(2, 120), t)


def country_code(value: Column) -> Column:
    """Two or three leading letters, in capitals."""
    return F.upper(_some(F.regexp_extract(value, "^([A-Za-z]{2,3})", 1)))


def labelled(text: Column, label: str) -> Column:
    """What follows `label:` up to the end of the line or the next label."""
    return _some(F.trim(F.regexp_extract(text, rf"(?iu){label}\s*:\s*([^\n|]*)", 1)))


def runtime(text: Column) -> Column:
    """Minutes after `Trajanje:`, from 30 to 400."""
    m = F.regexp_extract(text, r"(?i)Trajanje:\s*([0-9]{2,3})\s*min", 1).try_cast("int")
    return F.when(m.between(30, 400), m)


def hall(text: Column) -> Column:
    return _some(F.regexp_extract(text, r"Sala:\s*(\S+)", 1))


def redacted(text: Column) -> Column:
    """Addresses without their query, as they may carry keys."""
    return F.regexp_replace(text, r"\?\S*", "")


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty: a parameter, what is stored, the default."""
    return F.coalesce(*[_some(v) for v in values])
