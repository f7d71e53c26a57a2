"""Addresses: safe links, allowed origins, searches, pages."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.text import serbian_latin


def safe_url(c: Column) -> Column:
    """The address without line breaks and tabs if it is relative or http, https or mailto; else null."""
    t = F.regexp_replace(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""), r"[\t\n\r]", "")
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = ~t.rlike(r"(?i)^https?:/*$")
    return F.when((t != "") & ~t.startswith("//") & ((scheme == "") | scheme.isin("http", "https", "mailto")) & host, t)


def on_origin(base: str, allowed: tuple[str, ...], secure: tuple[str, ...] = ()):
    """A vectorised function: the address resolved against `base` if its origin is allowed, else null.

    Hosts in `secure` are moved to https first. Resolving an address is no Spark builtin.
    """

    @F.pandas_udf("string")
    def resolve(hrefs: pd.Series) -> pd.Series:
        def one(h):
            if h is None:
                return None
            try:
                url = urljoin(base, h.strip())
                parts = urlsplit(url)
            except ValueError:
                return None
            if parts.scheme == "http" and parts.netloc in secure:
                url = "https" + url[4:]
                parts = urlsplit(url)
            return url if f"{parts.scheme}://{parts.netloc}" in allowed else None

        return hrefs.map(one)

    return resolve


def component(c: Column) -> Column:
    """Percent encoding of a query component as browsers do it."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(code), F.lit(sign))
    return e


WATCH = "https://www.youtube.com/watch?v="
SEARCH = "https://www.youtube.com/results?search_query="


def trailer_link(title: Column, original: Column, key: Column) -> tuple[Column, Column]:
    """(address, exact): the video if its key is known, else the search a person would type."""
    words = F.concat_ws(" ", title, F.when((original != "") & (original != title), original), F.lit("trailer"), F.lit("srpski"))
    known = key.isNotNull() & (key != "")
    return F.when(known, F.concat(F.lit(WATCH), component(key))).otherwise(F.concat(F.lit(SEARCH), component(words))), known


def page_name(day: Column, first: Column) -> Column:
    return F.when(day == first, "index.html").otherwise(F.concat(day, F.lit(".html")))


def query_string(city: Column, default_city: str, dubbed: Column, kids: Column) -> Column:
    """The filter state as a query, the default city left out."""
    q = F.concat_ws("&", F.when(city != default_city, F.concat(F.lit("grad="), component(city))), F.when(dubbed, F.lit("dubbed=1")), F.when(kids, F.lit("kids=1")))
    return F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")


def escape_html(c: Column) -> Column:
    """Text as a page shows it: in Serbian Latin, with its signs escaped."""
    return escape_markup(serbian_latin(c))


def escape_markup(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def content_hash(c: Column) -> Column:
    """base64 of the SHA-256 of the text's bytes."""
    return F.base64(F.unhex(F.sha2(c, 256)))
