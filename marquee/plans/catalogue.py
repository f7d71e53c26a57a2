"""All queries of the core, and their SQL."""

from __future__ import annotations

from marquee.plans import assembly, general, publication


def queries() -> dict:
    return {**publication.QUERIES, **assembly.QUERIES, **general.queries()}


def oracle_sql() -> dict:
    return {**publication.SQL, **assembly.SQL}
