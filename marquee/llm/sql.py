"""The llm queries that SQL can express."""

from __future__ import annotations

from marquee.llm import survivors as V


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _usable_text(c: str) -> str:
    bare = f"lower(regexp_replace(regexp_replace({c}, {_q(r'''^[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\[({<\"'„“]+|[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}\])}>\"'“”]+$''')}, '', 'g'), {_q(r'[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+')}, ' ', 'g'))"
    parts = [f"{c} IS NOT NULL", f"{bare} NOT IN ({', '.join(map(_q, V.STAND_INS))})", f"regexp_matches({c}, {_q(r'[\p{L}\p{N}]')})"]
    parts += [f"NOT regexp_matches({c}, {_q(p.replace(chr(63) + "iu", chr(63) + "i"))})" for p in (V.OTHER_FIELD, V.BROKEN, V.CUT_OFF)]
    parts += [f"coalesce(trim({c}) <> trim({o}), true)" for o in ("synopsis", "distributor_code", "cinema_id")]
    return "(" + " AND ".join(parts) + ")"


def _p5() -> str:
    usable = {f: _usable_text(f) for f in ("raw_title", "original_title")}
    usable["runtime_minutes"] = f"runtime_minutes BETWEEN {V.FEATURE_MINUTES[0]} AND {V.FEATURE_MINUTES[1]}"
    usable["poster_url"] = f"(regexp_matches(poster_url, {_q(V.POSTER)}) AND NOT regexp_matches(poster_url, {_q(V.NO_POSTER)}))"
    long = " UNION ALL ".join(f"SELECT distributor_code, '{f}' AS field, listing_id, trust_rank, fetched_at FROM l WHERE {usable[f]}" for f in V.FIELDS)
    return f"""WITH l AS (SELECT l.*, v.trust_rank FROM listing l LEFT JOIN dim_venue v USING (cinema_id) WHERE distributor_code IS NOT NULL AND distributor_code IN (SELECT distributor_code FROM listing GROUP BY 1 HAVING count(DISTINCT listing_id) > 1)),
    x AS ({long}), r AS (SELECT *, row_number() OVER (PARTITION BY distributor_code, field ORDER BY trust_rank NULLS LAST, fetched_at DESC NULLS LAST, listing_id) AS n FROM x)
    SELECT distributor_code, field, listing_id FROM r WHERE n = 1"""


P6 = """WITH RECURSIVE k AS (SELECT DISTINCT group_no, key FROM (SELECT group_no, unnest(normalized_keys) AS key FROM title_group) WHERE key IS NOT NULL),
e AS (SELECT x.key AS a, y.key AS b FROM k x JOIN k y USING (group_no) UNION SELECT left_key, right_key FROM key_match WHERE left_key IS NOT NULL AND right_key IS NOT NULL UNION SELECT right_key, left_key FROM key_match WHERE left_key IS NOT NULL AND right_key IS NOT NULL),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS key, min(b) AS root FROM r GROUP BY 1),
g AS (SELECT group_no, min(coalesce(root, key)) AS root FROM k LEFT JOIN c USING (key) GROUP BY 1),
s AS (SELECT root, min(group_no) AS root_no, count(*) AS n FROM g GROUP BY 1)
SELECT group_no, root_no FROM g JOIN s USING (root) WHERE n > 1"""


def oracle_sql() -> dict:
    return {"p5_found": _p5(), "p6_found": P6}
