"""SQL that gives the rows of the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from .secrets import BASE, RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRING = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
win AS (SELECT r, s, array_to_string(t[s:s + 34], ' ') AS k FROM (SELECT r, t, unnest(range(1, len(t) - 33)) AS s FROM d)),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS p FROM win SEMI JOIN twice USING (k)),
word AS (SELECT r, unnest(t) AS x, generate_subscripts(t, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS t FROM documents), b AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
item AS (SELECT DISTINCT item_id, n, array_to_string(t[s:s + n - 1], ' ') AS k FROM (SELECT item_id, t, least(len(t), 10) AS n, unnest(range(1, len(t) - least(len(t), 10) + 2)) AS s FROM b WHERE len(t) > 0)),
size AS (SELECT DISTINCT n FROM item),
win AS (SELECT r, n, s, array_to_string(t[s:s + n - 1], ' ') AS k FROM (SELECT r, t, n, unnest(range(1, len(t) - n + 2)) AS s FROM d CROSS JOIN size)),
hit AS (SELECT r, n, s, item_id FROM win JOIN item USING (n, k)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _secret_scan() -> str:
    whole = [f"({r.pattern})({r.tail})" if r.tail else r.pattern for r in RULES]
    least = " ".join(f"WHEN {i} THEN regexp_full_match(m, {_quoted(f'({r.kept})({r.tail})' if r.tail else r.kept)})" for i, r in enumerate(RULES))
    parts = "\nUNION ALL ".join(
        f"""SELECT r, {i} AS o, '{rule.kind}' AS kind, unnest(m) AS m, unnest(gap[1:len(m)]) AS gap, generate_subscripts(m, 1) AS k
 FROM (SELECT r, regexp_extract_all(text, {_quoted(x)}) AS m, regexp_split_to_array(text, {_quoted(x)}) AS gap FROM d)"""
        for i, (rule, x) in enumerate(zip(RULES, whole, strict=True))
    )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
part AS ({parts}),
place AS (SELECT *, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY r, o ORDER BY k) AS BIGINT) AS e FROM part),
span AS (SELECT r, o, kind, e - length(m) AS s, kind || ':' || (e - length(m)) || ':' || e AS x FROM place WHERE CASE o {least} END),
one AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k.kind}') AS n_{k.kind}" for k in BASE)}, string_agg(x, ',' ORDER BY s, o) FILTER (kind IN ({base})) AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM span GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k.kind}, 0) AS n_{k.kind}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN one USING (r)"""


SECRETS = _secret_scan()
ORACLES = {"op1_substring_dedup": SUBSTRING, "op2_decontaminate": DECONTAMINATE, "op8_secret_scan": SECRETS}
