"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: kind, expression, group whose length counts, least length: by kind in the order listed.
_KINDS = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("hub", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 1),
)


def _matches(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least,
        generate_subscripts(string_split_regex(t, {quoted}), 1) AS i,
        unnest(string_split_regex(t, {quoted})) AS gap,
        unnest(regexp_extract_all(t, {quoted}, 0)) AS own,
        unnest(regexp_extract_all(t, {quoted}, {group})) AS counted
    FROM d"""


#: Between the matches of a kind lie the pieces of a split, so running sums of lengths place them.
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_matches(k, *rule) for k, rule in enumerate(_KINDS))}),
placed AS (
    SELECT *, CAST(sum(length(gap) + coalesce(length(own), 0)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS stop
    FROM m
),
spans AS (
    SELECT r, k, stop - length(own) AS start, kind || ':' || (stop - length(own)) || ':' || stop AS said
    FROM placed WHERE length(counted) >= least
),
per AS (
    SELECT r,
        count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(said, ',' ORDER BY start, k) FILTER (k < 3) AS base,
        string_agg(said, ',' ORDER BY start, k) AS spans
    FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""

#: A window's words, joined; null where the text ends before.
_JOINED = " || ' ' || ".join(f"lead(word, {k}) OVER own" if k else "word" for k in range(13))

_SUBSTRING = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w
    FROM documents
),
words AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
windows AS (
    SELECT r, doc_id, p, {_JOINED} AS s
    FROM words WHERE doc_id IS NOT NULL WINDOW own AS (PARTITION BY r ORDER BY p)
),
least AS (SELECT s, min(doc_id) AS first FROM windows WHERE s IS NOT NULL GROUP BY s),
gone AS (
    SELECT DISTINCT r, unnest(range(p, p + 13)) AS p
    FROM windows JOIN least USING (s) WHERE doc_id > first
),
kept AS (
    SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
    FROM words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

ORACLES: dict[str, str] = {"op5_secret_scan": _SECRETS, "op7_substring": _SUBSTRING}
