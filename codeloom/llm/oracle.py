"""DuckDB SQL for the queries that it can express: the same counts from windows of words held as rows."""

from __future__ import annotations

import re

from codeloom.llm.quality_rules import LEAST_ROWS, MEASURES, REACH
from codeloom.llm.url_filter import BLOCKED_GLOBS

# Fixed values that the contracts state, written out here and not taken from the code under test:
# A-Z only is lower-cased; the base rule of op4; the site rules of op5 as (verdict, host, path).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_WORDS, MOST_REPEATED_PERCENT = 20, 30
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _contamination() -> str:
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words.format(_lowered("coalesce(text, '')"))} AS w FROM documents),
    b AS (SELECT row_number() OVER () AS q, item_id, {words.format(_lowered("coalesce(text, '')"))} AS w FROM benchmark),
    bi AS (SELECT q, item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bi),
    sizes AS (SELECT DISTINCT n FROM bw),
    di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
    dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM di),
    hit AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
    words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT r, n, i FROM hit)) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def _quality() -> str:
    space = r"\x20\x09-\x0D"
    measures = {m.name: f"coalesce({m.part} * {m.scale} // nullif({m.whole}, 0), 0)" for m in MEASURES}
    cut = "greatest(length(bin(v)) - 6, 0)"
    values = " UNION ALL ".join(
        f"SELECT l, s, '{m.name}' AS name, CAST({m.name} AS BIGINT) AS v FROM c WHERE NOT base_failed" for m in MEASURES
    )
    levels = " UNION ALL ".join(
        f"SELECT {n} AS level, {l} AS l, {s} AS s, name, low, n FROM k"
        for n, l, s in ((2, "l", "s"), (1, "l", "''"), (0, "''", "''"))
    )
    quartiles = ", ".join(
        f"min(low) FILTER (WHERE name = '{m.name}' AND 4 * upto >= {q} * total) AS {m.name}_q{q}" for m in MEASURES for q in (1, 3)
    )
    within = " AND ".join(
        f"{m.name} <= {m.name}_q3 + {REACH} * ({m.name}_q3 - {m.name}_q1) + {m.slack}"
        + (f" AND {m.name} >= {m.name}_q1 - {REACH} * ({m.name}_q3 - {m.name}_q1) - {m.slack}" if m.both_sides else "")
        for m in MEASURES
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s,
                      coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w FROM documents),
    lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
              FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^{space}]') GROUP BY r),
    places AS (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
    windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i : i + 7], ' ')) AS often FROM places),
    repeated AS (SELECT r, count(DISTINCT pos) AS n_repeat_words
                 FROM (SELECT r, unnest(range(i, i + 8)) AS pos FROM windows WHERE often > 1) GROUP BY r),
    b AS (SELECT r, doc_id, l, s, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                 coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words
          FROM d LEFT JOIN lines USING (r) LEFT JOIN repeated USING (r)),
    c AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed,
                 {", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in measures.items())} FROM b),
    vs AS ({values}),
    k AS (SELECT l, s, name, (v >> {cut}) << {cut} AS low, count(*) AS n FROM vs GROUP BY ALL),
    g AS (SELECT level, l, s, name, low, sum(n) AS n FROM ({levels}) GROUP BY ALL),
    u AS (SELECT *, sum(n) OVER (PARTITION BY level, l, s, name ORDER BY low) AS upto,
                 sum(n) OVER (PARTITION BY level, l, s, name) AS total FROM g),
    f AS (SELECT level, l, s, max(total) AS total, {quartiles} FROM u GROUP BY level, l, s),
    e AS (SELECT r, max(level) AS level FROM c JOIN f
          ON (f.level = 0 OR (f.level = 1 AND f.l = c.l) OR (f.level = 2 AND f.l = c.l AND f.s = c.s))
          WHERE total >= {LEAST_ROWS} OR level = 0 GROUP BY r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND coalesce({within}, true) AS kept, {", ".join(measures)}
    FROM c LEFT JOIN e USING (r) LEFT JOIN f ON f.level = e.level
         AND f.l = CASE WHEN e.level = 0 THEN '' ELSE c.l END AND f.s = CASE WHEN e.level = 2 THEN c.s ELSE '' END"""


def _urls() -> str:
    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rules = sorted(SITE_RULES, key=lambda rule: -len(rule[1] + rule[2]))
    names = " ".join(f"WHEN {fits(host, path)} THEN '{host}{path}'" for _, host, path in rules)
    verdicts = " ".join(f"WHEN rule = '{host}{path}' THEN '{verdict}'" for verdict, host, path in rules)
    parts = {"**": "(.|\\n)*", "*": "[^/]*", "?": "[^/]"}
    globs = "|".join("".join(parts.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*|\?)", glob)) for glob in BLOCKED_GLOBS)
    return f"""
    WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
    p AS (SELECT page_id, {_lowered("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    n AS (SELECT *, CASE {names} END AS rule FROM p)
    SELECT *, CASE {verdicts} WHEN host = '' OR regexp_full_match('.' || host || path, '{globs}') THEN 'block' ELSE 'allow' END AS verdict
    FROM n"""


def _exact() -> str:
    return f"""
    WITH d AS (SELECT doc_id, {_lowered("coalesce(text, '')")} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
           sha256(t) AS text_sha256
    FROM d JOIN g USING (t)"""


ORACLE: dict[str, str] = {
    "op3_decontamination": _contamination(),
    "op4_quality_rules": _quality(),
    "op5_url_filter": _urls(),
    "op11_exact_dedup": _exact(),
}
