"""SQL for DuckDB that gives the same rows as queries of this subpackage, where SQL can express them."""

from __future__ import annotations

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  l AS (SELECT r, doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
  k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
  common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, t)) >= 10),
  m AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON common.key = k.key),
  s AS (SELECT *, gone <> lag(gone, 1, false) OVER (PARTITION BY r ORDER BY pos) AS turned FROM m),
  b AS (SELECT r, run, count(*) AS n FROM (SELECT r, sum(turned::INT) OVER (PARTITION BY r ORDER BY pos) AS run FROM s) GROUP BY r, run),
  e AS (SELECT r, max(run) AS last FROM b GROUP BY r),
  c AS (SELECT e.r, string_agg(coalesce(b.n, 0), ',' ORDER BY g.run) AS keep_runs FROM (SELECT r, last, unnest(range(0, (last + 1 + last % 2)::BIGINT)) AS run FROM e) g JOIN e ON e.r = g.r LEFT JOIN b ON b.r = g.r AND b.run = g.run GROUP BY e.r)
SELECT m.doc_id, count(*) AS n_lines, count_if(gone) AS n_dropped, any_value(keep_runs) AS keep_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN c ON c.r = m.r GROUP BY m.r, m.doc_id
"""

_RISK, _ALPHA, _GRID, _COST = 0.05, 0.05, 32, 5
_P = f"({_RISK}::DOUBLE / 3)"

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS l FROM d),
  g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
  inside AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
  c AS (SELECT w.r, doc_id, stratum, len(w)::BIGINT AS n_words, (length(t) - coalesce(length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')), 0))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(inside.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_text_lines FROM w LEFT JOIN inside ON inside.r = w.r),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS v1, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS v2, CASE WHEN n_text_lines > 0 THEN n_dup_lines / n_text_lines ELSE 0 END AS v3 FROM c),
  labelled AS (SELECT doc_id AS id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT quality) = 1),
  v AS (SELECT stratum, good, substr(md5('holdout:' || doc_id), 1, 1) < '8' AS holdout, unnest(['s', 'r', 'd']) AS rule, unnest([v1, v2, v3]) AS value FROM f JOIN labelled ON id = doc_id WHERE NOT base_failed),
  cuts AS (SELECT DISTINCT rule, unnest(list_append(quantile_cont(value, [{', '.join(f'{i / _GRID}' for i in range(1, _GRID))}]), 0)) AS cutoff FROM v WHERE NOT holdout GROUP BY rule),
  tested AS (SELECT stratum, v.rule, cutoff, count(*) FILTER (holdout AND good = 1) AS n, count(*) FILTER (holdout AND good = 1 AND value > cutoff) AS k,
    count(*) FILTER (NOT holdout AND good <> 1 AND value > cutoff) - {_COST} * count(*) FILTER (NOT holdout AND good = 1 AND value > cutoff) AS gain FROM v JOIN cuts ON cuts.rule = v.rule GROUP BY ALL),
  bound AS (SELECT *, CASE WHEN n > 0 THEN list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P}) + (n - j) * ln(1 - {_P})))) ELSE 1 END <= {_ALPHA} / (SELECT 3 * count(*) FROM (SELECT DISTINCT stratum FROM tested)) AS pass FROM tested),
  chain AS (SELECT *, bool_and(pass) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM bound),
  best AS (SELECT stratum, rule, max_by(cutoff, (gain, cutoff)) AS cutoff FROM chain WHERE ok AND gain > 0 GROUP BY stratum, rule),
  per AS (SELECT stratum, max(cutoff) FILTER (rule = 's') AS c1, max(cutoff) FILTER (rule = 'r') AS c2, max(cutoff) FILTER (rule = 'd') AS c3 FROM best GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(v1 > c1, false) OR coalesce(v2 > c2, false) OR coalesce(v3 > c3, false)) AS kept
FROM f LEFT JOIN per ON per.stratum IS NOT DISTINCT FROM f.stratum
"""

SQL = {"op4_quality_rules": QUALITY, "op9_line_dedup": LINE_DEDUP}
