"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .decontam import SHINGLE, THRESHOLD
from .mixing import BUCKET_DOCS, EPOCHS, SEED, SHARE, WEIGHTS
from .quality import RULES, STOP_WORDS

WHITE = r"[ \t\n\x0B\f\r]"


def _quality() -> str:
    def bound(r) -> str:
        sides = [f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)
        return f"(n_words < {r.holds_from} OR coalesce({' AND '.join(sides)}, true))"

    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rn, doc_id, text, list_filter(string_split_regex(text, '{WHITE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM t),
g AS (SELECT rn, i, list_slice(w, i, i + 7) AS gram FROM (SELECT rn, w, unnest(generate_series(1, len(w) - 7)) AS i FROM s WHERE len(w) >= 8)),
hits AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS c FROM g) WHERE c > 1),
gaps AS (SELECT rn, least(8, coalesce(lead(i) OVER (PARTITION BY rn ORDER BY i) - i, 8)) AS d FROM hits),
r AS (SELECT rn, sum(d) AS n FROM gaps GROUP BY rn),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
  length(text) - length(replace(text, '|', '')) AS n_pipes,
  len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutters, len(list_filter(w, lambda x: x LIKE '%!!')) AS n_shouts
  FROM s LEFT JOIN r USING (rn)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(map(bound, RULES))} AS kept FROM b"""


def _mix() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{WHITE}+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, sum(source_size) OVER () AS total FROM s),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1] AS weight FROM r),
l AS (SELECT *, ({SHARE} * CAST(total AS DOUBLE) - coalesce(sum(source_size * {EPOCHS}) OVER (ORDER BY source_size * {EPOCHS} / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / CAST(sum(weight) OVER (ORDER BY source_size * {EPOCHS} / CAST(weight AS DOUBLE), place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS own_level FROM w),
t AS (SELECT source, source_size, docs, least(max(own_level) OVER () * weight, CAST(source_size * {EPOCHS} AS DOUBLE)) AS target FROM l),
k AS (SELECT d.*, t.source_size, t.docs, t.target, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CAST('0x' || substr(key, 25, 8) AS BIGINT) % CAST(ceil(docs / {BUCKET_DOCS}.0) AS BIGINT) AS bucket FROM k),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, bucket ORDER BY key, doc_id, size, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY source, bucket) AS every FROM b)
SELECT doc_id, size, source_size, target,
  CAST(floor(ratio) * size + least(greatest(floor((ratio - floor(ratio)) * every + 0.5) - before, 0), size) AS BIGINT) AS taken FROM c"""


def _leaks() -> str:
    """Of items of five words or more."""
    listed = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS rn, doc_id, {listed} AS w FROM documents),
iw AS (SELECT item_id, {listed} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
d AS (SELECT DISTINCT rn, doc_id, list_slice(w, i, i + {SHINGLE - 1}) AS g FROM (SELECT rn, doc_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM dw WHERE len(w) >= {SHINGLE})),
b AS (SELECT DISTINCT item_id, list_slice(w, i, i + {SHINGLE - 1}) AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM iw WHERE len(w) >= {SHINGLE})),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id),
s AS (SELECT rn, doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, CAST(n_shared AS DOUBLE) / n_shingles AS containment FROM s JOIN n USING (item_id) WHERE n_shared >= {THRESHOLD} * n_shingles"""


ORACLES: dict[str, str] = {
    "op3_mix": _mix(),
    "op10_decontaminate": _leaks(),
    "op6_quality": _quality(),
}
