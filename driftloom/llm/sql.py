"""SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_P5 = """
WITH keys AS (
  SELECT sample_id, batch_idx, window_id, min(greatest(added_at, loaded_at)) AS seen_at,
         sha256(concat_ws(chr(31), '1729', coalesce(sample_id, chr(0)), coalesce(CAST(batch_idx AS VARCHAR), chr(0)), coalesce(window_id, chr(0)))) AS priority
  FROM sampled_sequences GROUP BY sample_id, batch_idx, window_id),
k1 AS (SELECT * FROM keys WHERE seen_at < TIMESTAMP '2025-07-01'),
g1 AS (SELECT *, 1 AS generation FROM k1 QUALIFY row_number() OVER (ORDER BY priority) <= (SELECT ceil(round(count(*) * 0.2::DOUBLE, 6)) FROM k1)),
k2 AS (SELECT * FROM keys WHERE seen_at < TIMESTAMP '2025-10-01'),
g2 AS (SELECT *, 2 AS generation FROM k2 WHERE priority NOT IN (SELECT priority FROM g1)
       QUALIFY row_number() OVER (ORDER BY priority) <= (SELECT ceil(round(count(*) * 0.2::DOUBLE, 6)) FROM k2) - (SELECT count(*) FROM g1)),
g3 AS (SELECT *, 3 AS generation FROM keys WHERE priority NOT IN (SELECT priority FROM g1) AND priority NOT IN (SELECT priority FROM g2)
       QUALIFY row_number() OVER (ORDER BY priority) <= (SELECT ceil(round(count(*) * 0.2::DOUBLE, 6)) FROM keys) - (SELECT count(*) FROM g1) - (SELECT count(*) FROM g2))
SELECT sample_id, batch_idx, window_id, generation FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)
"""

_P6 = """
WITH long AS (
  SELECT window_id, 'local_aa_score' AS metric, local_aa_score AS v FROM gradient_scores WHERE window_id IS NOT NULL
  UNION ALL SELECT window_id, 'loss', loss FROM gradient_scores WHERE window_id IS NOT NULL),
ranked AS (
  SELECT window_id, metric, v, row_number() OVER (PARTITION BY window_id, metric ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY window_id, metric) AS n
  FROM long WHERE v IS NOT NULL AND isfinite(v)),
hit AS (
  SELECT window_id, metric, p, n, v FROM ranked, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS p)
  WHERE r = floor(p * (n - 1)))
SELECT window_id, metric, p, n,
       printf('%.8e', CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE sign(v) * (2 / (g + 1)) * pow(g, ceil(ln(abs(v)) / ln(g))) END)::DOUBLE AS estimate
FROM hit, (SELECT (1 + 0.01::DOUBLE * (1 - 1e-6::DOUBLE)) / (1 - 0.01::DOUBLE * (1 - 1e-6::DOUBLE)) AS g)
"""

_P7 = """
SELECT window_id, local_aa_score, primary_axis_dot_score, score_id
FROM (SELECT DISTINCT window_id, score_id, local_aa_score, primary_axis_dot_score FROM gradient_scores
      WHERE window_id IS NOT NULL AND local_aa_score IS NOT NULL AND isfinite(local_aa_score))
QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY local_aa_score DESC, primary_axis_dot_score DESC NULLS LAST, score_id) <= 10
"""

#: All windows of 32 ids as hashes of their text; pairs and stretches by grouping them.
_GRAMS = """
WITH seqs AS (SELECT DISTINCT sample_id, token_ids FROM sampled_sequences WHERE sample_id IS NOT NULL AND len(token_ids) >= 32),
grams AS (SELECT sample_id, i, hash(list_slice(token_ids, i, i + 31)) AS h FROM (SELECT sample_id, token_ids, unnest(range(1, len(token_ids) - 30)) AS i FROM seqs)),
shared AS (SELECT h FROM grams GROUP BY h HAVING min(sample_id) < max(sample_id)),
held AS (SELECT DISTINCT sample_id, h, i FROM grams WHERE h IN (SELECT h FROM shared)),
marks AS (SELECT DISTINCT sample_id, i - 1 AS start FROM held),
runs AS (SELECT sample_id, start, sum(brk) OVER (PARTITION BY sample_id ORDER BY start) AS run
         FROM (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY sample_id ORDER BY start) <= 32 THEN 0 ELSE 1 END AS brk FROM marks)),
stretches AS (SELECT sample_id, min(start) AS start, max(start) - min(start) + 32 AS n_ids FROM runs GROUP BY sample_id, run)
"""

ORACLE = {
    "p2_found": _GRAMS + "SELECT DISTINCT a.sample_id AS sample_id_a, b.sample_id AS sample_id_b FROM held a JOIN held b ON a.h = b.h AND a.sample_id < b.sample_id",
    "p2_repeats": _GRAMS + """, met AS (SELECT a.sample_id AS x, b.sample_id AS y, a.i AS i, a.i - b.i AS d FROM held a JOIN held b ON a.h = b.h AND a.sample_id < b.sample_id),
rep AS (SELECT x, y, d, i, i - row_number() OVER (PARTITION BY x, y, d ORDER BY i) AS run FROM met)
SELECT x AS sample_id_a, min(i) - 1 AS start_a, y AS sample_id_b, min(i) - d - 1 AS start_b, max(i) - min(i) + 32 AS n_ids FROM rep GROUP BY x, y, d, run""",
    "p2_stretches": _GRAMS + """, sets AS (SELECT h, list_sort(list(sample_id || ':' || i)) AS own, list_sort(list(sample_id || ':' || (i - 1))) AS prior, count(*) AS places, count(DISTINCT sample_id) AS records FROM held GROUP BY h),
told AS (SELECT sample_id, i, records, places, CASE WHEN lag(i) OVER w = i - 1 AND lag(own) OVER w = prior THEN 0 ELSE 1 END AS brk FROM held JOIN sets USING (h) WINDOW w AS (PARTITION BY sample_id ORDER BY i)),
cls AS (SELECT *, sum(brk) OVER (PARTITION BY sample_id ORDER BY i) AS run FROM told)
SELECT sample_id, min(i) - 1 AS start, max(i) - min(i) + 32 AS n_ids, any_value(records) AS records, any_value(places) AS places FROM cls GROUP BY sample_id, run""",
    "p2_coverage": _GRAMS + """
SELECT sample_id, n_ids, coalesce(s, 0) AS shared_ids, CASE WHEN n_ids > 0 THEN coalesce(s, 0) / n_ids ELSE 0.0 END AS shared_share
FROM (SELECT sample_id, max(coalesce(len(token_ids), 0)) AS n_ids FROM sampled_sequences WHERE sample_id IS NOT NULL GROUP BY 1)
LEFT JOIN (SELECT sample_id, sum(n_ids) AS s FROM stretches GROUP BY 1) USING (sample_id)""",
    "p5_sample": _P5,
    "p6_percentiles": _P6,
    "p6_percentiles_of_days": _P6,
    "p7_found": f"SELECT window_id, score_id FROM ({_P7})",
    "p7_top_rows": _P7,
}
