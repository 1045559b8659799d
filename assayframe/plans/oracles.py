"""The SQL twins of the registered queries, built from common table expressions."""

from __future__ import annotations

from ..functions.scalars import DEVIATES
from ..functions.tails import EXACT_CELLS
from .fixtures import NATION, SUPPLIER, matrix_sql, raters_sql
from .queries import COHORTS, FDR, ITEM_JSON, RECORDS, RESAMPLES

D = "::DOUBLE"


def chain(resp: str, key: str = "suite_id") -> str:
    """From responses to judged items and a summary; every table carries ``key``."""
    return f"""{resp},
tot AS (SELECT {key}, model_idx, model, sum(passed)::BIGINT AS total FROM resp GROUP BY ALL),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY total, model_idx) AS rn, count(*) OVER (PARTITION BY {key}) AS m,
         greatest(1, round_even(count(*) OVER (PARTITION BY {key}) * 0.27{D}, 0)::INT) AS g FROM tot),
mom AS (
  SELECT r.{key}, item_idx, item_id, count(*)::BIGINT AS n, sum(passed)::BIGINT AS k, sum(total)::BIGINT AS st, sum(total * total)::BIGINT AS stt,
         sum(total * passed)::BIGINT AS stx, min(total - passed) AS lo, max(total - passed) AS hi, max(g) AS g,
         sum(CASE WHEN rn <= g THEN passed ELSE 0 END){D} / max(g) AS pl, sum(CASE WHEN rn > m - g THEN passed ELSE 0 END){D} / max(g) AS pu
  FROM resp r JOIN rk USING ({key}, model_idx) GROUP BY ALL),
stat AS (
  SELECT *, n * (stt - 2 * stx + k) - (st - k) * (st - k) AS v, n * stt - st * st AS vraw, k{D} / n AS p, pu - pl AS d FROM mom),
corr AS (
  SELECT *, CASE WHEN k IN (0, n) OR v = 0 THEN NULL ELSE ((stx - k){D} / k - (st - stx){D} / (n - k)) / (sqrt(v{D}) / n) * sqrt(p * (1 - p)) END AS rn0,
         CASE WHEN k IN (0, n) OR vraw = 0 THEN 0 ELSE (stx{D} / k - (st - stx){D} / (n - k)) / (sqrt(vraw{D}) / n) * sqrt(p * (1 - p)) END AS rraw,
         CASE WHEN k IN (0, n) OR v = 0 THEN 'undefined' WHEN n * k * (k * (hi - lo) + 1) <= {EXACT_CELLS} THEN 'exact' ELSE 'normal' END AS method
  FROM stat),
items_ AS (SELECT *, coalesce(rn0, 0{D}) AS r FROM corr)"""


def tested(key: str = "suite_id") -> str:
    """p-values: subset counting by recursion, and the normal distribution's series by recursion."""
    return f""",
val AS (
  SELECT i.{key}, i.item_idx, i.k, row_number() OVER (PARTITION BY i.{key}, i.item_idx ORDER BY t.model_idx) AS ord, (t.total - r.passed - i.lo)::BIGINT AS v
  FROM items_ i JOIN resp r ON r.{key} = i.{key} AND r.item_idx = i.item_idx JOIN tot t ON t.{key} = r.{key} AND t.model_idx = r.model_idx WHERE method = 'exact'),
dp AS (
  WITH RECURSIVE w AS (
    SELECT DISTINCT {key}, item_idx, 0::BIGINT AS ord, 0::BIGINT AS j, 0::BIGINT AS s, 1{D} AS ways FROM val
    UNION ALL
    SELECT {key}, item_idx, ord, j, s, sum(ways) AS ways FROM (
      SELECT w.{key}, w.item_idx, val.ord, w.j + e.e AS j, w.s + e.e * val.v AS s, w.ways
      FROM w JOIN val ON val.{key} = w.{key} AND val.item_idx = w.item_idx AND val.ord = w.ord + 1 CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1) e WHERE w.j + e.e <= val.k)
    GROUP BY {key}, item_idx, ord, j, s)
  SELECT * FROM w),
pe AS (
  SELECT i.{key}, i.item_idx, sum(CASE WHEN s <= stx - i.k - i.k * lo THEN ways ELSE 0 END) / sum(ways) AS p
  FROM items_ i JOIN dp ON dp.{key} = i.{key} AND dp.item_idx = i.item_idx AND dp.ord = i.n AND dp.j = i.k GROUP BY ALL),
zed AS (
  SELECT {key}, item_idx, (stx - k + 0.5{D} - k * ((st - k){D} / n)) / sqrt((k * (n - k)){D} / (n - 1) * (v{D} / (n * n))) AS z FROM items_ WHERE method = 'normal'),
ser AS (
  WITH RECURSIVE g AS (
    SELECT {key}, item_idx, z, 0 AS i, z AS term, z AS total FROM zed
    UNION ALL SELECT {key}, item_idx, z, i + 1, term * z * z / (2 * (i + 1) + 1), total + term * z * z / (2 * (i + 1) + 1) FROM g WHERE i < 199)
  SELECT {key}, item_idx, CASE WHEN z < -8.5 THEN 0 WHEN z > 8.5 THEN 1 ELSE 0.5{D} + exp(-z * z / 2) / sqrt(2 * pi()) * total END AS p FROM g WHERE i = 199),
tests AS (
  SELECT i.*, coalesce(pe.p, ser.p) AS pv FROM items_ i LEFT JOIN pe ON pe.{key} = i.{key} AND pe.item_idx = i.item_idx LEFT JOIN ser ON ser.{key} = i.{key} AND ser.item_idx = i.item_idx),
bh AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pv NULLS LAST) AS prank, count(pv) OVER (PARTITION BY {key}) AS pm FROM tests),
sig AS (
  SELECT *, coalesce(pv <= max(CASE WHEN pv <= {FDR}{D} * prank / pm THEN pv END) OVER (PARTITION BY {key}), FALSE) AND r < 0 AS significant FROM bh),
judged AS (
  SELECT *, CASE WHEN k IN (0, n) THEN 'dead' WHEN significant THEN 'backwards' WHEN r < 0.2{D} THEN 'weak' WHEN r < 0.4{D} THEN 'acceptable' ELSE 'strong' END AS verdict,
         coalesce(NOT significant AND pv IS NOT NULL AND r < 0, FALSE) AS odd FROM sig)"""


def reliability(key: str = "suite_id") -> str:
    return f""",
rel0 AS (
  SELECT a.{key}, ni, nm, within, nm * stt - st * st AS spread
  FROM (SELECT {key}, count(*) AS ni, sum(k * (n - k))::BIGINT AS within FROM mom GROUP BY 1) a
  JOIN (SELECT {key}, count(*) AS nm, sum(total)::BIGINT AS st, sum(total * total)::BIGINT AS stt FROM tot GROUP BY 1) b ON a.{key} = b.{key}),
rel1 AS (SELECT *, CASE WHEN spread = 0 THEN 0 ELSE ni{D} / (ni - 1) * (1 - within{D} / spread) END AS alpha FROM rel0),
rel AS (SELECT *, sqrt(spread{D}) / nm * sqrt(greatest(0{D}, 1 - alpha)) AS sem FROM rel1),
gap AS (SELECT *, 1.96{D} * sem * sqrt(2{D}) AS real_gap FROM rel)"""


NAT, SUP = chain(matrix_sql(NATION, "VARCHAR")), chain(matrix_sql(SUPPLIER, "VARCHAR"))
NAT_T, SUP_T = NAT + tested(), SUP + tested()


def _pick(condition: str) -> str:
    return f"WITH {NAT_T} SELECT item_idx, item_id FROM judged WHERE {condition}"


COHORT_RESP = f"""{matrix_sql(NATION, "VARCHAR").replace("resp AS (", "resp0 AS (")},
tot0 AS (SELECT model_idx, sum(passed) AS total FROM resp0 GROUP BY 1),
rank0 AS (SELECT model_idx, row_number() OVER (ORDER BY total DESC, model_idx) AS place, count(*) OVER () AS available FROM tot0),
resp AS (
  SELECT cohort, (place - 1)::INT AS model_idx, model, item_idx, item_id, passed
  FROM resp0 JOIN rank0 USING (model_idx) JOIN (SELECT unnest({list(COHORTS)}) AS cohort) c ON cohort <= available AND place <= cohort)"""

TRIM = """
SELECT '{name}' AS kept, (SELECT count(*) FROM judged WHERE verdict IN {verdicts}) AS n_kept, round(1 - 6 * sum((ra - rb) * (ra - rb))::DOUBLE / (count(*) * (count(*) * count(*) - 1)), 9) AS spearman
FROM (
  SELECT row_number() OVER (ORDER BY total DESC, model_idx) AS ra, row_number() OVER (ORDER BY part DESC, model_idx) AS rb
  FROM tot JOIN (SELECT model_idx, sum(CASE WHEN verdict IN {verdicts} THEN passed ELSE 0 END) AS part FROM resp JOIN judged USING (item_idx) GROUP BY 1) USING (model_idx))"""

ORACLES: dict[str, str] = {
    "model_totals": f"WITH {NAT} SELECT model_idx, model, total FROM tot",
    "difficulty": f"WITH {NAT} SELECT item_id, k, n, round(p, 9) AS difficulty FROM stat",
    "item_variance": f"WITH {NAT} SELECT item_id, round((k * (n - k)){D} / (n * n), 9) AS variance FROM stat",
    "point_biserial": f"WITH {NAT} SELECT item_id, round(r, 9) AS r, round(rn0, 9) AS pearson FROM items_",
    "point_biserial_raw": f"WITH {NAT} SELECT item_id, round(rraw, 9) AS r FROM items_",
    "discrimination_index": f"WITH {SUP} SELECT item_id, g AS extreme, round(d, 9) AS d FROM stat",
    "cronbach_alpha": f"WITH {NAT}{reliability()} SELECT ni AS n_items, nm AS n_models, round(alpha, 9) AS alpha FROM rel",
    "sem": f"WITH {NAT}{reliability()} SELECT round(sem, 9) AS sem FROM rel",
    "min_real_gap": f"WITH {NAT}{reliability()} SELECT c{D} AS confidence, round(z{D} * sem * sqrt(2{D}), 9) AS gap FROM rel CROSS JOIN (VALUES {', '.join(map(str, DEVIATES.items()))}) v(c, z)",
    "backwards_p_exact": f"WITH {NAT_T} SELECT item_id, round(pv, 9) AS p FROM tests WHERE method = 'exact'",
    "backwards_p_normal": f"WITH {SUP_T} SELECT item_id, round(pv, 9) AS p FROM tests WHERE method = 'normal'",
    "backwards_p_method": f"WITH {SUP} SELECT item_id, method FROM items_",
    "benjamini_hochberg": f"WITH {NAT_T} SELECT item_id, significant AS backwards_significant FROM judged",
    "verdicts": f"WITH {NAT_T} SELECT item_id, verdict, round(r, 9) AS r, round(d, 9) AS d, round(pv, 9) AS p FROM judged",
    "detectability": f"""
WITH RECURSIVE c AS (SELECT 1 AS n, 0 AS i, 1{D} AS ways UNION ALL SELECT n, i + 1, ways * (n - i) / (i + 1) FROM c WHERE i < n // 2),
starts AS (SELECT unnest(range(1, 200)) AS n),
b AS (
  WITH RECURSIVE c2 AS (SELECT n, 0 AS i, 1{D} AS ways FROM starts UNION ALL SELECT n, i + 1, ways * (n - i) / (i + 1) FROM c2 WHERE i < n // 2)
  SELECT n, ways FROM c2 WHERE i = n // 2)
SELECT n::INT AS n_models, n >= 2 AND 1 / ways <= {FDR}{D} AS detectable FROM b""",
    "dead_items": _pick("verdict = 'dead'"),
    "backwards_items": _pick("verdict = 'backwards'"),
    "weak_items": _pick("verdict = 'weak'"),
    "strong_items": _pick("verdict = 'strong'"),
    "keep_list": _pick("verdict IN ('acceptable', 'strong')"),
    "dead_split": f"WITH {NAT_T} SELECT item_id, CASE WHEN k = n THEN 'all' ELSE 'none' END AS passes FROM judged WHERE verdict = 'dead'",
    "suspicious_items": f"WITH {SUP_T} SELECT item_id, round(r, 9) AS r, round(pv, 9) AS p FROM judged WHERE odd",
    "ranked_items": f"WITH {NAT} SELECT item_id, round(r, 9) AS r FROM (SELECT * FROM items_ ORDER BY r DESC, item_idx LIMIT 20)",
    "suite_summary": f"""
WITH {NAT_T}{reliability()},
cnt AS (
  SELECT suite_id, {", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("dead", "backwards", "weak", "acceptable", "strong"))},
         count(*) FILTER (k = n) AS dead_all_pass, count(*) FILTER (k = 0) AS dead_none_pass, count(*) FILTER (odd) AS suspicious,
         count(*) FILTER (verdict IN ('weak', 'acceptable', 'strong')){D} / count(*) AS signal_ratio, count(*) FILTER (verdict IN ('dead', 'backwards')){D} / count(*) AS wasted_fraction
  FROM judged GROUP BY 1)
SELECT ni AS n_items, nm AS n_models, dead, dead_all_pass, dead_none_pass, backwards, weak, acceptable, strong, suspicious, backwards = 0 AND wasted_fraction < 0.3{D} AS healthy,
       round(alpha, 9) AS alpha, round(sem, 9) AS sem, round(real_gap, 9) AS min_real_gap, round(signal_ratio, 9) AS signal_ratio, round(wasted_fraction, 9) AS wasted_fraction
FROM cnt JOIN gap USING (suite_id)""",
    "separates_adjacent": f"""
WITH {NAT}{reliability()},
o AS (SELECT *, row_number() OVER w AS place, lead(model) OVER w AS model_b, lead(total) OVER w AS total_b FROM tot WINDOW w AS (ORDER BY total DESC, model_idx))
SELECT place::INT AS place, model AS model_a, model_b, total - total_b AS gap, total - total_b > real_gap AS "real" FROM o CROSS JOIN gap WHERE model_b IS NOT NULL""",
    "tied_for_first": f"WITH {NAT}{reliability()} SELECT model, total FROM tot CROSS JOIN gap WHERE (SELECT max(total) FROM tot) - total <= real_gap",
    "two_raters": f"WITH {chain(raters_sql('VARCHAR'))}{tested()} SELECT verdict, method AS p_method, count(*) AS n_items, sum(k)::BIGINT AS passes FROM judged GROUP BY ALL",
    "indistinct_pairs": f"""
WITH {NAT}{reliability()}, o AS (SELECT total - lead(total) OVER (ORDER BY total DESC, model_idx) AS gap FROM tot)
SELECT count(gap) AS n_pairs, count(*) FILTER (gap <= real_gap) AS n_indistinct,
       any_value(CASE WHEN alpha >= 0.9 THEN 'excellent, or items that repeat each other' WHEN alpha >= 0.8 THEN 'good' WHEN alpha >= 0.7 THEN 'acceptable'
                 WHEN alpha >= 0.6 THEN 'questionable' ELSE 'poor: totals of this suite hardly mean one thing' END) AS alpha_band FROM o CROSS JOIN gap""",
    "diagnoses": f"""
WITH {NAT_T} SELECT item_id, CASE WHEN k = n THEN 'Every model passes ' WHEN k = 0 THEN 'None of ' WHEN verdict = 'backwards' THEN 'The better a model does elsewhere, the more often it fails here '
  WHEN verdict = 'weak' AND r < 0 THEN 'The sign is negative but within noise ' WHEN verdict = 'weak' THEN 'Tells little about a model ' WHEN verdict = 'acceptable' THEN 'Agrees with the other items '
  ELSE 'Agrees closely with the other items ' END AS said FROM judged""",
    "weak_supplier_items": f"WITH {SUP_T} SELECT item_id, round(r, 9) AS r FROM judged WHERE verdict = 'weak'",
    "score_arrays": f"WITH {NAT} SELECT model_idx, model, item_idx, item_id, passed FROM resp",
    "json_items": """
SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS item_idx, n_nationkey::VARCHAR AS item_id, n_name AS prompt, n_regionkey::VARCHAR AS tags,
       concat('{"region":', n_regionkey, '}') AS meta FROM nation""",
    "null_summary": f"""
SELECT round(avg(n), 9) AS null_mean, round(stddev_pop(n), 9) AS null_sd, min(n) AS null_min, max(n) AS null_max, round(avg((n >= 5)::INT), 9) AS p
FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)""",
    "tree_matrix": """
WITH f AS (SELECT DISTINCT (o_custkey % 9)::VARCHAR AS model, (o_orderkey % 40)::VARCHAR AS item_id FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT model, (row_number() OVER (ORDER BY model) - 1)::INT AS model_idx FROM (SELECT DISTINCT model FROM f))
SELECT model_idx, m.model, i::INT AS item_idx, i::VARCHAR AS item_id, (f.model IS NOT NULL)::INT AS passed
FROM m CROSS JOIN (SELECT unnest(range(45)) AS i) LEFT JOIN f ON f.model = m.model AND f.item_id = i::VARCHAR""",
    "demo_grid": """
WITH m AS (SELECT unnest(range(12))::INT AS model_idx, unnest([0.94, 0.91, 0.88, 0.82, 0.78, 0.71, 0.66, 0.59, 0.51, 0.45, 0.36, 0.28])::DOUBLE AS a),
i AS (SELECT k::INT AS item_idx, CASE WHEN k < 12 THEN 'smoke' WHEN k < 17 THEN 'frontier' WHEN k < 37 THEN 'reasoning' ELSE 'format' END AS family,
             k - CASE WHEN k < 12 THEN 0 WHEN k < 17 THEN 12 WHEN k < 37 THEN 17 ELSE 37 END AS no FROM (SELECT unnest(range(40)) AS k))
SELECT model_idx, item_idx, concat(family, '-', no) AS item_id,
       CASE family WHEN 'smoke' THEN 1 WHEN 'frontier' THEN 0 WHEN 'reasoning' THEN (a > 0.25::DOUBLE + 0.03::DOUBLE * no)::INT ELSE (a < 0.6::DOUBLE)::INT END AS passed FROM m CROSS JOIN i""",
    "from_records": f"""
WITH {RECORDS.format(t='VARCHAR')}
SELECT (dense_rank() OVER (ORDER BY first_ord) - 1)::INT AS model_idx, model, item_idx, item_id, passed FROM (
  SELECT model, item_id, item_idx, passed, min(seen) OVER (PARTITION BY model) AS first_ord FROM (
    SELECT r.model, r.item_id, i.item_idx, arg_max(passed, ord) AS passed, min(ord) AS seen FROM records r JOIN items i USING (item_id) GROUP BY ALL))
""",
    "missing_cells": f"""
WITH {RECORDS.format(t='VARCHAR')}, have AS (SELECT DISTINCT model, item_id FROM records WHERE NOT (model = 'toxic' AND ord % 11 = 0)),
gone AS (SELECT m.model, i.item_id, i.item_idx FROM (SELECT DISTINCT model FROM have) m CROSS JOIN items i ANTI JOIN have h ON h.model = m.model AND h.item_id = i.item_id)
SELECT model, count(*) AS n_missing, array_to_string(list(item_id ORDER BY item_idx)[1:5], ',') AS first_missing FROM gone GROUP BY 1""",
    "unknown_items": f"WITH {RECORDS.format(t='VARCHAR')} SELECT model, item_id, ord FROM records WHERE item_id NOT IN (SELECT item_id FROM items WHERE item_idx % 5 <> 0)",
    "duplicate_ids": "SELECT concat(p_brand, '/', p_type) AS item_id, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1",
    "item_json_decode": f"""
WITH e AS (SELECT event_id, {ITEM_JSON}::JSON AS j, props FROM events)
SELECT event_id, j->>'$.id' AS item_id, j->>'$.prompt' AS prompt, array_to_string(CAST(j->'$.tags' AS VARCHAR[]), ',') AS tags,
       len(json_keys(props))::BIGINT AS n_meta, json(props)::VARCHAR AS meta FROM e""",
    "cohort_sweep": f"""
WITH {chain(COHORT_RESP, 'cohort')}{tested('cohort')}{reliability('cohort')},
cnt AS (SELECT cohort, count(*) FILTER (verdict = 'dead') AS dead, count(*) FILTER (k = n) AS dead_all_pass, count(*) FILTER (k = 0) AS dead_none_pass,
               count(*) FILTER (verdict = 'backwards') AS backwards, count(*) FILTER (odd) AS suspicious FROM judged GROUP BY 1)
SELECT cohort, ni AS n_items, nm AS n_models, dead, dead_all_pass, dead_none_pass, backwards, suspicious, nm >= 6 AS detectable,
       round(sem, 9) AS sem, round(real_gap / (ni{D} / 100), 9) AS gap_points FROM cnt JOIN gap USING (cohort)""",
    "trim_rank_agreement": f"WITH {NAT_T} {TRIM.format(name='non-dead', verdicts="('weak', 'acceptable', 'strong')")} UNION ALL {TRIM.format(name='informative', verdicts="('acceptable', 'strong')")}",
    "spearman": f"""
WITH r AS (SELECT row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey) AS a, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS b FROM supplier)
SELECT count(*) AS n, sum((a - b) * (a - b))::BIGINT AS d2, round(1 - 6 * sum((a - b) * (a - b)){D} / (count(*) * (count(*) * count(*) - 1)), 9) AS spearman FROM r""",
    "bootstrap_winners": f"""
WITH {NAT}, sizes AS (SELECT count(DISTINCT item_idx) AS ni FROM resp),
draws AS (SELECT rep, (('0x' || substr(md5(concat(rep, '-', draw)), 1, 8))::BIGINT % ni)::INT AS item_idx
          FROM sizes CROSS JOIN (SELECT unnest(range({RESAMPLES})) AS rep) CROSS JOIN (SELECT unnest(range(10000)) AS draw) WHERE draw < ni),
score AS (SELECT rep, model_idx, sum(passed) AS s FROM draws JOIN resp USING (item_idx) GROUP BY ALL),
best AS (SELECT rep, model_idx FROM score QUALIFY row_number() OVER (PARTITION BY rep ORDER BY s DESC, model_idx) = 1),
wins AS (SELECT model_idx, count(*) AS wins FROM best GROUP BY 1)
SELECT model_idx, model, wins, round(wins{D} / {RESAMPLES}, 9) AS share FROM wins JOIN tot USING (model_idx) ORDER BY wins DESC, model_idx LIMIT 8""",
    "old_rule_backwards": f"WITH {SUP} SELECT count(*) FILTER (rn0 < -0.05{D}) AS old_rule_backwards FROM items_",
    "repo_mode": """
SELECT repo, total FROM (SELECT concat(o_orderpriority, '/x') AS repo, o_custkey % 7 AS total, count(*) AS c FROM orders GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY repo ORDER BY c DESC, total) = 1""",
    "ghost_items": """
WITH b AS (SELECT p_brand, count(*) AS c, max(count(*)) OVER () + 1 AS total FROM part GROUP BY 1)
SELECT concat(p_brand, '/x') AS repo, concat(p_brand, '__x__UNSOLVED-', lpad(k::VARCHAR, greatest(2, length(k::VARCHAR))::INT, '0')) AS item_id
FROM (SELECT p_brand, unnest(range(1, total - c + 1)) AS k FROM b)""",
}
