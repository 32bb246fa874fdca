"""SQL twins of the cycle-level tables."""

from voltloom.catalog.views import VIEWS

VIEWS["c_ranked"] = """
SELECT *, rank() OVER (PARTITION BY cell_id ORDER BY cycle) + (count(*) OVER (PARTITION BY cell_id, cycle) - 1)/2.0 AS rx,
  rank() OVER (PARTITION BY cell_id ORDER BY capacity_ah) + (count(*) OVER (PARTITION BY cell_id, capacity_ah) - 1)/2.0 AS ry,
  abs(capacity_ah - lag(capacity_ah) OVER (PARTITION BY cell_id ORDER BY cycle)) AS step
FROM fx_cycles
"""
VIEWS["c_ref"] = """
SELECT cell_id, count(*) AS n_cycles, quantile_cont(capacity_ah, 0.95) AS ref, quantile_cont(capacity_ah, 0.5) AS med,
  max(capacity_ah) AS top, quantile_cont(step, 0.5) AS med_step, corr(rx, ry) AS rho
FROM c_ranked GROUP BY cell_id
"""
VIEWS["c_screen"] = """
SELECT *, reason = '' AS admissible FROM (SELECT r.cell_id, r.n_cycles, r.ref AS reference_capacity_ah, r.rho AS capacity_cycle_rho, o.over AS overshoot_fraction,
   med_step/ref AS median_step_fraction, med/ref AS median_soh,
   CASE WHEN n_cycles < 10 THEN 'too_few_cycles' WHEN NOT ref > 0 THEN 'no_reference_capacity'
     WHEN ref/top < 0.02 THEN 'reference_far_below_maximum' WHEN o.over > 0.1 THEN 'overshoot'
     WHEN med_step/ref > 0.05 THEN 'steps_too_large' WHEN med/ref < 0.4 THEN 'median_soh_too_low' ELSE '' END AS reason
 FROM c_ref r JOIN (SELECT c.cell_id, avg(CASE WHEN capacity_ah/ref > 1.05 THEN 1.0 ELSE 0.0 END) AS over
    FROM fx_cycles c JOIN c_ref r ON c.cell_id = r.cell_id GROUP BY c.cell_id) o ON r.cell_id = o.cell_id) s
"""
VIEWS["c_targets"] = """
SELECT *, lead(cumulative_fade, 10) OVER w - cumulative_fade AS horizon_fade_10,
  lead(cumulative_fade, 20) OVER w - cumulative_fade AS horizon_fade_20,
  lead(cumulative_fade, 50) OVER w - cumulative_fade AS horizon_fade_50
FROM (SELECT *, 1 - soh AS cumulative_fade FROM (
  SELECT c.*, s.admissible AS soh_admissible, CASE WHEN s.admissible AND capacity_ah/reference_capacity_ah <= 1.05
     THEN capacity_ah/reference_capacity_ah END AS soh,
   s.admissible AND capacity_ah/reference_capacity_ah > 1.05 AS soh_outlier
  FROM fx_cycles c JOIN c_screen s ON c.cell_id = s.cell_id) a) b
WINDOW w AS (PARTITION BY cell_id ORDER BY cycle)
"""
VIEWS["c_read"] = """
SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS pos FROM c_targets WHERE soh IS NOT NULL
"""
VIEWS["c_smooth"] = """
SELECT *, CASE WHEN count(soh) OVER w >= 3 THEN quantile_cont(soh, 0.5) OVER w END AS soh_smooth
FROM c_read WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
"""
VIEWS["c_eol"] = """
SELECT cell_id, min(cohort) AS cohort, min(CASE WHEN soh_smooth <= 0.9 THEN cycle END) AS true_eol, count(*) AS n,
  min(cycle) AS first_cycle FROM c_smooth GROUP BY cell_id
"""
VIEWS["c_at"] = """
SELECT cell_id, cohort, true_eol, first_cycle, unnest(range(30, CAST(true_eol AS BIGINT), 25)) AS at_c
FROM c_eol WHERE n >= 30 AND true_eol IS NOT NULL
"""
VIEWS["c_hist"] = """
SELECT a.cell_id, a.at_c, r.cycle, CASE WHEN count(soh) OVER w >= 3 THEN quantile_cont(soh, 0.5) OVER w END AS y
FROM c_at a JOIN c_read r ON a.cell_id = r.cell_id AND r.cycle <= a.at_c
WINDOW w AS (PARTITION BY a.cell_id, a.at_c ORDER BY r.cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
"""
VIEWS["c_rul"] = """
SELECT *, CASE WHEN refusal = 'end_of_life_not_ahead' THEN 0 WHEN refusal = '' THEN eol - at_c END AS rul_pred,
  CAST(true_eol - at_c AS DOUBLE) AS rul_true
FROM (SELECT *, CASE WHEN n < 30 THEN 'history_too_short' WHEN NOT coalesce(-m >= 1e-6, false) THEN 'no_measurable_fade'
      WHEN eol <= at_c THEN 'end_of_life_not_ahead' WHEN eol - at_c > 2*(last_cycle - first_cycle) THEN 'extrapolation_too_far'
      ELSE '' END AS refusal
  FROM (SELECT *, (0.9 - b)/nullif(m,0) AS eol FROM (
     SELECT a.cell_id, a.cohort, a.at_c, a.true_eol, a.first_cycle, count(h.y) AS n, max(h.cycle) AS last_cycle,
       regr_slope(h.y, h.cycle) AS m, regr_intercept(h.y, h.cycle) AS b
     FROM c_at a LEFT JOIN c_hist h ON a.cell_id = h.cell_id AND a.at_c = h.at_c
     GROUP BY a.cell_id, a.cohort, a.at_c, a.true_eol, a.first_cycle) f) g) e
"""
