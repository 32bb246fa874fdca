"""Registered queries: the horizon regression study."""

from __future__ import annotations

from voltloom.catalog.base import query
from voltloom.catalog.life import cycle_frame
from voltloom.catalog.views import VIEWS
from voltloom.plans import horizons
from voltloom.session import staged

VIEWS["hr_rows"] = """
SELECT h AS horizon, a.cell_id, a.cohort, a.cycle, a.x, a.capacity_ah - b.capacity_ah AS y FROM (
  SELECT *, CASE WHEN count(avg_temp) OVER w >= 2 THEN avg(avg_temp) OVER w END AS x FROM fx_cycles
  WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) a, (VALUES (1), (10), (20), (50)) t(h)
JOIN fx_cycles b ON a.cell_id = b.cell_id AND b.cycle = a.cycle + h
WHERE a.x IS NOT NULL AND a.capacity_ah - b.capacity_ah IS NOT NULL AND a.cohort IS NOT NULL"""
VIEWS["hr_left"] = """
SELECT c.horizon, c.cell_id AS held, t.cohort, t.x, t.y, avg(t.x) OVER w AS mx, avg(t.y) OVER w AS my
FROM (SELECT DISTINCT horizon, cell_id FROM hr_rows) c JOIN hr_rows t ON t.horizon = c.horizon AND t.cell_id <> c.cell_id
WINDOW w AS (PARTITION BY c.horizon, c.cell_id, t.cohort)"""
VIEWS["hr_slope"] = """
SELECT horizon, held, sum((x-mx)*(y-my))/sum((x-mx)*(x-mx)) AS slope FROM hr_left GROUP BY horizon, held"""
VIEWS["hr_level"] = "SELECT DISTINCT horizon, held, cohort, mx, my FROM (SELECT horizon, held, cohort, avg(x) AS mx, avg(y) AS my FROM hr_left GROUP BY horizon, held, cohort) a"
VIEWS["hr_all"] = """
SELECT horizon, sum((x-mx)*(y-my))/sum((x-mx)*(x-mx)) AS all_slope FROM (
  SELECT *, avg(x) OVER (PARTITION BY horizon, cohort) AS mx, avg(y) OVER (PARTITION BY horizon, cohort) AS my FROM hr_rows) a GROUP BY horizon"""
VIEWS["hr_scored"] = """
SELECT r.*, s.slope, l.my + s.slope*(r.x - l.mx) AS pred, count(*) OVER (PARTITION BY r.horizon, r.cell_id) AS n, l.my
FROM hr_rows r LEFT JOIN hr_slope s ON s.horizon = r.horizon AND s.held = r.cell_id
LEFT JOIN hr_level l ON l.horizon = r.horizon AND l.held = r.cell_id AND l.cohort = r.cohort"""
VIEWS["hr_ranks"] = """
SELECT *, rank() OVER (PARTITION BY horizon, cell_id ORDER BY round(pred, 10)) + (count(*) OVER (PARTITION BY horizon, cell_id, round(pred, 10)) - 1)/2.0 AS rp,
  rank() OVER (PARTITION BY horizon, cell_id ORDER BY round(y, 10)) + (count(*) OVER (PARTITION BY horizon, cell_id, round(y, 10)) - 1)/2.0 AS ry FROM hr_scored"""
VIEWS["hr_folds"] = """
SELECT f.*, a.all_slope, CASE WHEN refusal = '' THEN mae0 END AS mae, CASE WHEN refusal = '' THEN r20 END AS r2_vs_own_mean,
  CASE WHEN refusal = '' AND isfinite(rho0) THEN rho0 END AS spearman_rho FROM (
  SELECT horizon, cohort, cell_id, count(*) AS n_test, min(slope) AS slope, avg(abs(y-pred)) AS mae0,
    1 - sum((y-pred)*(y-pred))/nullif(var_pop(y)*count(*), 0) AS r20, corr(rp, ry) AS rho0,
    CASE WHEN count(*) < 5 THEN 'too few rows' WHEN min(my) IS NULL THEN 'no other battery of the cohort' ELSE '' END AS refusal
  FROM hr_ranks GROUP BY horizon, cohort, cell_id) f JOIN hr_all a ON a.horizon = f.horizon"""


@query("std_horizon_regression_folds",
       "horizon:i cohort:s cell_id:s n_test:i mae:d6 r2_vs_own_mean:d5 spearman_rho:d5 refusal:s", "SELECT * FROM hr_folds")
def _(spark, sf_dir):
    return horizons.horizon_folds(horizons.horizon_rows(cycle_frame(spark, sf_dir)))


@query("std_horizon_regression",
       "horizon:i n_rows:i n_batteries:i n_cohorts:i temp_coefficient:d8 n_testable:i share_above_own_mean:d6 median_mae:d6 "
       "median_r2_vs_own_mean:d5 median_spearman_rho:d5",
       """SELECT horizon, sum(n_test) AS n_rows, count(*) AS n_batteries, count(DISTINCT cohort) AS n_cohorts, max(all_slope) AS temp_coefficient,
            count(CASE WHEN refusal = '' THEN 1 END) AS n_testable, avg(CASE WHEN r2_vs_own_mean > 0 THEN 1.0 WHEN r2_vs_own_mean <= 0 THEN 0.0 END) AS share_above_own_mean,
            quantile_cont(mae, 0.5) AS median_mae, quantile_cont(r2_vs_own_mean, 0.5) AS median_r2_vs_own_mean,
            quantile_cont(spearman_rho, 0.5) AS median_spearman_rho FROM hr_folds GROUP BY horizon""")
def _(spark, sf_dir):
    return horizons.horizon_summary(staged(horizons.horizon_folds(horizons.horizon_rows(cycle_frame(spark, sf_dir)))))
