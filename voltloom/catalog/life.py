"""Registered queries: targets, screening, remaining life."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog import life_views  # noqa: F401
from voltloom.catalog.base import query
from voltloom.operators import life
from voltloom.session import staged


def cycle_frame(spark, sf_dir):
    return staged(fixtures.cycles(spark, sf_dir))


def targets(spark, sf_dir):
    return staged(life.add_targets(cycle_frame(spark, sf_dir)))


@query("sta_screen_cells",
       "cell_id:s admissible:b n_cycles:i reference_capacity_ah:d6 overshoot_fraction:d6 "
       "capacity_cycle_rho:d6 median_step_fraction:d6 median_soh:d6 reason:s",
       "SELECT * FROM c_screen")
def _(spark, sf_dir):
    return life.screen_cells(cycle_frame(spark, sf_dir))


@query("win_targets_horizon",
       "cell_id:s cycle:i soh:d6 soh_admissible:b soh_outlier:b cumulative_fade:d6 horizon_fade_10:d6 "
       "horizon_fade_20:d6 horizon_fade_50:d6",
       "SELECT * FROM c_targets")
def _(spark, sf_dir):
    return life.add_targets(cycle_frame(spark, sf_dir))


@query("win_centered_median_smooth", "cell_id:s cycle:i soh_smooth:d6", "SELECT * FROM c_smooth")
def _(spark, sf_dir):
    return life.smoothed(life.soh_readings(targets(spark, sf_dir)))


@query("soh_observed_eol", "cell_id:s true_eol:d0", "SELECT cell_id, true_eol FROM c_eol")
def _(spark, sf_dir):
    return life.observed_eol(life.smoothed(life.soh_readings(targets(spark, sf_dir))))


@query("soh_rul_error_table",
       "cell_id:s cohort:s cycle:d0 rul_pred:d5 rul_true:d5 error:d5 refusal:s",
       """SELECT cell_id, cohort, at_c AS cycle, rul_pred, rul_true, rul_pred - rul_true AS error, refusal FROM c_rul
          UNION ALL SELECT cell_id, cohort, NULL, NULL, NULL, NULL, 'never_crosses' FROM c_eol
          WHERE n >= 30 AND true_eol IS NULL""")
def _(spark, sf_dir):
    return life.rul_error_table(targets(spark, sf_dir))


@query("soh_estimate_rul", "cell_id:s at_cycle:i rul_cycles:d5 eol_cycle:d5 n_history:i refusal:s",
       """SELECT cell_id, last_cycle AS at_cycle, n AS n_history, refusal,
            CASE WHEN n >= 30 AND refusal <> 'no_measurable_fade' THEN eol END AS eol_cycle,
            CASE WHEN refusal = 'end_of_life_not_ahead' THEN 0 WHEN refusal = '' THEN eol - last_cycle END AS rul_cycles
          FROM (SELECT *, CASE WHEN n < 30 THEN 'history_too_short' WHEN NOT coalesce(-m >= 1e-6, false) THEN 'no_measurable_fade'
               WHEN eol <= last_cycle THEN 'end_of_life_not_ahead'
               WHEN eol - last_cycle > 2*(last_cycle - first_cycle) THEN 'extrapolation_too_far' ELSE '' END AS refusal
            FROM (SELECT *, (0.9 - b)/nullif(m,0) AS eol FROM (
              SELECT cell_id, count(y) AS n, max(cycle) AS last_cycle, min(cycle) AS first_cycle, regr_slope(y, cycle) AS m,
                regr_intercept(y, cycle) AS b
              FROM (SELECT *, CASE WHEN count(soh) OVER w >= 3 THEN quantile_cont(soh, 0.5) OVER w END AS y
                 FROM (SELECT c.cell_id, c.cycle, c.capacity_ah/r.ref0 AS soh FROM fx_cycles c JOIN (
                    SELECT cell_id, quantile_cont(capacity_ah, 0.5) AS ref0 FROM (
                      SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM fx_cycles) q
                    WHERE k <= 5 GROUP BY cell_id) r ON c.cell_id = r.cell_id) s
                 WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) h
              GROUP BY cell_id) f) g) e""")
def _(spark, sf_dir):
    return life.rul_now(cycle_frame(spark, sf_dir))


@query("agg_ground_truth_fade",
       "cell_id:s initial_capacity_ah:d6 n_cycles:i fade_rate:d9 r_squared:d6 eol_cycle:d0 reached_eol:b",
       """SELECT c.cell_id, i.c0 AS initial_capacity_ah, count(*) AS n_cycles, -regr_slope(capacity_ah, cycle) AS fade_rate,
          regr_r2(capacity_ah, cycle) AS r_squared, min(CASE WHEN capacity_ah <= 0.8*i.c0 THEN cycle END) AS eol_cycle,
          min(CASE WHEN capacity_ah <= 0.8*i.c0 THEN cycle END) IS NOT NULL AS reached_eol
          FROM fx_cycles c JOIN (SELECT cell_id, avg(capacity_ah) AS c0 FROM (
             SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM fx_cycles) q WHERE k <= 3 GROUP BY cell_id) i
          ON c.cell_id = i.cell_id GROUP BY c.cell_id, i.c0 HAVING count(*) >= 5""")
def _(spark, sf_dir):
    return life.ground_truth_fade(cycle_frame(spark, sf_dir))


@query("set_dedupe_capacity", "cell_id:s n:i",
       "SELECT cell_id, count(*) AS n FROM (SELECT DISTINCT cell_id, cycle, capacity_ah FROM fx_cycles) d GROUP BY cell_id")
def _(spark, sf_dir):
    frame = cycle_frame(spark, sf_dir)
    twice = frame.unionByName(frame).select("cell_id", "cycle", "capacity_ah").dropDuplicates()
    return twice.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_initial_capacity_and_loss", "cell_id:s cycle:i initial_capacity_ah:d6 capacity_loss_ah:d6 soh_pct:d6",
       """SELECT c.cell_id, c.cycle, i.c0 AS initial_capacity_ah, i.c0 - capacity_ah AS capacity_loss_ah, 100*capacity_ah/i.c0 AS soh_pct
          FROM fx_cycles c JOIN (SELECT cell_id, quantile_cont(capacity_ah, 0.5) AS c0 FROM (
             SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM fx_cycles) q WHERE k <= 5 GROUP BY cell_id) i
          ON c.cell_id = i.cell_id""")
def _(spark, sf_dir):
    return life.initial_capacity_and_loss(cycle_frame(spark, sf_dir))


@query("win_trailing_features",
       "cell_id:s cycle:i trailing_avg_temp:d6 trailing_avg_stress:d6 capacity_loss:d6",
       """SELECT cell_id, cycle, CASE WHEN count(avg_temp) OVER w >= 2 THEN avg(avg_temp) OVER w END AS trailing_avg_temp,
          CASE WHEN count(avg_stress) OVER w >= 2 THEN avg(avg_stress) OVER w END AS trailing_avg_stress,
          -(capacity_ah - lag(capacity_ah) OVER (PARTITION BY cell_id ORDER BY cycle)) AS capacity_loss
          FROM fx_cycles WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf_dir):
    return life.trailing_features(cycle_frame(spark, sf_dir), ("avg_temp", "avg_stress"))


@query("jn_horizon_self_join", "cell_id:s cycle:i capacity_loss_h:d6",
       """SELECT a.cell_id, a.cycle, a.capacity_ah - b.capacity_ah AS capacity_loss_h FROM fx_cycles a
          JOIN fx_cycles b ON a.cell_id = b.cell_id AND b.cycle = a.cycle + 10""")
def _(spark, sf_dir):
    return life.horizon_pairs(cycle_frame(spark, sf_dir), 10)


@query("soh_capacity_loss_linear", "cell_id:s cycle:i capacity_loss_predicted:d8",
       """SELECT c.cell_id, c.cycle, CAST(-0.0209 AS DOUBLE) + coalesce(a.adjustment, (SELECT avg(adjustment) FROM adj))
            + CAST(0.0038 AS DOUBLE)*c.trailing_avg_temp AS capacity_loss_predicted
          FROM (SELECT *, avg(avg_temp) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS trailing_avg_temp,
                  count(avg_temp) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS k
                FROM fx_cycles) c LEFT JOIN adj a ON c.cohort = a.cohort WHERE k >= 2""",
       {"adj": """SELECT cohort, (avg(avg_temp) - 40)/1000.0 AS adjustment FROM fx_cycles
                  WHERE cohort <> 'COHORT_4' GROUP BY cohort"""})
def _(spark, sf_dir):
    frame = cycle_frame(spark, sf_dir)
    adjustments = frame.where("cohort <> 'COHORT_4'").groupBy("cohort").agg(
        ((F.avg("avg_temp") - 40) / 1000.0).alias("adjustment"))
    trailing = life.trailing_features(frame, ("avg_temp",)).where("trailing_avg_temp IS NOT NULL")
    return life.predicted_loss(trailing, adjustments)
