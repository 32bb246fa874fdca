"""Registered queries: charges, learned windows, full discharges, priors, bands, studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.base import query
from voltloom.catalog.duty_views import screened_sql, soh_views, window_sql
from voltloom.catalog.life import cycle_frame, targets
from voltloom.catalog.sequence import _charges, duty_log, gated_table
from voltloom.catalog.views import VIEWS
from voltloom.operators import curves, incremental, life, partial, phases, priors, soh, twin
from voltloom.plans import studies
from voltloom.session import staged

# -- charge phases ----------------------------------------------------------
VIEWS["h_chg"] = "SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY phase_no) AS cycle FROM d_phases WHERE kind = 'charge'"
VIEWS["h_step"] = """
SELECT c.cell_id, c.cycle, c.phase_no, CASE WHEN quiet AND abs(i0-i_prev) >= 0.05 AND v0 - v_prev > 0 THEN (v0-v_prev)/abs(i0-i_prev) END AS r_step_ohm
FROM (SELECT d.*, f.v0, f.i0, f.v_prev, f.i_prev, f.t_prev IS NOT NULL
        AND abs(f.i_prev) <= greatest(CAST(0.5 AS DOUBLE), CAST(0.05 AS DOUBLE)*abs(f.i0)) AND f.t0 - f.t_prev <= 60 AS quiet
      FROM h_chg d JOIN (SELECT cell_id, test_time_s AS t0, voltage_v AS v0, current_a AS i0, lag(test_time_s) OVER w AS t_prev,
            lag(voltage_v) OVER w AS v_prev, lag(current_a) OVER w AS i_prev FROM fx_duty WINDOW w AS (PARTITION BY cell_id ORDER BY test_time_s)) f
      ON d.cell_id = f.cell_id AND d.start_time_s = f.t0 WHERE d.n_samples >= 2) c"""
VIEWS["h_scr"] = screened_sql("h_step")
VIEWS["h_trail"] = """
SELECT *, last_value(med IGNORE NULLS) OVER (PARTITION BY cell_id ORDER BY cycle ROWS UNBOUNDED PRECEDING) AS r_trailing_ohm
FROM (SELECT *, quantile_cont(r_ok_ohm, 0.5) OVER (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS med FROM h_scr) a"""
VIEWS["h_curve"] = """
SELECT s.cell_id, d.cycle, s.test_time_s, s.voltage_v, s.current_a, sum(a.step_q) OVER (PARTITION BY s.cell_id, s.phase_no ORDER BY s.test_time_s) AS capacity_ah_curve
FROM d_samples s JOIN d_steps_ah a ON s.cell_id = a.cell_id AND s.test_time_s = a.test_time_s JOIN h_chg d ON s.cell_id = d.cell_id AND s.phase_no = d.phase_no"""
VIEWS["h_shift"] = """
SELECT c.*, t.r_trailing_ohm * i.i AS rise FROM h_curve c JOIN h_trail t ON c.cell_id = t.cell_id AND c.cycle = t.cycle
JOIN (SELECT cell_id, cycle, quantile_cont(abs(current_a), 0.5) AS i FROM h_curve GROUP BY cell_id, cycle) i ON c.cell_id = i.cell_id AND c.cycle = i.cycle
WHERE t.r_trailing_ohm IS NOT NULL"""
VIEWS["h_charge"] = window_sql("h_shift", "CAST(3.75 AS DOUBLE)+rise", "CAST(4.0 AS DOUBLE)+rise")
VIEWS["h_read"] = """
SELECT t.cell_id, t.cycle, t.r_step_ohm, t.r_trailing_ohm, w.window_charge_ah FROM h_trail t LEFT JOIN h_charge w ON t.cell_id = w.cell_id AND t.cycle = w.cycle"""
VIEWS["h_soh"] = """
SELECT *, CASE WHEN n > 5 AND window_charge_ah/ref BETWEEN 0.5 AND 1.1 THEN window_charge_ah/ref END AS soh FROM (
 SELECT r.*, count(window_charge_ah) OVER (PARTITION BY r.cell_id) AS n, f.ref FROM h_read r LEFT JOIN (
   SELECT cell_id, quantile_cont(window_charge_ah, 0.5) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k
     FROM h_read WHERE window_charge_ah IS NOT NULL) q WHERE k <= 5 GROUP BY cell_id) f ON r.cell_id = f.cell_id) z"""


@query("seg_charge_phase_readings", "cell_id:s cycle:i r_step_ohm:d6 r_trailing_ohm:d6 window_charge_ah:d6", "SELECT * FROM h_read")
def _(spark, sf_dir):
    return partial.charge_readings(phases.segment(duty_log(spark, sf_dir)))


@query("soh_charge_soh_table", "cell_id:s cycle:i soh:d6", "SELECT * FROM h_soh")
def _(spark, sf_dir):
    return partial.charge_soh(staged(partial.charge_readings(phases.segment(duty_log(spark, sf_dir)))))


# -- learned window ---------------------------------------------------------
VIEWS["e_cyc"] = "SELECT cell_id, cycle FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM (SELECT DISTINCT cell_id, cycle FROM d_curve) a) b WHERE k <= 10"
VIEWS["e_cur"] = """
SELECT c.*, row_number() OVER (PARTITION BY c.cell_id, c.cycle ORDER BY test_time_s) AS p, count(*) OVER (PARTITION BY c.cell_id, c.cycle) AS np
FROM d_curve c JOIN e_cyc e ON c.cell_id = e.cell_id AND c.cycle = e.cycle"""
VIEWS["e_band"] = """
SELECT *, band_high - 0.15*(band_high-band_low) AS uh, band_low + 0.15*(band_high-band_low) AS ul,
  least(0.3, (band_high - 0.15*(band_high-band_low)) - (band_low + 0.15*(band_high-band_low))) AS span FROM (
  SELECT cell_id, count(*) AS n_early, min(top) AS band_high, max(bottom) AS band_low FROM (
    SELECT cell_id, cycle, max(voltage_v) FILTER (p > 2 OR np <= 4) AS top, min(voltage_v) AS bottom FROM e_cur GROUP BY cell_id, cycle) x GROUP BY cell_id) y"""
VIEWS["e_try"] = """
SELECT cell_id, k, round(ul + k*CAST(0.01 AS DOUBLE), 3) AS vl, round(ul + k*CAST(0.01 AS DOUBLE) + span, 3) AS vh FROM (
  SELECT *, unnest(range(0, greatest(CAST(floor((uh - span + 1e-9 - ul)/0.01) AS BIGINT), 0) + 1)) AS k FROM e_band WHERE n_early >= 10 AND span >= 0.1) z"""
VIEWS["e_all"] = "SELECT c.*, t.k, t.vl, t.vh FROM e_cur c JOIN e_try t ON c.cell_id = t.cell_id"
VIEWS["e_q"] = window_sql("e_all", "vl", "vh", "cell_id, cycle, k")
VIEWS["e_best"] = """
SELECT cell_id, min_by(struct_pack(vl := vl, vh := vh, s := s), struct_pack(s := s, k := k)) AS b FROM (
  SELECT cell_id, k, min(lo) AS vl, min(hi) AS vh, quantile_cont((hi-lo)/(window_charge_ah/0.4), 0.5) AS s FROM e_q WHERE window_charge_ah > 0 GROUP BY cell_id, k) a GROUP BY cell_id"""
VIEWS["e_win"] = """
SELECT d.cell_id, d.n_early, d.band_high, d.band_low, b.s AS steepness, CASE WHEN n_early >= 10 AND span >= 0.1 AND b.s BETWEEN 0.4 AND 2.0 THEN b.vl END AS v_low,
  CASE WHEN n_early >= 10 AND span >= 0.1 AND b.s BETWEEN 0.4 AND 2.0 THEN b.vh END AS v_high FROM e_band d LEFT JOIN e_best e ON d.cell_id = e.cell_id"""


@query("seg_learn_usage_window", "cell_id:s n_early:i band_high:d6 band_low:d6 steepness:d5 v_low:d3 v_high:d3", "SELECT * FROM e_win")
def _(spark, sf_dir):
    return partial.learn_window(staged(curves.discharge_curves(phases.segment(duty_log(spark, sf_dir)))), 0.4)


VIEWS["f_shift"] = """
SELECT c.*, t.ir_drop_v, t.r_trailing_ohm, w.v_low + r.ref AS vl, w.v_high + r.ref AS vh FROM d_curve c JOIN d_trail t ON c.cell_id = t.cell_id AND c.cycle = t.cycle
JOIN e_win w ON c.cell_id = w.cell_id JOIN (SELECT cell_id, quantile_cont(ir_drop_v, 0.5) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k
  FROM d_trail WHERE ir_drop_v IS NOT NULL) q WHERE k <= 10 GROUP BY cell_id) r ON c.cell_id = r.cell_id WHERE t.ir_drop_v IS NOT NULL AND w.v_low IS NOT NULL"""
VIEWS["f_charge"] = window_sql("f_shift", "vl-ir_drop_v", "vh-ir_drop_v", extra=", min(ir_drop_v) AS ir_drop_v, min(r_trailing_ohm) AS r_trailing_ohm")
VIEWS.update(soh_views("f", "f_charge", "d_dis"))


@query("soh_learned_field_soh", "cell_id:s cycle:i window_charge_ah:d6 soh_window_accepted:d6 cell_refused:b", "SELECT * FROM f_gated")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    lines = staged(curves.discharge_curves(cut))
    charges = staged(partial.learned_charges(lines, curves.discharge_steps(cut), staged(partial.learn_window(lines, 0.4))))
    return soh.field_gates(soh.soh_table(charges), staged(cut.discharges))


# -- full discharges and curve change ---------------------------------------
VIEWS["u_dis"] = """
SELECT d.cell_id, d.cycle, d.charge_ah, d.n_samples, min(s.voltage_v) AS min_v FROM d_dis d JOIN d_samples s ON d.cell_id = s.cell_id AND d.phase_no = s.phase_no
WHERE d.n_samples >= 5 GROUP BY d.cell_id, d.cycle, d.charge_ah, d.n_samples"""
VIEWS["u_cut"] = """
SELECT cell_id, quantile_cont(min_v, 0.5) AS cutoff_v FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY min_v, cycle) AS k, count(*) OVER (PARTITION BY cell_id) AS n
  FROM u_dis WHERE min_v >= 1.5) q WHERE k <= greatest(5, ceil(n*CAST(0.005 AS DOUBLE))) GROUP BY cell_id"""
VIEWS["u_g"] = "SELECT d.*, c.cutoff_v, d.min_v <= c.cutoff_v + 0.1 AS reaches FROM u_dis d JOIN u_cut c ON d.cell_id = c.cell_id"
VIEWS["u_cap"] = "SELECT cell_id, coalesce(quantile_cont(CASE WHEN reaches THEN charge_ah END, 0.99), quantile_cont(charge_ah, 0.99)) AS cap, max(charge_ah) AS top FROM u_g GROUP BY cell_id"


@query("seg_detect_full_discharges", "cell_id:s cycle:i cutoff_v:d6 capability_ah:d6 reaches_cutoff:b is_full:b",
       "SELECT g.cell_id, g.cycle, cutoff_v, cap AS capability_ah, reaches AS reaches_cutoff, reaches AND charge_ah >= 0.8*cap AND charge_ah > 0 AND NOT cap/top < 0.2 AS is_full FROM u_g g JOIN u_cap c ON g.cell_id = c.cell_id")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    low = phases.with_phase(cut, "discharge").groupBy("cell_id", "phase_no").agg(F.min("voltage_v").alias("min_voltage_v"))
    return partial.full_discharges(cut.discharges.join(low, ["cell_id", "phase_no"]))


VIEWS["q_seg"] = """
SELECT *, lead(voltage_v) OVER w AS v1, lead(capacity_ah_curve) OVER w AS q1 FROM d_curve WHERE cycle IN (2, 12) WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY voltage_v, test_time_s)"""
VIEWS["q_grid"] = """
SELECT s.cell_id, s.cycle, g.g, max(capacity_ah_curve + (q1-capacity_ah_curve)*((2.0+g.g*(2.2/999) - voltage_v)/(v1-voltage_v))) AS q
FROM q_seg s JOIN (SELECT unnest(range(0,1000)) AS g) g ON 2.0 + g.g*(2.2/999) BETWEEN s.voltage_v AND s.v1 WHERE v1 > voltage_v GROUP BY s.cell_id, s.cycle, g.g"""


@query("seg_delta_q_variance", "cell_id:s n_grid:i delta_q_log_variance:d5",
       """SELECT cell_id, count(d) AS n_grid, CASE WHEN count(d) >= 50 AND var_pop(d) > 0 THEN log10(var_pop(d)) END AS delta_q_log_variance FROM (
          SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, b.q - a.q AS d FROM (SELECT * FROM q_grid WHERE cycle = 2) a FULL JOIN (SELECT * FROM q_grid WHERE cycle = 12) b
            ON a.cell_id = b.cell_id AND a.g = b.g) z GROUP BY cell_id""")
def _(spark, sf_dir):
    lines = curves.discharge_curves(phases.segment(duty_log(spark, sf_dir)))
    return partial.delta_q_variance(lines, 2, 12)


# The cubic that fits 51 points best, by orthogonal polynomials of the place in the window.
VIEWS["i_at"] = """
SELECT cell_id, cycle, g, q, g - min(g) OVER w AS i, count(*) OVER w AS n, min(g) OVER w AS g0 FROM q_grid WINDOW w AS (PARTITION BY cell_id, cycle)"""
VIEWS["i_norm"] = "SELECT sum(k*k) AS s2, sum(k*k*k*k) AS s4, count(*) AS s0 FROM (SELECT CAST(unnest(range(-25, 26)) AS DOUBLE) AS k) r"
VIEWS["i_poly"] = """
SELECT k, k*k - s2/s0 AS p2, k*k*k - s4/s2*k AS p3, s0, s2, sum(pow(k*k - s2/s0, 2)) OVER () AS n2, sum(pow(k*k*k - s4/s2*k, 2)) OVER () AS n3
FROM (SELECT CAST(unnest(range(-25, 26)) AS DOUBLE) AS k) r, i_norm"""
VIEWS["i_smooth"] = """
SELECT a.cell_id, a.cycle, a.i, min(a.n) AS n, min(a.g0) AS g0, sum(b.q*(1/s0 + k*r/s2 + p2*(r*r - s2/s0)/n2 + p3*(r*r*r - s4*r/s2)/n3)) AS y
FROM (SELECT *, greatest(0, least(i - 25, n - 51)) AS start, CAST(i - greatest(0, least(i - 25, n - 51)) - 25 AS DOUBLE) AS r FROM i_at WHERE n >= 51) a
JOIN i_at b ON a.cell_id = b.cell_id AND a.cycle = b.cycle AND b.i BETWEEN a.start AND a.start + 50
JOIN (SELECT p.*, m.s4 FROM i_poly p, i_norm m) z ON z.k = b.i - a.start - 25 GROUP BY a.cell_id, a.cycle, a.i"""
VIEWS["i_slope"] = """
SELECT *, (coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y)) / (CASE WHEN i = 0 OR i = n - 1 THEN 1 ELSE 2 END * (CAST(2.2 AS DOUBLE)/999)) AS d
FROM i_smooth WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY i)"""


@query("seg_ica_peak_features", "cell_id:s cycle:i n_grid:i ica_peak_height:d5 ica_peak_voltage:d5 ica_area:d5",
       """SELECT c.cell_id, c.cycle, c.n_grid, s.d AS ica_peak_height, s.v AS ica_peak_voltage, a.area AS ica_area FROM (SELECT cell_id, cycle, count(*) AS n_grid FROM q_grid GROUP BY cell_id, cycle) c
          LEFT JOIN (SELECT *, 2.0 + (g0 + i)*(CAST(2.2 AS DOUBLE)/999) AS v, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY round(abs(d), 9) DESC, i) AS k FROM i_slope) s
            ON c.cell_id = s.cell_id AND c.cycle = s.cycle AND s.k = 1
          LEFT JOIN (SELECT cell_id, cycle, sum((abs(d) + abs(d1))/2)*(CAST(2.2 AS DOUBLE)/999) AS area FROM (
            SELECT *, lead(d) OVER (PARTITION BY cell_id, cycle ORDER BY i) AS d1 FROM i_slope) z WHERE d1 IS NOT NULL GROUP BY cell_id, cycle) a
            ON c.cell_id = a.cell_id AND c.cycle = a.cycle""")
def _(spark, sf_dir):
    lines = curves.discharge_curves(phases.segment(duty_log(spark, sf_dir)))
    return incremental.peak_features(incremental.incremental_capacity(lines, (2, 12)))


# -- battery memory ---------------------------------------------------------
@query("str_battery_memory_query", "cell_id:s soh:d6 n_accepted:i n_discharges:i",
       "SELECT * FROM s_report")
def _(spark, sf_dir):
    """SOH from the stored discharge table alone equals the whole-log answer."""
    discharges, table = gated_table(spark, sf_dir)
    memory = staged(table.select("cell_id", "cycle", "window_charge_ah", "cycle_charge_ah", "r_trailing_ohm"))
    return soh.current_soh(staged(soh.field_gates(soh.soh_table(memory), discharges)), discharges)


@query("soh_per_cell_fit", "cell_id:s n:i slope:d5 bias:d5 mae:d6 spread_soh:d6",
       """SELECT cell_id, n, CASE WHEN ok THEN m END AS slope, CASE WHEN ok THEN b END AS bias, CASE WHEN ok THEN e END AS mae, CASE WHEN ok THEN sp END AS spread_soh FROM (
          SELECT *, n >= 10 AND sp > 0 AS ok FROM (SELECT s.cell_id, count(t.truth) AS n, regr_slope(soh_window, truth) AS m, regr_intercept(soh_window, truth) AS b,
            avg(abs(soh_window-truth)) AS e, max(CASE WHEN soh_window IS NOT NULL THEN truth END) - min(CASE WHEN soh_window IS NOT NULL THEN truth END) AS sp
          FROM s_t1 s JOIN (SELECT cell_id, cycle, charge_ah/largest - 0.002*cycle AS truth FROM d_dis) t ON s.cell_id = t.cell_id AND s.cycle = t.cycle
          WHERE soh_window IS NOT NULL GROUP BY s.cell_id) a) b""")
def _(spark, sf_dir):
    cut, charges = _charges(spark, sf_dir)
    d = staged(cut.discharges)
    top = d.groupBy("cell_id").agg(F.max("charge_ah").alias("_l"))
    truth = d.join(top, "cell_id").select("cell_id", "cycle", (F.col("charge_ah") / F.col("_l") - 0.002 * F.col("cycle")).alias("soh"))
    return soh.per_cell_fit(soh.soh_table(charges).where("soh_window IS NOT NULL").join(truth, ["cell_id", "cycle"]))


@query("soh_resistance_health", "cell_id:s resistance_growth:d6 resistance_health:d6",
       "SELECT cell_id, resistance_growth, 1/resistance_growth AS resistance_health FROM s_report")
def _(spark, sf_dir):
    discharges, table = gated_table(spark, sf_dir)
    return soh.current_soh(table, discharges).withColumn("resistance_health", 1.0 / F.col("resistance_growth"))


# Ten suppliers' cells as one long-lived cell: some hundred discharges each.
VIEWS["d_long"] = """
SELECT 'PACK_' || (CAST(substr(cell_id, 6) AS INT) % 10) AS cell_id, r_step_ohm,
  cycle * 1000000 + CAST(substr(cell_id, 6) AS INT) AS cycle FROM d_step"""


@query("std_resistance_study", "cell_id:s r_first:d6 r_last:d6 growth:d6",
       """SELECT a.cell_id, r_first, r_last, r_last/r_first AS growth FROM (SELECT cell_id, quantile_cont(r_step_ohm, 0.5) FILTER (u <= 25) AS r_first,
          quantile_cont(r_step_ohm, 0.5) FILTER (w <= 25) AS r_last FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS u,
          row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS w FROM d_long WHERE r_step_ohm IS NOT NULL) q GROUP BY cell_id) a""")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    number = F.substring("cell_id", 6, 20).cast("int")
    steps = curves.step_resistance(cut.discharges, 0.5).select(
        F.concat(F.lit("PACK_"), (number % 10).cast("string")).alias("cell_id"), "r_step_ohm",
        (F.col("cycle").cast("bigint") * 1_000_000 + number).alias("cycle"))
    return studies.resistance_growth(staged(steps))


@query("std_window_agreement_study", "cell_id:s n_rows:i n_both:i n_flagged:i mean_gap:d6",
       """SELECT cell_id, count(*) AS n_rows, count(g) AS n_both, count(CASE WHEN g > 0.02 THEN 1 END) AS n_flagged, avg(g) AS mean_gap FROM (
          SELECT coalesce(s.cell_id, f.cell_id) AS cell_id, abs(s.soh_window - f.soh_window) AS g FROM s_t1 s FULL JOIN f_t1 f ON s.cell_id = f.cell_id AND s.cycle = f.cycle) z GROUP BY cell_id""")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    lines, drops = staged(curves.discharge_curves(cut)), curves.discharge_steps(cut)
    one = soh.soh_table(staged(curves.charges_by_cycle(lines, drops)))
    two = soh.soh_table(staged(partial.learned_charges(lines, drops, staged(partial.learn_window(lines, 0.4)))))
    return studies.window_agreement(one, two)


# -- priors, bands, studies -------------------------------------------------
VIEWS["p_x"] = """
SELECT r.cell_id, r.cycle - m.c0 AS x, 1 - soh AS f FROM c_read r JOIN (SELECT cell_id, min(cycle) AS c0, count(*) AS n, min(CASE WHEN soh <= 0.9 THEN cycle END) AS cross_c
  FROM c_read GROUP BY cell_id) m ON r.cell_id = m.cell_id WHERE n >= 5 AND (cross_c IS NULL OR r.cycle <= cross_c)"""
VIEWS["p_rate"] = "SELECT cell_id, CASE WHEN sum(x*f)/sum(x*x) > 0 THEN sum(x*f)/sum(x*x) END AS fade_rate FROM p_x GROUP BY cell_id"
VIEWS["p_prior"] = "SELECT count(*) AS n_cells, avg(ln(fade_rate)) AS log_mean, greatest(stddev_samp(ln(fade_rate)), 0.25) AS log_sd FROM p_rate WHERE fade_rate > 0"


def _readings(spark, sf_dir):
    return staged(targets(spark, sf_dir).select("cell_id", "cohort", "cycle", "soh").where("soh IS NOT NULL"))


@query("soh_fade_rate_prior", "n_cells:i log_mean:d6 log_sd:d6", "SELECT * FROM p_prior")
def _(spark, sf_dir):
    return priors.fade_prior(priors.fade_rates(_readings(spark, sf_dir)))


VIEWS["p_h"] = "SELECT cell_id, cycle, soh, cycle - min(cycle) OVER (PARTITION BY cell_id) AS dx FROM c_read WHERE cycle <= 40"
VIEWS["p_s"] = """
SELECT a.*, CASE WHEN n < 10 THEN 0.01 ELSE greatest(1.4826*mad, 0.005) END AS sigma FROM (SELECT cell_id, count(*) AS n, sum((1-soh)*(1-soh)) AS ff, sum(dx*(1-soh)) AS xf, sum(CAST(dx*dx AS DOUBLE)) AS xx, min(cycle) AS x0 FROM p_h GROUP BY cell_id) a
JOIN (SELECT cell_id, quantile_cont(abs(r - mid), 0.5) AS mad FROM (SELECT *, quantile_cont(r, 0.5) OVER (PARTITION BY cell_id) AS mid FROM (
   SELECT h.cell_id, soh - (b + m*dx) AS r FROM p_h h JOIN (SELECT cell_id, regr_slope(soh, dx) AS m, regr_intercept(soh, dx) AS b FROM p_h GROUP BY cell_id) f ON h.cell_id = f.cell_id) q) w GROUP BY cell_id) z ON a.cell_id = z.cell_id"""
VIEWS["p_g"] = """
SELECT cell_id, n, sigma, i, -0.5*pow((lk - log_mean)/log_sd, 2) - 0.5*(ff - 2*exp(lk)*xf + exp(lk)*exp(lk)*xx)/(sigma*sigma) AS lp, greatest(0.1/exp(lk) - (40 - x0), 0) AS rul
FROM (SELECT s.*, p.log_mean, p.log_sd, g.i, p.log_mean - 5*p.log_sd + g.i*(10*p.log_sd/800) AS lk FROM p_s s, p_prior p, (SELECT unnest(range(0, 801)) AS i) g) z"""
VIEWS["p_w"] = "SELECT *, exp(lp - max(lp) OVER (PARTITION BY cell_id)) AS w FROM p_g"
VIEWS["p_c"] = "SELECT *, sum(w) OVER (PARTITION BY cell_id ORDER BY i DESC) / sum(w) OVER (PARTITION BY cell_id) AS cdf FROM p_w"


@query("soh_posterior_rul", "cell_id:s n_readings:i median:d4 lower:d4 upper:d4 sigma:d6",
       "SELECT cell_id, min(n) AS n_readings, min(sigma) AS sigma, min(rul) FILTER (cdf >= 0.5 - 1e-12) AS median, min(rul) FILTER (cdf >= 0.1 - 1e-12) AS lower, min(rul) FILTER (cdf >= 0.9 - 1e-12) AS upper FROM p_c GROUP BY cell_id")
def _(spark, sf_dir):
    rows = _readings(spark, sf_dir)
    prior = staged(priors.fade_prior(priors.fade_rates(rows)))
    return priors.posterior_rul(rows.where("cycle <= 40").withColumn("at_cycle", F.lit(40)), prior)


@query("soh_life_curve_prior", "cell_id:s life:d3 shape:d3",
       """SELECT cell_id, pow(0.1/b.c, 1/b.p) AS life, b.p AS shape FROM (SELECT cell_id, min_by(struct_pack(c := c, p := p), struct_pack(s := sse, p := p)) AS b FROM (
          SELECT cell_id, p, xf/xx AS c, ff - xf*xf/xx AS sse FROM (SELECT cell_id, p, sum(f*f) AS ff, sum(pow(CAST(x AS DOUBLE),p)*f) AS xf, sum(pow(CAST(x AS DOUBLE),p)*pow(CAST(x AS DOUBLE),p)) AS xx
            FROM p_x, (SELECT round(CAST(0.3 AS DOUBLE) + unnest(range(0,55))*CAST(0.05 AS DOUBLE), 10) AS p) g GROUP BY cell_id, p) s WHERE xx > 0 AND xf > 0) t GROUP BY cell_id) u""")
def _(spark, sf_dir):
    return priors.life_curves(_readings(spark, sf_dir))


VIEWS["l_curve"] = """
SELECT cell_id, pow(0.1/b.c, 1/b.p) AS life, b.p AS shape FROM (SELECT cell_id, min_by(struct_pack(c := c, p := p), struct_pack(s := sse, p := p)) AS b FROM (
  SELECT cell_id, p, xf/xx AS c, ff - xf*xf/xx AS sse FROM (SELECT cell_id, p, sum(f*f) AS ff, sum(pow(CAST(x AS DOUBLE),p)*f) AS xf, sum(pow(CAST(x AS DOUBLE),p)*pow(CAST(x AS DOUBLE),p)) AS xx
    FROM p_x, (SELECT round(CAST(0.3 AS DOUBLE) + unnest(range(0,55))*CAST(0.05 AS DOUBLE), 10) AS p) g GROUP BY cell_id, p) s WHERE xx > 0 AND xf > 0) t GROUP BY cell_id) u"""
VIEWS["l_prior"] = """
SELECT count(*) AS n_cells, avg(ln(life)) AS lm, greatest(stddev_samp(ln(life)), 0.25) AS ls, avg(shape) AS pm, greatest(stddev_samp(shape), 0.2) AS ps FROM l_curve WHERE life > 0"""


@query("soh_life_prior", "n_cells:i log_life_mean:d6 log_life_sd:d6 shape_mean:d6 shape_sd:d6",
       "SELECT n_cells, lm AS log_life_mean, ls AS log_life_sd, pm AS shape_mean, ps AS shape_sd FROM l_prior")
def _(spark, sf_dir):
    return priors.life_prior(priors.life_curves(_readings(spark, sf_dir)))


def _grid_sql(points: str, sums: str) -> str:
    """Life by shape for each cell: points has l0, ls_, p0, ps_, ff; sums has a and b for each j."""
    return f"""
SELECT *, ff - 2*c*a + c*c*b AS sse, -0.5*pow((ll-lm)/ls, 2) - 0.5*pow((sh-pm)/ps, 2) AS lprior FROM (
  SELECT *, CAST(0.1 AS DOUBLE)*exp(-sh*ll) AS c FROM (SELECT t.*, s.j, s.a, s.b, g.i, t.l0 + g.i*t.lstep AS ll, t.p0 + s.j*t.pstep AS sh
    FROM {points} t JOIN {sums} s ON t.cell_id = s.cell_id, (SELECT unnest(range(0, 241)) AS i) g) x) y, l_prior"""


def _sums_sql(points: str) -> str:
    return f"""
SELECT h.cell_id, j, sum(pow(CAST(dx AS DOUBLE), p0 + j*pstep)*(1-soh)) AS a, sum(pow(pow(CAST(dx AS DOUBLE), p0 + j*pstep), 2)) AS b
FROM p_h h JOIN {points} t ON h.cell_id = t.cell_id, (SELECT unnest(range(0, 55)) AS j) g GROUP BY h.cell_id, j"""


VIEWS["l_p1"] = """
SELECT h.*, lm - 5*ls AS l0, 10*ls/240 AS lstep, CAST(0.3 AS DOUBLE) AS p0, CAST(0.05 AS DOUBLE) AS pstep FROM (
  SELECT cell_id, count(*) AS n, sum((1-soh)*(1-soh)) AS ff, max(dx) > 0 AS has, 40 - min(cycle) AS elapsed FROM p_h GROUP BY cell_id) h, l_prior"""
VIEWS["l_s1"] = _sums_sql("l_p1")
VIEWS["l_g1"] = _grid_sql("l_p1", "l_s1")
VIEWS["l_res"] = """
SELECT h.cell_id, h.cycle, soh - (1 - CAST(0.1 AS DOUBLE)*pow(dx/exp(best.ll), best.sh)) AS r FROM p_h h JOIN (
  SELECT cell_id, min_by(struct_pack(ll := ll, sh := sh), struct_pack(o := sse - 2*0.0001*lprior, i := i, j := j)) AS best FROM l_g1 WHERE has GROUP BY cell_id) m ON h.cell_id = m.cell_id"""
VIEWS["l_noise"] = """
SELECT p.cell_id, CASE WHEN m.n >= 10 THEN greatest(rms, 0.005)*sqrt((1+rho)/(1-rho)) ELSE 0.01 END AS sigma FROM l_p1 p LEFT JOIN (
  SELECT cell_id, count(*) AS n, sqrt(avg(r*r)) AS rms, least(greatest(CASE WHEN stddev_pop(r) > 0 THEN coalesce(corr(before, r), 0) ELSE 0 END, 0), 0.95) AS rho
  FROM (SELECT *, lag(r) OVER (PARTITION BY cell_id ORDER BY cycle) AS before FROM l_res) q GROUP BY cell_id) m ON p.cell_id = m.cell_id"""
VIEWS["l_w1"] = """
SELECT *, exp(lp - max(lp) OVER (PARTITION BY cell_id)) AS w FROM (SELECT g.*, n.sigma, lprior - CASE WHEN has THEN 0.5*sse/(n.sigma*n.sigma) ELSE 0 END AS lp FROM l_g1 g JOIN l_noise n ON g.cell_id = n.cell_id) z"""


def _margin_sql(weights: str, axis: str, value: str) -> str:
    return f"""
SELECT *, sum(w) OVER (PARTITION BY cell_id ORDER BY {axis}) / sum(w) OVER (PARTITION BY cell_id) AS cdf FROM (
  SELECT cell_id, {axis}, sum(w) AS w, min({value}) AS val FROM {weights} GROUP BY cell_id, {axis}) m"""


VIEWS["l_ml"], VIEWS["l_mp"] = _margin_sql("l_w1", "i", "ll"), _margin_sql("l_w1", "j", "sh")
VIEWS["l_p2"] = """
SELECT p.cell_id, p.n, p.ff, p.has, p.elapsed, l.lo - p.lstep AS l0, (l.hi - l.lo + 2*p.lstep)/240 AS lstep,
  greatest(q.lo - p.pstep, 0.05) AS p0, (q.hi + p.pstep - greatest(q.lo - p.pstep, 0.05))/54 AS pstep FROM l_p1 p
JOIN (SELECT cell_id, min(val) FILTER (cdf >= 1e-4 - 1e-12) AS lo, coalesce(min(val) FILTER (cdf >= 1 - 1e-4 - 1e-12), max(val)) AS hi FROM l_ml GROUP BY cell_id) l ON p.cell_id = l.cell_id
JOIN (SELECT cell_id, min(val) FILTER (cdf >= 1e-4 - 1e-12) AS lo, coalesce(min(val) FILTER (cdf >= 1 - 1e-4 - 1e-12), max(val)) AS hi FROM l_mp GROUP BY cell_id) q ON p.cell_id = q.cell_id"""
VIEWS["l_s2"] = _sums_sql("l_p2")
VIEWS["l_g2"] = _grid_sql("l_p2", "l_s2")
VIEWS["l_w2"] = VIEWS["l_w1"].replace("l_g1", "l_g2")
VIEWS["l_m2"] = _margin_sql("l_w2", "i", "ll")


@query("soh_posterior_life", "cell_id:s n_readings:i median:d3 lower:d3 upper:d3 sigma:d6",
       """SELECT m.cell_id, min(p.n) AS n_readings, min(s.sigma) AS sigma, min(rul) FILTER (cdf >= 0.5 - 1e-12) AS median, min(rul) FILTER (cdf >= 0.1 - 1e-12) AS lower,
          min(rul) FILTER (cdf >= 0.9 - 1e-12) AS upper FROM (SELECT m.*, greatest(exp(val) - p.elapsed, 0) AS rul FROM l_m2 m JOIN l_p2 p ON m.cell_id = p.cell_id) m
          JOIN l_p2 p ON m.cell_id = p.cell_id JOIN l_noise s ON m.cell_id = s.cell_id GROUP BY m.cell_id""")
def _(spark, sf_dir):
    rows = _readings(spark, sf_dir)
    prior = staged(priors.life_prior(priors.life_curves(rows)))
    return priors.posterior_life(rows.where("cycle <= 40").withColumn("at_cycle", F.lit(40)), prior)


# The same estimates every 5 cycles against an 0.85 threshold give long error tables.
VIEWS["z_eol"] = "SELECT cell_id, min(CASE WHEN soh_smooth <= 0.85 THEN cycle END) AS true_eol, count(*) AS n, min(cycle) AS first_cycle FROM c_smooth GROUP BY cell_id"
VIEWS["z_at"] = "SELECT cell_id, true_eol, first_cycle, unnest(range(30, CAST(true_eol AS BIGINT), 5)) AS at_c FROM z_eol WHERE n >= 30 AND true_eol IS NOT NULL"
VIEWS["z_hist"] = """
SELECT a.cell_id, a.at_c, r.cycle, CASE WHEN count(soh) OVER w >= 3 THEN quantile_cont(soh, 0.5) OVER w END AS y FROM z_at a JOIN c_read r ON a.cell_id = r.cell_id AND r.cycle <= a.at_c
WINDOW w AS (PARTITION BY a.cell_id, a.at_c ORDER BY r.cycle ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"""
VIEWS["z_rul"] = """
SELECT *, CASE WHEN n < 30 OR NOT coalesce(-m >= 1e-6, false) THEN NULL WHEN eol <= at_c THEN 0 WHEN eol - at_c > 2*(last_cycle-first_cycle) THEN NULL ELSE eol - at_c END AS rul_pred,
  CAST(true_eol - at_c AS DOUBLE) AS rul_true FROM (SELECT *, (0.85 - b)/nullif(m,0) AS eol FROM (SELECT a.cell_id, a.at_c, a.true_eol, a.first_cycle, count(h.y) AS n, max(h.cycle) AS last_cycle,
   regr_slope(h.y, h.cycle) AS m, regr_intercept(h.y, h.cycle) AS b FROM z_at a LEFT JOIN z_hist h ON a.cell_id = h.cell_id AND a.at_c = h.at_c GROUP BY a.cell_id, a.at_c, a.true_eol, a.first_cycle) f) g"""
BIN = "CASE WHEN {x} < 25 THEN '0-25' WHEN {x} < 50 THEN '25-50' WHEN {x} < 100 THEN '50-100' WHEN {x} < 200 THEN '100-200' WHEN {x} < 400 THEN '200-400' ELSE '400+' END"


def _errors(spark, sf_dir):
    return staged(life.rul_error_table(targets(spark, sf_dir), threshold=0.85, stride=5))


@query("std_rul_horizon_study", "bin:s n:i mae:d5 within:d6 median_bias:d5 median_abs_error:d5",
       f"""SELECT bin, count(*) AS n, avg(abs(e)) AS mae, avg(CASE WHEN abs(e) <= 20 THEN 1.0 ELSE 0.0 END) AS within, quantile_cont(e, 0.5) AS median_bias,
          quantile_cont(abs(e), 0.5) AS median_abs_error FROM (SELECT rul_pred - rul_true AS e, {BIN.format(x='rul_true')} AS bin FROM z_rul WHERE rul_pred IS NOT NULL) q GROUP BY bin""")
def _(spark, sf_dir):
    return studies.horizon_table(_errors(spark, sf_dir))


@query("soh_build_error_bands", "bin:s n:i cells:i share_at_least:d6 q05:d5 q50:d5 q95:d5",
       f"""SELECT bin, count(*) AS n, count(DISTINCT cell_id) AS cells, avg(CASE WHEN later >= 0 THEN 1.0 ELSE 0.0 END) AS share_at_least, quantile_cont(later, 0.05) AS q05,
          quantile_cont(later, 0.5) AS q50, quantile_cont(later, 0.95) AS q95 FROM (SELECT cell_id, rul_true - rul_pred AS later, {BIN.format(x='rul_pred')} AS bin FROM z_rul WHERE rul_pred IS NOT NULL) q GROUP BY bin""")
def _(spark, sf_dir):
    return studies.error_bands(_errors(spark, sf_dir))


@query("soh_error_bands_lookup", "cell_id:s cycle:i band_low:d5 band_high:d5",
       """SELECT cell_id, at_c AS cycle, greatest(rul_pred + CASE WHEN rul_pred < 25 THEN 1 WHEN rul_pred < 50 THEN -14 WHEN rul_pred < 100 THEN -40 WHEN rul_pred < 200 THEN -86 ELSE -109 END, 0) AS band_low,
          rul_pred + CASE WHEN rul_pred < 25 THEN 82 WHEN rul_pred < 50 THEN 129 WHEN rul_pred < 100 THEN 141 WHEN rul_pred < 200 THEN 167 ELSE 179 END AS band_high
          FROM z_rul WHERE rul_pred IS NOT NULL""")
def _(spark, sf_dir):
    return priors.with_rul_band(_errors(spark, sf_dir).where("rul_pred IS NOT NULL"))


@query("std_calendar_ageing", "feature:s n:i rho:d6",
       "\nUNION ALL\n".join(
           f"SELECT '{f}' AS feature, count(*) AS n, corr(rx, ry) AS rho FROM (SELECT *, rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f})-1)/2.0 AS rx, "
           f"rank() OVER (ORDER BY loss_pct) + (count(*) OVER (PARTITION BY loss_pct)-1)/2.0 AS ry FROM st_loss) r" for f in ("storage_soc", "storage_temp_c", "soc_temp")),
       {"st_loss": """SELECT s_suppkey % 100 AS storage_soc, 10.0*(s_nationkey % 5) AS storage_temp_c, (s_suppkey % 100)*10.0*(s_nationkey % 5) AS soc_temp,
            100.0*(3.0 - (2.5 + s_acctbal/100000.0))/3.0 AS loss_pct FROM supplier"""})
def _(spark, sf_dir):
    s = fixtures.table(spark, sf_dir, "supplier")
    storage = s.select(F.col("s_suppkey").alias("item_id"), F.pmod("s_suppkey", F.lit(100)).alias("storage_soc"),
                       (10.0 * F.pmod("s_nationkey", F.lit(5))).alias("storage_temp_c"), (2.5 + F.col("s_acctbal") / 100000.0).alias("post_ah"))
    return studies.calendar_ageing(storage, s.select(F.col("s_suppkey").alias("item_id"), F.lit(3.0).alias("initial_ah")))


@query("set_pivot_arms", "cell_id:s cycle:i plain:d6 shifted:d6",
       "SELECT coalesce(a.cell_id,b.cell_id) AS cell_id, coalesce(a.cycle,b.cycle) AS cycle, a.window_charge_ah AS plain, b.window_charge_ah AS shifted FROM d_plain_charge a FULL JOIN d_charge b ON a.cell_id = b.cell_id AND a.cycle = b.cycle")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir), store=True)
    lines = staged(curves.discharge_curves(cut))
    arm = lambda d, n: d.select("cell_id", "cycle", F.col("window_charge_ah").alias("soh_window"), F.lit(n).alias("arm"))
    both = arm(curves.charges_by_cycle(lines), "plain").unionByName(arm(curves.charges_by_cycle(lines, curves.discharge_steps(cut)), "shifted"))
    return studies.pivot_arms(both, ["plain", "shifted"])
