"""Registered queries: per-battery answers, truth joins, monotone fits, constant-current runs, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.analysis import ranks_sql
from voltloom.catalog.base import query
from voltloom.catalog.duty_views import window_sql
from voltloom.catalog.evaluation import SUMMARY_SQL, TEMP, _rows, fold_views
from voltloom.catalog.fleet import _behaviour, _life
from voltloom.catalog.life import cycle_frame, targets
from voltloom.catalog.sequence import CHUNK_S, duty_log, gated_table
from voltloom.catalog.views import HEALTH_SQL, VIEWS
from voltloom.operators import (
    answers, curves, evaluate, extract, guardian, monotone, phases, priors, scores, series, soh, stats, truth,
)
from voltloom.session import staged


def _class(divisor: int = 7) -> F.Column:
    return F.pmod(F.substring("cell_id", 6, 12).cast("int"), F.lit(divisor))


# Class 1 turns cold after ten discharges, class 2 has no temperature, a third has a late reference.
VIEWS["e_facts"] = """
SELECT cell_id, k, count(*) AS samples, max(test_time_s) - min(test_time_s) AS duration_s, k <> 2 AS has_temperature_c,
  CASE WHEN k <> 2 THEN avg(temperature_c) END AS temp_mean, CASE WHEN k <> 2 THEN max(temperature_c) END AS temp_max,
  CASE WHEN k <> 2 THEN avg(CASE WHEN temperature_c > 40 THEN 1.0 ELSE 0.0 END) END AS hot_share
FROM (SELECT *, CAST(substr(cell_id, 6) AS INT) % 7 AS k FROM fx_duty) f GROUP BY cell_id, k"""
VIEWS["e_dis"] = """
SELECT cell_id, cycle, is_complete, avg_temp - CASE WHEN CAST(substr(cell_id, 6) AS INT) % 7 = 1 AND cycle > 10 THEN 20 ELSE 0 END AS avg_temp
FROM d_measured"""
VIEWS["e_cond"] = """
SELECT *, concat_ws('; ', CASE WHEN recent_temp_c < 15 THEN 'cold' END,
  CASE WHEN abs(recent_temp_c - reference_temp_c) > 5 THEN 'other temperature than reference' END) AS condition
FROM (SELECT l.cell_id, recent_temp_c, reference_temp_c FROM (
    SELECT cell_id, quantile_cont(avg_temp, 0.5) AS recent_temp_c FROM (
      SELECT d.*, row_number() OVER (PARTITION BY d.cell_id ORDER BY d.cycle DESC) AS back FROM e_dis d
      JOIN s_report r ON d.cell_id = r.cell_id AND r.soh IS NOT NULL AND d.cycle <= r.at_cycle) a WHERE back <= 5 GROUP BY cell_id) l
  JOIN (SELECT cell_id, quantile_cont(avg_temp, 0.5) AS reference_temp_c FROM (
      SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS up FROM e_dis) b WHERE up <= 5 GROUP BY cell_id) f
  ON l.cell_id = f.cell_id) c"""
VIEWS["e_wide"] = """
SELECT *, CASE WHEN soh IS NULL THEN NULL WHEN condition <> '' OR NOT coalesce(uncertainty <= 0.01, false) THEN 'LOW'
    WHEN NOT bol THEN 'MEDIUM' ELSE 'HIGH' END AS cap_level,
  CASE WHEN resistance_growth IS NULL THEN NULL WHEN n_accepted >= 30 THEN 'HIGH' ELSE 'MEDIUM' END AS res_level,
  CASE WHEN rul_cycles < 25 THEN 'HIGH' WHEN rul_cycles < 100 THEN 'MEDIUM' WHEN rul_cycles IS NOT NULL THEN 'LOW' END AS life_level
FROM (SELECT f.*, m.n_seen, m.n_complete, r.soh, r.at_cycle, r.n_discharges, coalesce(r.n_accepted, 0) AS n_accepted,
   r.resistance_growth, r.uncertainty, coalesce(c.condition, '') AS condition, l.rul_cycles, l.battery_id IS NOT NULL AS is_scored,
   f.k % 3 <> 0 AS bol
 FROM e_facts f LEFT JOIN (SELECT cell_id, count(*) AS n_seen, count(CASE WHEN is_complete THEN 1 END) AS n_complete
     FROM e_dis GROUP BY cell_id) m ON f.cell_id = m.cell_id
 LEFT JOIN s_report r ON f.cell_id = r.cell_id LEFT JOIN e_cond c ON f.cell_id = c.cell_id
 LEFT JOIN life_rows l ON f.cell_id = l.battery_id) w"""


def wide(spark, sf_dir):
    """(answers, gated table) of the duty log."""
    k = _class()
    log = fixtures.duty(spark, sf_dir).withColumn("temperature_c", F.when(k != 2, F.col("temperature_c")))
    discharges, table = gated_table(spark, sf_dir)
    cold = F.when((k == 1) & (F.col("cycle") > 10), F.col("avg_temp") - 20).otherwise(F.col("avg_temp"))
    measured = staged(phases.measure_cycles(discharges).withColumn("avg_temp", cold))
    report = staged(soh.current_soh(table, discharges))
    life = _life(spark, sf_dir).select(F.col("battery_id").alias("cell_id"), "rul_cycles")
    return staged(answers.battery_answers(
        answers.log_facts(log), measured, report, life, life, k % 3 != 0)), table


@query("soh_evidence_block",
       "cell_id:s samples:i duration_s:d3 has_temperature_c:b has_soc:b discharges:i complete_discharges:i "
       "window_discharges:i output:s available:b confidence:s",
       """SELECT cell_id, samples, duration_s, has_temperature_c, false AS has_soc, n_seen AS discharges,
            n_complete AS complete_discharges, n_accepted AS window_discharges, o.output, o.level IS NOT NULL AS available,
            coalesce(o.level, '') AS confidence
          FROM (SELECT *, unnest([struct_pack(output := 'capacity health', level := cap_level),
             struct_pack(output := 'resistance health', level := res_level),
             struct_pack(output := 'remaining life', level := life_level),
             struct_pack(output := 'heat exposure', level := CASE WHEN has_temperature_c THEN 'MEASURED' END),
             struct_pack(output := 'behaviour risk score', level := CASE WHEN is_scored THEN 'HEURISTIC' END)]) AS o FROM e_wide) w""")
def _(spark, sf_dir):
    return answers.evidence_block(wide(spark, sf_dir)[0])


@query("rsk_health_card_rows", "cell_id:s section:i item:s value:d5 label:s",
       """SELECT cell_id, 1 AS section, CASE WHEN bol THEN 'capacity health' ELSE 'capacity relative to the start of the log' END AS item,
            soh AS value, cap_level AS label FROM e_wide WHERE soh IS NOT NULL
          UNION ALL SELECT cell_id, 1, 'resistance health', 1/resistance_growth, res_level FROM e_wide WHERE soh IS NOT NULL AND resistance_growth > 0
          UNION ALL SELECT cell_id, 1, 'state', NULL, 'MEASURED' FROM e_wide WHERE soh IS NOT NULL AND bol
          UNION ALL SELECT cell_id, 1, 'not available', NULL, '' FROM e_wide WHERE soh IS NULL
          UNION ALL SELECT cell_id, 2, 'cycles left', rul_cycles, 'ESTIMATE' FROM e_wide WHERE rul_cycles > 0
          UNION ALL SELECT cell_id, 2, 'already below the end-of-life limit', 0, 'MEASURED' FROM e_wide WHERE rul_cycles <= 0
          UNION ALL SELECT cell_id, 2, 'not available', NULL, '' FROM e_wide WHERE rul_cycles IS NULL
          UNION ALL SELECT cell_id, 3, 'mean temperature', temp_mean, 'MEASURED' FROM e_wide WHERE has_temperature_c
          UNION ALL SELECT cell_id, 3, 'highest temperature', temp_max, 'MEASURED' FROM e_wide WHERE has_temperature_c
          UNION ALL SELECT cell_id, 3, 'share of hot samples', hot_share, 'MEASURED' FROM e_wide WHERE has_temperature_c
          UNION ALL SELECT cell_id, 3, 'not available', NULL, '' FROM e_wide WHERE NOT has_temperature_c
          UNION ALL SELECT cell_id, 4, 'advice by measured state', NULL, 'MEASURED' FROM e_wide WHERE soh IS NOT NULL AND bol
          UNION ALL SELECT cell_id, 4, 'no advice', NULL, '' FROM e_wide WHERE soh IS NULL OR NOT bol
          UNION ALL SELECT cell_id, 5, 'refused', NULL, '' FROM e_wide WHERE soh IS NULL
          UNION ALL SELECT cell_id, 5, 'nothing refused', NULL, '' FROM e_wide WHERE soh IS NOT NULL
          UNION ALL SELECT cell_id, 5, 'scope', NULL, '' FROM e_wide""")
def _(spark, sf_dir):
    return answers.health_card(wide(spark, sf_dir)[0])


VIEWS["e_later"] = """
SELECT cell_id, sum(n) AS later_refused, min_by(why, struct_pack(n := -n, t := txt)) AS why FROM (
  SELECT g.cell_id, g.why, CASE g.why WHEN 'high' THEN 'window ratio above' WHEN 'implausible' THEN 'window ratio below' ELSE 'discharge' END AS txt,
    count(*) AS n FROM s_gated g JOIN s_report r ON g.cell_id = r.cell_id
  WHERE r.soh IS NOT NULL AND g.cycle > r.at_cycle AND g.why <> '' GROUP BY g.cell_id, g.why) a GROUP BY cell_id"""
LATER = {soh.TOO_HIGH: "high", soh.IMPLAUSIBLE: "implausible", soh.TOO_LITTLE: "partial"}


@query("str_profile_listing",
       "cell_id:s discharges_remembered:i soh:d6 at_cycle:i discharges_since_reading:i later_refused:i later_why:s "
       "confidence:s resistance_confidence:s resistance_growth:d6",
       """SELECT w.cell_id, n_discharges AS discharges_remembered, soh, CASE WHEN soh IS NOT NULL THEN at_cycle END AS at_cycle,
            CASE WHEN soh IS NOT NULL THEN n_discharges - at_cycle END AS discharges_since_reading, coalesce(later_refused, 0) AS later_refused,
            CASE WHEN soh IS NOT NULL AND n_discharges > at_cycle THEN coalesce(why, 'not crossed') ELSE '' END AS later_why,
            coalesce(cap_level, 'NONE') AS confidence, coalesce(res_level, 'NONE') AS resistance_confidence, resistance_growth
          FROM e_wide w LEFT JOIN e_later l ON w.cell_id = l.cell_id WHERE n_discharges > 0""")
def _(spark, sf_dir):
    out = answers.profile_listing(*wide(spark, sf_dir))
    why = F.col("later_refusal")
    for text, code in LATER.items():
        out = out.withColumn("later_refusal", F.when(why == text, code).otherwise(why))
    return out.withColumn("later_why", F.when(why.startswith("later"), "not crossed").otherwise(why))


@query("rsk_measured_state_override", "battery_id:s battery_state:s heuristic_state:s state_basis:s",
       """SELECT l.battery_id, CASE WHEN r.soh IS NULL THEN l.battery_state WHEN r.soh >= 0.95 THEN 'HEALTHY' WHEN r.soh >= 0.9 THEN 'WARNING'
            WHEN r.soh >= 0.8 THEN 'DEGRADED' ELSE 'CRITICAL' END AS battery_state, l.battery_state AS heuristic_state,
            CASE WHEN r.soh IS NULL THEN 'heuristic_index' ELSE 'measured_soh' END AS state_basis
          FROM life_rows l LEFT JOIN s_report r ON l.battery_id = r.cell_id""")
def _(spark, sf_dir):
    discharges, table = gated_table(spark, sf_dir)
    return guardian.measured_state(_life(spark, sf_dir), staged(soh.current_soh(table, discharges)), True)


VIEWS["p_has"] = """
SELECT cell_id, CAST(substr(cell_id, 6) AS INT) % 7 AS k FROM fx_telemetry GROUP BY cell_id"""


@query("prj_stage_availability", "cell_id:s stages:s available:b missing:s",
       """SELECT cell_id, 'behavior_flags, risk_assessment, health_index, guardian' AS stages, missing = '' AS available, missing FROM (
            SELECT cell_id, concat_ws(', ', CASE WHEN k IN (2, 5) THEN 'temperature_c' END, CASE WHEN k IN (4, 5) THEN 'soc' END) AS missing
            FROM p_has) h""")
def _(spark, sf_dir):
    k = _class()
    rows = fixtures.telemetry(spark, sf_dir).withColumns({
        "temperature_c": F.when(~k.isin(2, 5), F.col("temperature_c")), "soc": F.when(~k.isin(4, 5), F.col("soc"))})
    return answers.stage_availability(answers.log_facts(rows))


@query("agg_score_band_counts", "score:s band:s n:i share:d6 median:d5 p90:d5",
       "\nUNION ALL\n".join(
           f"""SELECT '{s}' AS score, {b} AS band, count(*) AS n, count(*)/CAST((SELECT count(*) FROM life_rows) AS DOUBLE) AS share,
              quantile_cont({s}, 0.5) AS median, quantile_cont({s}, 0.9) AS p90 FROM life_rows GROUP BY {b}"""
           for s, b in (("risk_score", "risk_level"), ("health_index", "battery_state"), ("rul_cycles", "replacement_policy"))))
def _(spark, sf_dir):
    return answers.score_bands(_life(spark, sf_dir), {
        "risk_score": "risk_level", "health_index": "battery_state", "rul_cycles": "replacement_policy"})


@query("rsk_fleet_cards", "battery_id:s tone:s terms:s largest:d6 n_points:i series_sum:d5",
       f"""SELECT s.battery_id, CASE battery_state WHEN 'CRITICAL' THEN 'bad' WHEN 'HEALTHY' THEN 'good' ELSE 'warn' END AS tone,
            array_to_string(list_transform(parts, lambda p: p.t), ', ') AS terms, parts[1].v AS largest, n_points, series_sum
          FROM (SELECT *, list_sort([{', '.join(
              f"struct_pack(m := -round(abs(health_shap_{t}), 6), i := {i}, t := '{t}', v := health_shap_{t})"
              for i, t in enumerate(HEALTH_SQL))}]) AS parts FROM shap_rows) s
          LEFT JOIN (SELECT cell_id, count(*) AS n_points, sum(stress) AS series_sum FROM (
            SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) - 1 AS at_p, count(*) OVER (PARTITION BY cell_id) AS n
            FROM (SELECT cell_id, cycle, avg(stress_score) AS stress FROM stressed GROUP BY cell_id, cycle) g) p
            WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda k: CAST(floor(k*(n-1)/5.0) AS BIGINT)), at_p)
            GROUP BY cell_id) q ON s.battery_id = q.cell_id""")
def _(spark, sf_dir):
    cycles = _behaviour(spark, sf_dir).groupBy("cell_id", "cycle").agg(F.avg("stress_score").alias("value"))
    points = series.evenly_spaced(staged(cycles), ["cell_id"], ["cycle"], 6, F.floor(F.col("cycle") / 4096))
    cards = answers.fleet_cards(scores.shapley(_life(spark, sf_dir), scores.HEALTH_TERMS, "health_"),
                                {t: f"health_shap_{t}" for t in HEALTH_SQL}, points)
    return cards.withColumns({
        "terms": F.array_join(F.col("attribution.term"), ", "), "largest": F.col("attribution")[0]["value"],
        "n_points": F.size("series"), "series_sum": F.aggregate("series.value", F.lit(0.0), lambda a, v: a + v)})


# Laboratory labels by cycler cycle; every ninth is missing.
VIEWS["t_labels"] = """
SELECT cell_id, cyc, 2.0 - CAST(0.004 AS DOUBLE)*cyc + avg(temperature_c)/1000 AS capacity_ah FROM fx_duty
WHERE cyc % 9 <> 4 GROUP BY cell_id, cyc"""
VIEWS["t_joined"] = """
SELECT g.cell_id, g.cycle, f.cyc AS cycler_cycle, g.soh_window_accepted, l.capacity_ah / r.ref AS soh_true,
  CAST(substr(g.cell_id, 6) AS INT) % 5 AS cohort
FROM s_gated g JOIN d_dis d ON g.cell_id = d.cell_id AND g.cycle = d.cycle
JOIN fx_duty f ON f.cell_id = d.cell_id AND f.test_time_s = d.start_time_s
JOIN t_labels l ON l.cell_id = g.cell_id AND l.cyc = f.cyc
JOIN (SELECT cell_id, quantile_cont(capacity_ah, 0.5) AS ref FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cyc) AS k FROM t_labels) a WHERE k <= 5 GROUP BY cell_id) r
ON r.cell_id = g.cell_id"""


def labelled(spark, sf_dir):
    """Accepted readings beside labels; the log is stored, four steps read it."""
    log = staged(fixtures.duty(spark, sf_dir))
    labels = staged(log.where(F.col("cyc") % 9 != 4).groupBy("cell_id", F.col("cyc").alias("cycler_cycle")).agg(
        (2.0 - 0.004 * F.first("cyc") + F.avg("temperature_c") / 1000).alias("capacity_ah")))
    discharges, table = gated_table(spark, sf_dir, phases.Log(log, chunk_s=CHUNK_S))
    numbers = truth.cycler_cycles(discharges, log.withColumns({"cycle": F.col("cyc"), "seq": F.col("rn")}))
    joined = truth.label_join(table.select("cell_id", "cycle", "soh_window_accepted"), numbers, labels)
    return staged(joined.withColumn("cohort", _class(5)))


@query("jn_label_to_discharge_join", "cell_id:s cycle:i cycler_cycle:i soh_window_accepted:d6 soh_true:d6",
       "SELECT * FROM t_joined")
def _(spark, sf_dir):
    return labelled(spark, sf_dir)


@query("std_field_soh_accuracy",
       "cohort:i n_labelled:i n_read:i n_cells:i share_read:d6 bias:d6 mae:d6 median_error:d6 p90_error:d6",
       """SELECT cohort, count(soh_true) AS n_labelled, count(soh_window_accepted) AS n_read, count(DISTINCT cell_id) AS n_cells,
            count(soh_window_accepted)/CAST(count(soh_true) AS DOUBLE) AS share_read, avg(soh_window_accepted - soh_true) AS bias,
            avg(abs(soh_window_accepted - soh_true)) AS mae, quantile_cont(abs(soh_window_accepted - soh_true), 0.5) AS median_error,
            quantile_cont(abs(soh_window_accepted - soh_true), 0.9) AS p90_error FROM t_joined GROUP BY cohort""")
def _(spark, sf_dir):
    return truth.accuracy(labelled(spark, sf_dir), ["cohort"], "soh_window_accepted")


def isotonic_sql(source: str, keys: str) -> str:
    """Monotone fit by its max-min form; ``source`` has the keys, place i, value z and running sum s."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mine = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""SELECT {keys}, ib AS i, max(low) AS t FROM (
      SELECT *, min(m) OVER (PARTITION BY {keys}, ia ORDER BY ib DESC) AS low FROM (
        SELECT {mine}, a.i AS ia, b.i AS ib, (b.s - a.s + a.z)/(b.i - a.i + 1) AS m
        FROM {source} a JOIN {source} b ON {on} AND b.i >= a.i) p) q GROUP BY {keys}, ib"""


VIEWS["sg_rows"] = "SELECT cell_id, cycle, cumulative_fade AS y FROM c_targets WHERE cumulative_fade IS NOT NULL"
VIEWS["sg_turn"] = ("SELECT cell_id, CASE WHEN corr(rx, ry) >= 0 THEN 1 ELSE -1 END AS turn FROM ("
                    + ranks_sql("sg_rows", "cell_id", "cycle", "y")
                    + ") r GROUP BY cell_id HAVING count(*) >= 10 AND count(DISTINCT cycle) >= 3 AND var_pop(y) > 0")
VIEWS["sg_pos"] = """
SELECT r.cell_id, turn*y AS z, row_number() OVER (PARTITION BY r.cell_id ORDER BY cycle) AS i,
  sum(turn*y) OVER (PARTITION BY r.cell_id ORDER BY cycle) AS s FROM sg_rows r JOIN sg_turn t ON r.cell_id = t.cell_id"""
VIEWS["sg_fit"] = isotonic_sql("sg_pos", "cell_id")
VIEWS["sg_cells"] = """
SELECT p.cell_id, count(*) AS n, var_pop(t)*count(*) AS signal_ss, sum((z-t)*(z-t)) AS noise_ss
FROM sg_pos p JOIN sg_fit f ON p.cell_id = f.cell_id AND p.i = f.i GROUP BY p.cell_id"""
VIEWS["sg_all"] = """
SELECT 'cumulative_fade' AS target, count(*) AS n_cells, sum(n) AS n_rows, sum(signal_ss)/sum(n) AS signal_variance,
  sum(noise_ss)/sum(n) AS noise_variance, sum(signal_ss)/(sum(signal_ss)+sum(noise_ss)) AS signal_fraction FROM sg_cells"""


@query("sta_signal_fraction", "target:s n_cells:i n_rows:i signal_variance:d8 noise_variance:d9 signal_fraction:d6",
       "SELECT * FROM sg_all")
def _(spark, sf_dir):
    return monotone.signal_fraction(targets(spark, sf_dir), "cumulative_fade")


VIEWS["iw_pos"] = """
SELECT cell_id, cycle, test_time_s, capacity_ah_curve, -v AS z, row_number() OVER w AS i, sum(-v) OVER w AS s
FROM (SELECT *, voltage_v + CASE WHEN CAST(test_time_s/60 AS BIGINT) % 5 = 0 THEN CAST(0.08 AS DOUBLE) ELSE 0 END AS v FROM d_curve) c
WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY capacity_ah_curve, test_time_s)"""
VIEWS["iw_fit"] = isotonic_sql("iw_pos", "cell_id, cycle")
VIEWS["iw_curve"] = """
SELECT p.cell_id, p.cycle, p.test_time_s, p.capacity_ah_curve, -f.t AS voltage_v
FROM iw_pos p JOIN iw_fit f ON p.cell_id = f.cell_id AND p.cycle = f.cycle AND p.i = f.i"""
VIEWS["iw_charge"] = window_sql("iw_curve", "CAST(3.6 AS DOUBLE)", "CAST(3.9 AS DOUBLE)")


@query("seg_isotonic_window_charge", "cell_id:s cycle:i window_charge_ah:d6 cycle_charge_ah:d6", "SELECT * FROM iw_charge")
def _(spark, sf_dir):
    noisy = F.when((F.col("test_time_s") / 60).cast("bigint") % 5 == 0, 0.08).otherwise(0.0)
    rows = curves.discharge_curves(phases.segment(duty_log(spark, sf_dir))).withColumn("voltage_v", F.col("voltage_v") + noisy)
    return curves.charges_by_cycle(monotone.falling_voltage(rows))


@query("seg_coulomb_cross_check", "cell_id:s phase_no:i counted_ah:d6 load_ah:d6 ratio:d6",
       """SELECT cell_id, phase_no, min(counted) AS counted_ah, sum(step) AS load_ah, min(counted)/sum(step) AS ratio FROM (
            SELECT s.cell_id, s.phase_no, p.counted, coalesce((voltage_v + lag(voltage_v) OVER w)/2/CAST(2.5 AS DOUBLE)*(test_time_s - lag(test_time_s) OVER w)/3600, 0) AS step
            FROM d_samples s JOIN (SELECT cell_id, min_by(phase_no, struct_pack(q := -round(charge_ah, 9), p := phase_no)) AS phase_no, max(charge_ah) AS counted
              FROM d_dis GROUP BY cell_id) p ON s.cell_id = p.cell_id AND s.phase_no = p.phase_no
            WINDOW w AS (PARTITION BY s.cell_id ORDER BY test_time_s)) a GROUP BY cell_id, phase_no""")
def _(spark, sf_dir):
    return extract.load_cross_check(phases.segment(duty_log(spark, sf_dir)), 2.5)


# Cycles with a step in the rate, dropouts, no discharge, no voltage.
# Cycles of 150 samples each: pause, 120 samples of discharge, charge.
VIEWS["cc_in"] = """
SELECT cell_id, cycle, test_time_s, k*CAST(0.025 AS DOUBLE) AS q, CASE WHEN cycle % 4 = 3 AND k % 2 = 0 THEN NULL ELSE CAST(4.1 AS DOUBLE) - CAST(0.008 AS DOUBLE)*k END AS v,
  -CASE WHEN cycle % 7 = 2 THEN abs(amps) WHEN cycle % 5 = 1 AND k % 30 = 0 THEN 0
    WHEN cycle % 3 = 0 AND k BETWEEN 80 AND 123 THEN CAST(-0.9 AS DOUBLE) ELSE amps END AS m FROM (
  SELECT *, CASE WHEN k BETWEEN 4 AND 123 THEN CAST(-1.5 AS DOUBLE) WHEN k > 130 THEN CAST(3.0 AS DOUBLE) ELSE 0 END AS amps FROM (
    SELECT cell_id, test_time_s, CAST(floor((rn-1)/150.0) AS INT) AS cycle, (rn-1) % 150 AS k FROM fx_duty) a) b"""
VIEWS["cc_rate"] = """
SELECT cell_id, cycle, count(CASE WHEN m > 0 THEN 1 END) AS n_right, quantile_cont(m, 0.5) FILTER (m > 0) AS med, max(m) AS peak
FROM cc_in GROUP BY cell_id, cycle"""
VIEWS["cc_cut"] = """
SELECT *, sum(CASE WHEN el AND (NOT was OR abs(m - mp) > CAST(0.15 AS DOUBLE)*peak) THEN 1 ELSE 0 END)
  OVER (PARTITION BY cell_id, cycle ORDER BY test_time_s) AS run
FROM (SELECT *, coalesce(lag(el) OVER w, false) AS was, lag(m) OVER w AS mp FROM (
   SELECT i.*, r.peak, coalesce(m >= 0.5*med, false) AS el FROM cc_in i JOIN cc_rate r ON i.cell_id = r.cell_id AND i.cycle = r.cycle) a
 WINDOW w AS (PARTITION BY cell_id, cycle ORDER BY test_time_s)) b"""
VIEWS["cc_best"] = """
SELECT r.cell_id, r.cycle, b.run, b.i_run, b.q0, CASE WHEN n_right = 0 THEN 'no discharge samples' WHEN n_right < 50 THEN 'too few discharge samples in the cycle'
    WHEN n IS NULL THEN 'no constant-current discharge run' WHEN n < 50 THEN 'longest run too short'
    WHEN nf < 50 THEN 'too few pairs of voltage and charge' WHEN span < 0.1 THEN 'voltage span too small' ELSE '' END AS refusal
FROM cc_rate r LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id, cycle ORDER BY n DESC, run) AS k FROM (
  SELECT cell_id, cycle, run, count(*) AS n, count(v) AS nf, max(v) - min(v) AS span, min(CASE WHEN v IS NOT NULL THEN q END) AS q0,
    -quantile_cont(m, 0.5) AS i_run FROM cc_cut WHERE el GROUP BY cell_id, cycle, run) a) b
ON r.cell_id = b.cell_id AND r.cycle = b.cycle AND b.k = 1"""


def cc_runs(spark, sf_dir):
    cyc, at = F.floor((F.col("rn") - 1) / 150).cast("int"), F.pmod(F.col("rn") - 1, F.lit(150))
    amps = F.when(at.between(4, 123), -1.5).when(at > 130, 3.0).otherwise(0.0)
    rows = fixtures.duty(spark, sf_dir).withColumns({
        "cycle": cyc, "seq": F.col("rn"), "capacity_ah_counter": at * 0.025,
        "voltage_v": F.when(~((cyc % 4 == 3) & (at % 2 == 0)), 4.1 - 0.008 * at),
        "current_a": F.when(cyc % 7 == 2, F.abs(amps)).when((cyc % 5 == 1) & (at % 30 == 0), 0.0)
        .when((cyc % 3 == 0) & at.between(80, 123), -0.9).otherwise(amps)})
    return extract.constant_current_runs(rows)


@query("seg_extract_cc_curves", "cell_id:s cycle:i test_time_s:d3 run_current_a:d6 voltage_v:d6 capacity_ah_curve:d6",
       """SELECT c.cell_id, c.cycle, c.test_time_s, b.i_run AS run_current_a, c.v AS voltage_v, c.q - b.q0 AS capacity_ah_curve
          FROM cc_cut c JOIN cc_best b ON c.cell_id = b.cell_id AND c.cycle = b.cycle AND c.run = b.run
          WHERE b.refusal = '' AND c.el AND c.v IS NOT NULL""")
def _(spark, sf_dir):
    return cc_runs(spark, sf_dir).curves


@query("seg_cc_curve_refusals", "refusal:s n:i", "SELECT refusal, count(*) AS n FROM cc_best GROUP BY refusal")
def _(spark, sf_dir):
    return cc_runs(spark, sf_dir).refusals


VIEWS["pr_cells"] = """
SELECT cell_id, avg(avg_stress) AS x, avg(capacity_ah) AS y, sum(deep_discharge_duration) AS z FROM fx_cycles GROUP BY cell_id"""
VIEWS["pr_ranks"] = """
SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0 AS ry,
  rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1)/2.0 AS rz FROM pr_cells"""
VIEWS["pr_left"] = """
SELECT round(rx - a.ca - a.ma*rz, 8) AS p, round(ry - a.cb - a.mb*rz, 8) AS q FROM pr_ranks, (
  SELECT regr_slope(rx, rz) AS ma, regr_intercept(rx, rz) AS ca, regr_slope(ry, rz) AS mb, regr_intercept(ry, rz) AS cb FROM pr_ranks) a"""


@query("sta_partial_rank_correlation", "n:i rho:d6 rho_y_vs_control:d6",
       "SELECT count(*) AS n, corr(rx, ry) AS rho, (SELECT corr(rz, ry) FROM pr_ranks) AS rho_y_vs_control FROM ("
       + ranks_sql("pr_left", "", "p", "q") + ") r")
def _(spark, sf_dir):
    cells = staged(cycle_frame(spark, sf_dir).groupBy("cell_id").agg(
        F.avg("avg_stress").alias("x"), F.avg("capacity_ah").alias("y"), F.sum("deep_discharge_duration").alias("z")))
    return stats.partial_rank_correlation(cells, "x", "y", "z")


VIEWS["si_cells"] = """
SELECT cell_id, cohort, bool_or(soh <= CAST(0.88 AS DOUBLE)) AS crossed,
  CAST(coalesce(min(CASE WHEN soh <= CAST(0.88 AS DOUBLE) THEN cycle END), max(cycle)) + 40 AS DOUBLE) AS life,
  avg(CASE WHEN cycle < 0 THEN cumulative_fade END)/avg(CASE WHEN cycle < 0 THEN cycle + 40 END) AS early_rate
FROM c_targets WHERE soh IS NOT NULL GROUP BY cell_id, cohort"""
VIEWS["si_logs"] = "SELECT ln(early_rate) AS x, ln(life) AS y FROM si_cells WHERE cohort <> 'COHORT_0' AND crossed AND early_rate > 0"
VIEWS["si_line"] = """
SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, var_pop(x)*count(*) AS sxx, count(*) AS n FROM si_logs"""
VIEWS["si_lives"] = """
SELECT c.cell_id, c.crossed, c.life, m.mid AS sibling_median, CAST(0.12 AS DOUBLE)/(CASE WHEN early_rate > 0 THEN early_rate END) AS own_rate,
  exp(l.a + l.b*ln(CASE WHEN early_rate > 0 THEN early_rate END)) AS fitted,
  exp(l.a + l.b*ln(CASE WHEN early_rate > 0 THEN early_rate END))*exp(q.q10) AS fitted_bound
FROM si_cells c, si_line l, (SELECT quantile_cont((y - a - b*x)/(1 - (1.0/n + (x-mx)*(x-mx)/sxx)), 0.1) AS q10 FROM si_logs, si_line) q,
  (SELECT quantile_cont(life, 0.5) AS mid FROM si_cells WHERE cohort <> 'COHORT_0' AND crossed) m
WHERE c.cohort = 'COHORT_0'"""


def siblings(spark, sf_dir):
    low, young = F.col("soh") <= 0.88, F.col("cycle") < 0
    cells = staged(targets(spark, sf_dir).where("soh IS NOT NULL").groupBy("cell_id", "cohort").agg(
        F.bool_or(low).alias("crossed"),
        (F.coalesce(F.min(F.when(low, F.col("cycle"))), F.max("cycle")) + 40).cast("double").alias("life"),
        (F.avg(F.when(young, F.col("cumulative_fade"))) / F.avg(F.when(young, F.col("cycle") + 40))).alias("early_rate")))
    new = F.col("cohort") == "COHORT_0"
    return priors.sibling_lives(cells.where(~new), cells.where(new), threshold=0.88)


@query("soh_sibling_life_regression", "cell_id:s crossed:b life:d1 sibling_median:d4 own_rate:d4 fitted:d4 fitted_bound:d4",
       "SELECT * FROM si_lives")
def _(spark, sf_dir):
    return siblings(spark, sf_dir)


@query("std_sibling_life_scores",
       "n_cells:i n_crossed:i bound_coverage:d6 sibling_median_error:d5 own_rate_error:d5 fitted_error:d5",
       """SELECT count(*) AS n_cells, count(CASE WHEN crossed THEN 1 END) AS n_crossed,
            avg(CASE WHEN crossed THEN CASE WHEN life >= fitted_bound THEN 1.0 WHEN life < fitted_bound THEN 0.0 END WHEN life >= fitted_bound THEN 1.0 END) AS bound_coverage,
            quantile_cont(abs(sibling_median - life)/life, 0.5) FILTER (crossed) AS sibling_median_error,
            quantile_cont(abs(own_rate - life)/life, 0.5) FILTER (crossed) AS own_rate_error,
            quantile_cont(abs(fitted - life)/life, 0.5) FILTER (crossed) AS fitted_error FROM si_lives""")
def _(spark, sf_dir):
    return priors.sibling_scores(staged(siblings(spark, sf_dir)))


VIEWS.update(fold_views("vb", "v_rows", "cumulative_fade", "cycle", "cell_id"))
VIEWS["bs_summary"] = " UNION ALL ".join(
    ["SELECT * FROM v_summary"] + [SUMMARY_SQL.format(s=s, v=v).replace("'temp'", f"'{m}'") for m, s, v in (
        ("age_linear", "LOBO", "vb"), ("age_linear", "LOCO", "va"))])
VIEWS["bs_ranked"] = """
SELECT *, row_number() OVER (ORDER BY status, round(loco_median_r2, 9) DESC NULLS LAST, model) AS place FROM (
  SELECT a.model, CASE WHEN a.median_r2_vs_global_mean > 0 AND b.median_r2_vs_global_mean > 0
    AND b.fraction_beating_baseline >= 0.5 AND a.median_r2_vs_confound_baseline > 0
    AND b.median_r2_vs_confound_baseline > 0 THEN 'PROMOTE' ELSE 'REJECT' END AS status,
    a.median_r2_vs_global_mean AS lobo_median_r2, b.median_r2_vs_global_mean AS loco_median_r2
  FROM bs_summary a JOIN bs_summary b ON a.model = b.model WHERE a.split = 'LOBO' AND b.split = 'LOCO') g"""
MODELS = (TEMP, evaluate.AGE_LINEAR)


@query("srt_result_ranking", "place:i model:s status:s loco_median_r2:d4", "SELECT * FROM bs_ranked")
def _(spark, sf_dir):
    return evaluate.ranked_results(evaluate.study_gate(_rows(spark, sf_dir), MODELS, "cumulative_fade"))


@query("val_benchmark_study", "place:i model:s status:s lobo_median_r2:d4 loco_median_r2:d4 r2_ceiling:d6",
       "SELECT *, (SELECT signal_fraction FROM sg_all) AS r2_ceiling FROM bs_ranked")
def _(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    gate = evaluate.study_gate(rows, MODELS, "cumulative_fade")
    return evaluate.ranked_results(gate, monotone.signal_fraction(rows, "cumulative_fade"))
