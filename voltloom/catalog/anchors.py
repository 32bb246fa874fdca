"""Registered queries: anchored overpotential, characterisation blocks and channel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog import duty_views  # noqa: F401
from voltloom.catalog.base import query
from voltloom.catalog.sequence import duty_log
from voltloom.catalog.views import VIEWS
from voltloom.operators import anchored, curves, phases
from voltloom.session import staged

# A wider band than the operator's, since the test log has sixteen samples in a discharge.
VIEWS["ao_total"] = "SELECT cell_id, cycle, max(capacity_ah_curve) AS total FROM d_curve GROUP BY cell_id, cycle"
VIEWS["ao_ref"] = """
SELECT cell_id, quantile_cont(total, 0.5) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM ao_total) a
WHERE k <= 5 GROUP BY cell_id HAVING quantile_cont(total, 0.5) > 0"""
VIEWS["ao_segments"] = """
SELECT c.cell_id, c.cycle, ref, capacity_ah_curve AS q, voltage_v AS v, lead(capacity_ah_curve) OVER w AS qn, lead(voltage_v) OVER w AS vn,
  min(capacity_ah_curve) OVER p AS lo, max(capacity_ah_curve) OVER p AS hi, count(*) OVER p AS n
FROM d_curve c JOIN ao_ref r ON c.cell_id = r.cell_id
WINDOW w AS (PARTITION BY c.cell_id, cycle ORDER BY capacity_ah_curve), p AS (PARTITION BY c.cell_id, cycle)"""
VIEWS["ao_grid"] = """
SELECT cell_id, cycle, i, v + (g - q)/(qn - q)*(vn - v) AS v FROM (
  SELECT *, (CAST(0.2 AS DOUBLE) + i*CAST(0.02 AS DOUBLE))*ref AS g FROM ao_segments, range(0, 21) r(i)) a
WHERE n >= 3 AND lo <= CAST(0.2 AS DOUBLE)*ref AND hi >= CAST(0.6 AS DOUBLE)*ref AND q <= g AND g < qn"""
VIEWS["ao_first"] = """
SELECT cell_id, cycle FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM (
  SELECT DISTINCT cell_id, cycle FROM ao_grid) a) b WHERE k <= 5"""
VIEWS["ao_level"] = """
SELECT f.cell_id, quantile_cont(ir_drop_v, 0.5) AS level FROM ao_first f JOIN d_trail t ON f.cell_id = t.cell_id AND f.cycle = t.cycle
WHERE ir_drop_v IS NOT NULL GROUP BY f.cell_id"""
VIEWS["ao_rest"] = """
SELECT cell_id, cycle, v_rest_v - CASE WHEN cycle % 8 = 7 THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS v_rest_v FROM d_step"""
VIEWS["ao_floor"] = """
SELECT f.cell_id, quantile_cont(v_rest_v, 0.5) - CAST(0.03 AS DOUBLE) AS floor_v FROM ao_first f
JOIN ao_rest r ON f.cell_id = r.cell_id AND f.cycle = r.cycle WHERE v_rest_v IS NOT NULL GROUP BY f.cell_id"""
VIEWS["ao_offset"] = """
SELECT g.cell_id, g.cycle, quantile_cont(m.v - g.v, 0.5) AS off FROM ao_grid g JOIN (
  SELECT g.cell_id, i, quantile_cont(v, 0.5) AS v FROM ao_grid g JOIN ao_first f ON g.cell_id = f.cell_id AND g.cycle = f.cycle
  GROUP BY g.cell_id, i) m ON g.cell_id = m.cell_id AND g.i = m.i GROUP BY g.cell_id, g.cycle"""


@query("seg_anchored_overpotential", "cell_id:s cycle:i ir_drop_v:d6 anchor_offset_v:d6",
       """SELECT t.cell_id, t.cycle, CASE WHEN ok THEN level + off END AS ir_drop_v, CASE WHEN ok THEN off END AS anchor_offset_v FROM (
            SELECT t.cell_id, t.cycle, l.level, o.off, f.floor_v IS NULL OR coalesce(r.v_rest_v >= f.floor_v, false) AS ok
            FROM ao_total t JOIN ao_level l ON t.cell_id = l.cell_id LEFT JOIN ao_offset o ON t.cell_id = o.cell_id AND t.cycle = o.cycle
            LEFT JOIN ao_floor f ON t.cell_id = f.cell_id LEFT JOIN ao_rest r ON t.cell_id = r.cell_id AND t.cycle = r.cycle) t""")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    low = F.when(F.col("cycle") % 8 == 7, 0.05).otherwise(0.0)
    rest = curves.step_resistance(cut.discharges, cut.log.rest_below_a).withColumn("v_rest_v", F.col("v_rest_v") - low)
    return anchored.anchored_overpotential(curves.discharge_curves(cut), curves.discharge_steps(cut), staged(rest),
                                           band=(0.2, 0.6))


@query("agg_summarize_characterisation",
       "cell_id:s cycle:i capacity_ah:d6 n_samples:i mean_voltage_v:d6 min_voltage_v:d6 avg_temp:d6 max_temp:d6 cycle_duration_s:d3",
       """SELECT cell_id, cyc AS cycle, max(abs(q)) AS capacity_ah, count(*) AS n_samples, avg(voltage_v) AS mean_voltage_v,
            min(voltage_v) AS min_voltage_v, avg(temperature_c) AS avg_temp, max(temperature_c) AS max_temp,
            max(test_time_s) - min(test_time_s) AS cycle_duration_s
          FROM (SELECT *, CASE WHEN pos % 5 <> 0 THEN pos*current_a/60.0 END AS q FROM fx_duty WHERE pos BETWEEN 4 AND 19) a GROUP BY cell_id, cyc""")
def _(spark, sf_dir):
    pos = F.col("pos")
    blocks = fixtures.duty(spark, sf_dir).withColumns({
        "cycle": F.col("cyc"), "measurement": F.when(pos.between(4, 19), "C1dc").otherwise("OCVch"),
        "capacity_ah_curve": F.when(pos % 5 != 0, pos * F.col("current_a") / 60.0)})
    return anchored.summarize_characterisation(blocks)


# Channel n of a file is supplier n; channel 4 has no item, channel 6 no charge; texts name two channels at once.
VIEWS["cs_rows"] = """
SELECT *, CAST(substr(cell_id, 6) AS INT) AS n, CASE WHEN CAST(substr(cell_id, 6) AS INT) % 10 = 6 THEN 0 ELSE rn*CAST(0.01 AS DOUBLE) END AS q
FROM fx_duty WHERE rn % 11 <> 3 AND CAST(substr(cell_id, 6) AS INT) % 10 <> 4"""
VIEWS["cs_scan"] = """
SELECT 'PLN_' || printf('%03d', n + 7) AS cell_id, n + 7 AS item_id, rn, CASE WHEN fin > 0 THEN greatest(0, least(100, 100*(1 - q/fin))) END AS soc,
  CASE WHEN k = 1 AND fin > 0 THEN fin END AS capacity_ah FROM (
  SELECT *, max(q) OVER (PARTITION BY n) AS fin, row_number() OVER (PARTITION BY n ORDER BY test_time_s DESC) AS k FROM cs_rows) a"""


def channels(spark, sf_dir):
    n = F.substring("cell_id", 6, 9).cast("int")
    rows = fixtures.duty(spark, sf_dir).withColumns({"n": n, "file": F.concat(F.lit("lot"), n % 3)})
    samples = rows.select(
        "file", F.format_string("%03d", "n").alias("channel"), F.col("test_time_s").alias("time_s"), "voltage_v",
        F.when(F.col("rn") % 11 != 3, F.col("current_a")).alias("current_a"), F.col("rn").alias("cycle"),
        F.when(n % 10 == 6, 0.0).otherwise(F.col("rn") * 0.01).alias("discharge_ah"))
    known = rows.where(n % 10 != 4).select("file", "n").distinct()
    info = known.select("file", F.concat_ws(" ", F.format_string("Ch-%02d pln - %d", "n", F.col("n") + 7),
                                            F.format_string("ch - %d PLN-%03d", "n", F.col("n") + 7)).alias("text"))
    return anchored.scan_characterisation(samples, info)


@query("src_scan_capacity_characterisation", "cell_id:s item_id:i rn:i soc:d6 capacity_ah:d6", "SELECT * FROM cs_scan")
def _(spark, sf_dir):
    return channels(spark, sf_dir).withColumn("rn", F.col("cycle"))


@query("src_initial_capacity", "item_id:i initial_capacity_ah:d6",
       "SELECT item_id, capacity_ah AS initial_capacity_ah FROM cs_scan WHERE capacity_ah IS NOT NULL")
def _(spark, sf_dir):
    return anchored.initial_capacity(channels(spark, sf_dir))
