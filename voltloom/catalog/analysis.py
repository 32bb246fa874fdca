"""Registered queries: statistics, physics, detection, series shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.base import query
from voltloom.catalog.life import cycle_frame, targets
from voltloom.catalog.sequence import CHUNK_S, duty_log
from voltloom.catalog.views import VIEWS, draw_sql
from voltloom.operators import life, phases, series, stats
from voltloom.session import staged


def ranks_sql(source: str, part: str, x: str, y: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    px = f"PARTITION BY {part + ', ' if part else ''}{x}"
    py = f"PARTITION BY {part + ', ' if part else ''}{y}"
    return (f"SELECT *, rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({px}) - 1)/2.0 AS rx, "
            f"rank() OVER ({p} ORDER BY {y}) + (count(*) OVER ({py}) - 1)/2.0 AS ry FROM {source}")


VIEWS["y_loss"] = """
SELECT *, -(capacity_ah - lag(capacity_ah) OVER (PARTITION BY cell_id ORDER BY cycle)) AS capacity_loss FROM fx_cycles"""
VIEWS["y_rows"] = "SELECT * FROM y_loss WHERE capacity_loss IS NOT NULL"
VIEWS["y_amb"] = """
SELECT *, 20.0 + 10.0*CAST(substr(cohort, 8) AS INT) AS ambient_temperature_c FROM c_targets"""


def losses(spark, sf_dir):
    return staged(life.trailing_features(cycle_frame(spark, sf_dir), ("avg_temp",)).where("capacity_loss IS NOT NULL"))


def ambient(spark, sf_dir):
    return staged(targets(spark, sf_dir).withColumn(
        "ambient_temperature_c", 20.0 + 10.0 * F.substring("cohort", 8, 9).cast("int")))


@query("sta_spearman", "cell_id:s n:i rho:d6",
       "SELECT cell_id, count(*) AS n, corr(rx, ry) AS rho FROM (" + ranks_sql("fx_cycles", "cell_id", "avg_stress", "capacity_ah")
       + ") r GROUP BY cell_id")
def _(spark, sf_dir):
    from voltloom.operators.ordered import spearman
    return spearman(cycle_frame(spark, sf_dir), ["cell_id"], "avg_stress", "capacity_ah")


@query("sta_cohort_cycle_association", "cohort:s feature:s n:i pooled_rho:d6 n_cells:i n_positive:i",
       "\nUNION ALL\n".join(
           f"SELECT a.cohort, '{f}' AS feature, a.n, a.rho AS pooled_rho, b.n_cells, b.n_positive FROM (SELECT cohort, count(*) AS n, corr(rx,ry) AS rho FROM ("
           + ranks_sql("y_rows", "cohort", f, "capacity_loss") + ") r GROUP BY cohort) a JOIN (SELECT cohort, count(*) AS n_cells, count(CASE WHEN rho > 0 THEN 1 END) AS n_positive FROM (SELECT cohort, cell_id, corr(rx,ry) AS rho FROM ("
           + ranks_sql("y_rows", "cell_id", f, "capacity_loss") + ") r GROUP BY cohort, cell_id HAVING count(*) >= 3) c GROUP BY cohort) b ON a.cohort = b.cohort"
           for f in ("avg_temp", "avg_stress")))
def _(spark, sf_dir):
    return stats.cohort_association(losses(spark, sf_dir), ("avg_temp", "avg_stress"), "capacity_loss")


VIEWS["mw_c"] = """
SELECT cell_id, avg_stress > 30 AS f, capacity_loss - quantile_cont(capacity_loss, 0.5) OVER (PARTITION BY cell_id) AS v,
  count(CASE WHEN avg_stress > 30 THEN 1 END) OVER (PARTITION BY cell_id) AS a,
  count(CASE WHEN NOT avg_stress > 30 THEN 1 END) OVER (PARTITION BY cell_id) AS b FROM y_rows"""
VIEWS["mw_r"] = """
SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1)/2.0 AS r FROM mw_c WHERE a > 0 AND b > 0"""


@query("sta_mann_whitney", "n_cells:i n_flagged:i n_unflagged:i u_statistic:d2 z:d5 verdict:s",
       """SELECT *, CASE WHEN z > 1.6448536269514722 THEN 'ASSOCIATED' ELSE 'NOT_ASSOCIATED' END AS verdict FROM (
          SELECT n_cells, n1 AS n_flagged, n2 AS n_unflagged, u AS u_statistic,
            (u - n1*n2/2.0 - 0.5)/sqrt(n1*n2/12.0*((nn+1) - t/(nn*(nn-1.0)))) AS z
          FROM (SELECT count(DISTINCT cell_id) AS n_cells, count(CASE WHEN f THEN 1 END) AS n1, count(CASE WHEN NOT f THEN 1 END) AS n2, count(*) AS nn,
             sum(CASE WHEN f THEN r END) - count(CASE WHEN f THEN 1 END)*(count(CASE WHEN f THEN 1 END)+1)/2.0 AS u,
             (SELECT sum(c*c*c - c) FROM (SELECT count(*) AS c FROM mw_r GROUP BY v) q) AS t FROM mw_r) s) w""")
def _(spark, sf_dir):
    rows = losses(spark, sf_dir).withColumn("f", F.col("avg_stress") > 30)
    return stats.mann_whitney(rows, "f")


VIEWS["pt_cells"] = ranks_sql(
    "(SELECT cell_id, avg(avg_stress) AS s, avg(capacity_ah) AS c FROM fx_cycles GROUP BY cell_id)", "", "s", "c")
VIEWS["pt_order"] = """
SELECT rx, ry, row_number() OVER (ORDER BY CAST('0x' || substr(md5(cell_id),1,8) AS BIGINT), cell_id) AS i FROM pt_cells"""
VIEWS["pt_drawn"] = f"""
SELECT rep, rx, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(11, 'CAST(rep AS BIGINT)', 'CAST(i AS BIGINT)')}, i) AS k
FROM range(1, 5001) r(rep), pt_order"""
VIEWS["pt_rho"] = "SELECT rep, corr(d.rx, o.ry) AS rho FROM pt_drawn d JOIN pt_order o ON o.i = d.k GROUP BY rep"


@query("sta_permutation_test", "n:i rho:d6 p_value:d6",
       """SELECT n, r AS rho, (SELECT count(CASE WHEN abs(rho) >= abs(r) - CAST(1e-12 AS DOUBLE) THEN 1 END) + 1 FROM pt_rho)/CAST(5001 AS DOUBLE) AS p_value
          FROM (SELECT count(*) AS n, corr(rx, ry) AS r FROM pt_cells) q""")
def _(spark, sf_dir):
    cells = staged(cycle_frame(spark, sf_dir).groupBy("cell_id").agg(
        F.avg("avg_stress").alias("s"), F.avg("capacity_ah").alias("c")))
    return stats.permutation_test(cells, "cell_id", "s", "c")


VIEWS["ar_m"] = """
SELECT cohort, 1.0/(avg_temp+273.15) - avg(1.0/(avg_temp+273.15)) OVER w AS a, ln(CAST(cycle AS DOUBLE)) - avg(ln(CAST(cycle AS DOUBLE))) OVER w AS b,
  ln(cumulative_fade) - avg(ln(cumulative_fade)) OVER w AS y
FROM c_targets WHERE cumulative_fade > 0 AND cycle > 0 WINDOW w AS (PARTITION BY cohort)"""


@query("sta_arrhenius_fit", "cohort:s n_used:i activation_kj_per_mol:d2 exponent_z:d4 r2_log_space:d4",
       """SELECT cohort, n AS n_used, -(ay*bb - by_*ab)/(aa*bb - ab*ab)*8.314462618/1000.0 AS activation_kj_per_mol,
          (by_*aa - ay*ab)/(aa*bb - ab*ab) AS exponent_z,
          ((ay*bb - by_*ab)/(aa*bb - ab*ab)*ay + (by_*aa - ay*ab)/(aa*bb - ab*ab)*by_)/yy AS r2_log_space
          FROM (SELECT cohort, count(*) AS n, sum(a*a) AS aa, sum(b*b) AS bb, sum(a*b) AS ab, sum(a*y) AS ay, sum(b*y) AS by_, sum(y*y) AS yy
                FROM ar_m GROUP BY cohort) s""")
def _(spark, sf_dir):
    return stats.arrhenius_fit(targets(spark, sf_dir), ["cohort"])


@query("agg_thermal_baseline", "ambient_temperature_c:d1 baseline_soh:d6 n_cells:i n_rows:i well_estimated:b implied_offset_percent:d5",
       """SELECT ambient_temperature_c, avg(soh) AS baseline_soh, count(DISTINCT cell_id) AS n_cells, count(*) AS n_rows,
          count(DISTINCT cell_id) >= 3 AS well_estimated, (1-avg(soh))*100 AS implied_offset_percent
          FROM y_amb WHERE cycle <= 20 AND soh IS NOT NULL GROUP BY ambient_temperature_c""")
def _(spark, sf_dir):
    return stats.thermal_baseline(ambient(spark, sf_dir))


@query("win_thermal_correction", "cell_id:s cycle:i soh_corrected:d6 horizon_fade_corrected_10:d6",
       """SELECT cell_id, cycle, soh_corrected, (1 - lead(soh_corrected, 10) OVER (PARTITION BY cell_id ORDER BY cycle)) - (1 - soh_corrected) AS horizon_fade_corrected_10
          FROM (SELECT y.*, y.soh/b.m AS soh_corrected FROM y_amb y LEFT JOIN (SELECT ambient_temperature_c AS t, avg(soh) AS m FROM y_amb
             WHERE cycle <= 20 AND soh IS NOT NULL GROUP BY ambient_temperature_c) b ON y.ambient_temperature_c = b.t) z""")
def _(spark, sf_dir):
    return stats.thermal_correction(ambient(spark, sf_dir))


@query("sta_thermal_confound", "n_levels:i early_spread:d6 early_spearman:d6 overall_spearman:d6",
       "SELECT (SELECT count(*) FROM tc_m) AS n_levels, (SELECT max(m)-min(m) FROM tc_m) AS early_spread, (SELECT corr(rx,ry) FROM ("
       + ranks_sql("(SELECT * FROM y_amb WHERE cycle <= 20 AND soh IS NOT NULL)", "", "ambient_temperature_c", "soh") + ") a) AS early_spearman, (SELECT corr(rx,ry) FROM ("
       + ranks_sql("(SELECT * FROM y_amb WHERE soh IS NOT NULL)", "", "ambient_temperature_c", "soh") + ") b) AS overall_spearman",
       {"tc_m": "SELECT ambient_temperature_c, avg(soh) AS m FROM y_amb WHERE cycle <= 20 AND soh IS NOT NULL GROUP BY ambient_temperature_c"})
def _(spark, sf_dir):
    return stats.thermal_confound(ambient(spark, sf_dir))


@query("sta_identifiability", "n_levels:i within_spread:d6 between_spread:d6 early_soh_spread:d6 identifiable:b",
       """SELECT n_levels, w AS within_spread, b AS between_spread, s AS early_soh_spread, n_levels >= 3 AND coalesce(w/b >= 0.25, false) AND NOT s > 0.05 AS identifiable
          FROM (SELECT (SELECT count(DISTINCT ambient_temperature_c) FROM y_amb) AS n_levels, avg(s) AS w, stddev_pop(m) AS b,
             (SELECT max(m)-min(m) FROM (SELECT avg(soh) AS m FROM y_amb WHERE cycle <= 20 AND soh IS NOT NULL GROUP BY ambient_temperature_c) q) AS s
             FROM (SELECT cohort, stddev_pop(avg_temp) AS s, avg(avg_temp) AS m FROM y_amb GROUP BY cohort) c) z""")
def _(spark, sf_dir):
    return stats.identifiability(ambient(spark, sf_dir))


@query("sta_agreement_with_rules", "flag:s n_both:i n_outlier:i n_flag:i precision:d6 recall:d6 flag_rate:d6",
       "\nUNION ALL\n".join(
           f"SELECT '{f}' AS flag, count(CASE WHEN o AND h THEN 1 END) AS n_both, count(CASE WHEN o THEN 1 END) AS n_outlier, count(CASE WHEN h THEN 1 END) AS n_flag, "
           "count(CASE WHEN o AND h THEN 1 END)/nullif(CAST(count(CASE WHEN o THEN 1 END) AS DOUBLE),0) AS precision, "
           "count(CASE WHEN o AND h THEN 1 END)/nullif(CAST(count(CASE WHEN h THEN 1 END) AS DOUBLE),0) AS recall, count(CASE WHEN h THEN 1 END)/CAST(count(*) AS DOUBLE) AS flag_rate "
           f"FROM (SELECT stress_score > 40 AS o, {f} > 0 AS h FROM stressed) s" for f in ("high_temp_flag", "fast_charge_flag")))
def _(spark, sf_dir):
    from voltloom.catalog.fleet import _behaviour
    rows = _behaviour(spark, sf_dir).withColumn("o", F.col("stress_score") > 40)
    return stats.agreement_with_rules(rows, "o", ("high_temp_flag", "fast_charge_flag"))


@query("agg_cluster_flag_profile", "cluster:s high_temp_flag:d6 fast_charge_flag:d6 n_rows:i share:d6",
       """SELECT CASE WHEN soc < 50 THEN 'low' ELSE 'high' END AS cluster, avg(high_temp_flag) AS high_temp_flag, avg(fast_charge_flag) AS fast_charge_flag,
          count(*) AS n_rows, count(*)/CAST((SELECT count(*) FROM stressed) AS DOUBLE) AS share FROM stressed GROUP BY 1""")
def _(spark, sf_dir):
    from voltloom.catalog.fleet import _behaviour
    rows = _behaviour(spark, sf_dir).withColumn("label", F.when(F.col("soc") < 50, "low").otherwise("high"))
    return stats.cluster_flag_profile(rows, "label", ("high_temp_flag", "fast_charge_flag"))


@query("sta_kmeans_segments", "cell_id:s cycle:i cluster:i")
def _(spark, sf_dir):
    return stats.kmeans_segments(cycle_frame(spark, sf_dir), ("avg_temp", "avg_stress", "avg_soc"), 3)


# -- series -----------------------------------------------------------------

VIEWS["r_duty"] = """
SELECT cell_id, rn, CASE WHEN cyc >= 10 THEN test_time_s - 18000 ELSE test_time_s END AS test_time_s FROM fx_duty"""
VIEWS["r_lag"] = "SELECT *, test_time_s - lag(test_time_s) OVER (PARTITION BY cell_id ORDER BY rn) AS dt FROM r_duty"


def reset_log(spark, sf_dir):
    d = fixtures.duty(spark, sf_dir)
    return staged(d.select("cell_id", "rn", F.when(F.col("cyc") >= 10, F.col("test_time_s") - 18_000.0)
                           .otherwise(F.col("test_time_s")).alias("test_time_s")))


@query("win_monotonic_time_stitch", "cell_id:s rn:i time_s:d3",
       """SELECT cell_id, rn, test_time_s + sum(CASE WHEN dt < 0 THEN typ - dt ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY rn) AS time_s
          FROM (SELECT *, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) OVER (PARTITION BY cell_id) AS typ FROM r_lag) a""")
def _(spark, sf_dir):
    return series.stitched_time(reset_log(spark, sf_dir), ["cell_id"], "rn")


@query("win_segment_time_stitch", "cell_id:s rn:i segment:i time_s:d3",
       """SELECT s.cell_id, s.rn, s.segment, s.test_time_s - z.t0 + coalesce((SELECT sum(span) FROM r_span y WHERE y.cell_id = s.cell_id AND y.segment < s.segment), 0) AS time_s
          FROM r_seg s JOIN r_span z ON s.cell_id = z.cell_id AND s.segment = z.segment""",
       {"r_seg": "SELECT *, sum(CASE WHEN dt < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY rn) AS segment FROM r_lag",
        "r_span": "SELECT cell_id, segment, min(test_time_s) AS t0, max(test_time_s) - min(test_time_s) AS span FROM r_seg GROUP BY cell_id, segment"})
def _(spark, sf_dir):
    return series.segment_time(reset_log(spark, sf_dir), ["cell_id"], "rn")


@query("win_cycle_index_reconcile", "cell_id:s rn:i cycle_no:i",
       """SELECT cell_id, rn, cyc + 1 AS cycle_no FROM fx_duty""")
def _(spark, sf_dir):
    d = fixtures.duty(spark, sf_dir).withColumn("file_no", F.floor(F.col("cyc") / 7))
    return series.reconciled_cycles(d.withColumn("cycle", F.pmod(F.col("cyc"), F.lit(7)) + 5), "cell_id", "file_no")


@query("win_thermal_phase_fraction", "cell_id:s phase_no:i test_time_s:d3 fraction:d6",
       """SELECT cell_id, phase_no, test_time_s, CASE WHEN n > 1 THEN (k-1)/CAST(n-1 AS DOUBLE) ELSE 0 END AS fraction FROM (
            SELECT *, row_number() OVER (PARTITION BY cell_id, phase_no ORDER BY test_time_s) AS k, count(*) OVER (PARTITION BY cell_id, phase_no) AS n
            FROM d_samples WHERE kind = 'discharge') s""")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    return series.thermal_positions(phases.with_phase(cut, "discharge"), ["cell_id", "phase_no"])


@query("win_series_downsample", "cell_id:s rn:i voltage_v:d6",
       """SELECT cell_id, rn, voltage_v FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY rn) - 1 AS at_p, count(*) OVER (PARTITION BY cell_id) AS n FROM fx_duty) s
          WHERE n <= 60 OR list_contains(list_transform(range(0, 60), lambda k: CAST(floor(k*(n-1)/59.0) AS BIGINT)), at_p)""")
def _(spark, sf_dir):
    return series.evenly_spaced(staged(fixtures.duty(spark, sf_dir)), ["cell_id"], ["rn"], 60, F.floor(F.col("rn") / 4096))


@query("win_thin_rows_per_cell", "cell_id:s rn:i current_a:d6",
       """SELECT cell_id, rn, current_a FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY rn) - 1 AS at_p, count(*) OVER (PARTITION BY cell_id) AS n FROM fx_duty) s
          WHERE n <= 200 OR list_contains(list_transform(range(0, 200), lambda k: CAST(floor(k*(n-1)/199.0) AS BIGINT)), at_p)""")
def _(spark, sf_dir):
    return series.evenly_spaced(staged(fixtures.duty(spark, sf_dir)), ["cell_id"], ["rn"], 200, F.floor(F.col("rn") / 4096))


@query("jn_cycle_interval_join", "cell_id:s rn:i cycle:i",
       "SELECT s.cell_id, s.rn, d.cycle FROM fx_duty s JOIN d_dis d ON s.cell_id = d.cell_id AND s.test_time_s BETWEEN d.start_time_s AND d.end_time_s")
def _(spark, sf_dir):
    cut = phases.segment(duty_log(spark, sf_dir))
    return series.interval_cycles(fixtures.duty(spark, sf_dir).select("cell_id", "rn", "test_time_s"),
                                  cut.discharges, CHUNK_S)


@query("jn_asof_nearest_temperature", "cell_id:s rn:i temp:d6",
       """SELECT cell_id, rn, t AS temp FROM (SELECT l.cell_id, l.rn, r.temperature_c AS t, row_number() OVER (PARTITION BY l.cell_id, l.rn
             ORDER BY abs(l.test_time_s - r.test_time_s), r.test_time_s) AS k
          FROM fx_duty l JOIN fx_duty r ON l.cell_id = r.cell_id AND r.rn % 9 = 4 AND abs(l.rn - r.rn) <= 12) q WHERE k = 1""")
def _(spark, sf_dir):
    d = fixtures.duty(spark, sf_dir)
    probes = d.where("rn % 9 = 4").select("cell_id", "test_time_s", F.col("temperature_c").alias("temp"))
    return series.nearest_value(d.select("cell_id", "rn", "test_time_s"), probes, "temp", CHUNK_S)
