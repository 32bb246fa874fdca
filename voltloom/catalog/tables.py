"""Registered queries: cycle summaries, sampling, unions, row windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.base import query
from voltloom.catalog.evaluation import draw_sql
from voltloom.catalog.life import cycle_frame
from voltloom.catalog.sequence import duty_log
from voltloom.operators import phases, tables
from voltloom.session import staged


@query("agg_summarize_cycler_cycles",
       "cell_id:s cycle:i capacity_ah:d6 cumulative_ah:d6 duration_s:d3 n_rows:i mean_voltage:d6 min_current:d6 avg_temp:d6 max_temp:d6",
       """SELECT cell_id, cyc AS cycle, max(rn*0.01) - min(rn*0.01) AS capacity_ah, max(rn*0.01) AS cumulative_ah, max(test_time_s)-min(test_time_s) AS duration_s,
          count(*) AS n_rows, avg(voltage_v) AS mean_voltage, min(current_a) AS min_current, avg(temperature_c) AS avg_temp, max(temperature_c) AS max_temp
          FROM fx_duty GROUP BY cell_id, cyc""")
def _(spark, sf_dir):
    log = fixtures.duty(spark, sf_dir).withColumn("discharge_capacity_ah", F.col("rn") * 0.01).withColumnRenamed("cyc", "cycle")
    return tables.summarize_cycler_cycles(log)


@query("prj_temperature_condition_flag", "cell_id:s reference_c:d6 recent_c:d6 reason:s",
       """SELECT *, CASE WHEN least(reference_c, recent_c) < 15 THEN 'measured in the cold' WHEN abs(recent_c-reference_c) > 5
            THEN 'reference and recent discharges differ in temperature' ELSE '' END AS reason FROM (
          SELECT cell_id, quantile_cont(avg_temp, 0.5) FILTER (u <= 5) AS reference_c, quantile_cont(avg_temp, 0.5) FILTER (w <= 5) AS recent_c FROM (
            SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS u, row_number() OVER (PARTITION BY cell_id ORDER BY cycle DESC) AS w FROM d_dis) q GROUP BY cell_id) z""")
def _(spark, sf_dir):
    return tables.temperature_conditions(staged(phases.segment(duty_log(spark, sf_dir)).discharges))


@query("srt_round_robin_cell_sample", "cohort:s cell_id:s turn:i",
       f"""SELECT cohort, cell_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY h, cell_id) AS turn FROM (
            SELECT DISTINCT cohort, cell_id, {draw_sql(7, "CAST('0x' || substr(md5(cell_id),1,8) AS BIGINT)")} AS h FROM fx_cycles) a) b
          ORDER BY turn, cohort LIMIT 8""")
def _(spark, sf_dir):
    return tables.round_robin_cells(cycle_frame(spark, sf_dir), 8)


@query("set_union_runs", "cell_id:s cycle:i avg_temp:d6 avg_soc:d6",
       """SELECT cell_id, cycle, avg_temp, NULL AS avg_soc FROM fx_cycles WHERE cycle % 2 = 0
          UNION ALL SELECT cell_id, cycle, NULL, avg_soc FROM fx_cycles WHERE cycle % 2 <> 0""")
def _(spark, sf_dir):
    x = cycle_frame(spark, sf_dir)
    return tables.union_runs([x.where("cycle % 2 = 0").select("cell_id", "cycle", "avg_temp"),
                              x.where("cycle % 2 <> 0").select("cell_id", "cycle", "avg_soc")])


@query("val_sequence_windows", "cell_id:s cycle:i n_pad:i total:d5",
       """SELECT cell_id, cycle, 10 - n AS n_pad, s + (10 - n)*first_t AS total FROM (SELECT cell_id, cycle, count(*) OVER w AS n, sum(avg_temp) OVER w AS s,
            first_value(avg_temp) OVER w AS first_t FROM fx_cycles WINDOW w AS (PARTITION BY cell_id ORDER BY cycle ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) q""")
def _(spark, sf_dir):
    out = tables.sequence_windows(cycle_frame(spark, sf_dir), ("avg_temp", "avg_soc"))
    return out.withColumn("total", F.aggregate("window", F.lit(0.0), lambda a, r: a + r[0]))


@query("val_method_availability", "feature:s n:i status:s",
       """SELECT 'avg_temp' AS feature, count(avg_temp) AS n, 'available' AS status FROM fx_cycles UNION ALL SELECT 'none', 0, 'missing feature'
          UNION ALL SELECT 'flat', count(*), 'zero-variance feature' FROM fx_cycles""")
def _(spark, sf_dir):
    x = cycle_frame(spark, sf_dir).withColumn("flat", F.lit(1.0))
    return tables.method_availability(x, ("avg_temp", "none", "flat"))


@query("val_shuffle_control", "cell_id:s cycle:i capacity_ah:d6",
       f"""SELECT a.cell_id, a.cycle, b.capacity_ah FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cycle) AS k FROM fx_cycles) a JOIN (
            SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {draw_sql(5, "CAST('0x' || substr(md5(cell_id),1,8) AS BIGINT)", "((CAST(cycle AS BIGINT) % 2147483647 + 2147483647))")}, cycle) AS k FROM fx_cycles) b
          ON a.cell_id = b.cell_id AND a.k = b.k""")
def _(spark, sf_dir):
    return tables.shuffled_within_cells(cycle_frame(spark, sf_dir))


@query("src_record_raw_lines", "capture_id:s n:i",
       "SELECT cell_id AS capture_id, count(*) + 3 AS n FROM fx_telemetry GROUP BY cell_id")
def _(spark, sf_dir):
    from voltloom.catalog.files import folder
    from voltloom.streaming import live
    src, out = folder(spark, "lines"), folder(spark, "record")
    fixtures.lines(spark, sf_dir).write.json(src)
    live.ingest(live.lines_of(spark, src), f"{out}/raw", f"{out}/decoded", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/raw").groupBy("capture_id").agg(F.count(F.lit(1)).alias("n"))
