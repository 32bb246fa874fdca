"""Registered queries: file scans and streams, over files Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltloom import fixtures, schema
from voltloom.catalog.base import query
from voltloom.catalog.views import VIEWS
from voltloom.catalog.life import cycle_frame
from voltloom.catalog.state import run_of, runs
from voltloom.session import shared_dir, staged
from voltloom.sources import scan
from voltloom.streaming import live


def folder(spark, name):
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


@query("src_scan_unified_csv", "cell_id:s cycle:i test_time_s:s voltage_v:d6 current_a:d6 soc_band:s mode_guess:s",
       """SELECT cell_id, cycle, CAST(CAST(test_time_s AS INT) AS VARCHAR) AS test_time_s, voltage_v, current_a,
          CASE WHEN soc < 20 THEN 'low_0_20' WHEN soc < 80 THEN 'normal_20_80' WHEN soc < 90 THEN 'elevated_80_90' ELSE 'high_90_100' END AS soc_band,
          CASE WHEN current_a > 0.02 THEN 'charge' WHEN current_a < -0.02 THEN 'discharge' ELSE 'rest' END AS mode_guess FROM fx_telemetry""")
def _(spark, sf_dir):
    out = folder(spark, "unified") + ".csv"
    fixtures.telemetry(spark, sf_dir).select(
        F.col("cell_id").alias("Battery_ID"), F.col("cycle").alias("Cycle Number"), F.col("test_time_s").cast("int").alias("test_time_s"),
        F.col("voltage_v").alias("Voltage"), F.col("current_a").alias("Current"), "soc").write.option("header", True).csv(out)
    return scan.unified_csv(spark, out, {"dataset": "demo"})


@query("src_scan_table_any", "cell_id:s n:i", "SELECT cell_id, 2*count(*) AS n FROM fx_telemetry GROUP BY cell_id")
def _(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir).select("cell_id", "seq")
    a, b = folder(spark, "any") + ".txt", folder(spark, "any") + ".json"
    t.write.option("header", True).option("sep", ";").csv(a)
    t.write.json(b)
    both = scan.table_of(spark, a, separator=";").select("cell_id").unionByName(scan.table_of(spark, b).select("cell_id"))
    return both.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


# Three run files a cycle: 0 the rest before a discharge, 1 the discharge, 2 the pause and the charge after it.
VIEWS["run_files"] = """
SELECT *, CASE WHEN pos < 4 THEN 0 WHEN pos < 20 THEN 1 ELSE 2 END AS part FROM fx_duty"""
VIEWS["run_dis"] = "SELECT DISTINCT cell_id, cyc FROM run_files WHERE part = 1"


@query("src_scan_run_files_with_manifest", "cell_id:s rn:i type:s cycle:i soc:d6 capacity_ah:d6",
       """SELECT cell_id, rn, CASE WHEN d THEN 'discharge' ELSE 'charge' END AS type, no AS cycle,
          greatest(0, least(100, CASE WHEN d THEN 100*(1 - used/0.4) ELSE 100*used/2.0 END)) AS soc,
          CASE WHEN d AND back = 1 THEN CAST(0.4 AS DOUBLE) END AS capacity_ah FROM (
           SELECT *, sum(abs(current_a)*dt/3600.0) OVER (PARTITION BY cell_id, cyc, part ORDER BY rn) AS used,
             row_number() OVER (PARTITION BY cell_id, cyc, part ORDER BY rn DESC) AS back FROM (
             SELECT f.*, f.part = 1 AS d, n.no, coalesce(test_time_s - lag(test_time_s) OVER (PARTITION BY f.cell_id, f.cyc, f.part ORDER BY rn), 0) AS dt
             FROM run_files f JOIN (
               SELECT u.cell_id, u.cyc, u.part, min(e.no) AS no FROM (SELECT DISTINCT cell_id, cyc, part FROM run_files) u
               JOIN (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cyc) AS no FROM run_dis) e
               ON u.cell_id = e.cell_id AND e.cyc >= u.cyc + CASE WHEN u.part = 2 THEN 1 ELSE 0 END GROUP BY u.cell_id, u.cyc, u.part) n
             ON f.cell_id = n.cell_id AND f.cyc = n.cyc AND f.part = n.part) b) c""")
def _(spark, sf_dir):
    """Whole cycles: every sample of the log is in one of the run files; a charge takes the next discharge's number."""
    part = F.when(F.col("pos") < 4, 0).when(F.col("pos") < 20, 1).otherwise(2)
    d = fixtures.duty(spark, sf_dir).withColumn("part", part)
    named = staged(d.withColumns({"filename": F.concat_ws("_", "cell_id", "cyc", "part"), "seq": F.col("rn")}))
    manifest = named.groupBy("filename", F.col("cell_id").alias("battery_id"), "cyc", "part").agg(F.count(F.lit(1))).select(
        "filename", "battery_id", (F.col("cyc") * 3 + F.col("part")).alias("uid"),
        F.when(F.col("part") == 1, "discharge").otherwise("charge").alias("type"), F.lit(0.4).alias("capacity"))
    return scan.runs_with_manifest(named.drop("cell_id"), manifest)


#: Files of one cell that one task writes at most.
CELL_FILES = 16


def export_cells(log, columns, out):
    """A header CSV file for each (cell, part), all files of a cell in the cell's directory.

    Making a directory costs as much as making a file. A file's lines are one
    row, so the writer puts it into a file of its own without a directory for
    it; a task gets up to ``CELL_FILES`` files of a cell, so that it makes the
    cell's directory once, and a cell with many files is still dealt out.
    """
    dealt = log.withColumn("many", F.floor(F.col("part") / CELL_FILES)).repartition("cell_id", "many")
    lines = F.collect_list(F.to_csv(F.struct(*columns)))
    files = dealt.groupBy("cell_id", "many", "part").agg(F.concat_ws("\n", F.lit(",".join(columns)), lines).alias("text"))
    files.select("cell_id", "text").write.partitionBy("cell_id").option("maxRecordsPerFile", 1).text(out)


@query("src_scan_cell_directory", "cell_id:s n_rows:i n_bad:i n_files:i",
       "SELECT cell_id, count(*) AS n_rows, 0 AS n_bad, count(DISTINCT CAST(floor(cyc/8.0) AS INT)) AS n_files FROM fx_duty GROUP BY cell_id")
def _(spark, sf_dir):
    out = folder(spark, "cells")
    columns = {"test_time_s": "double", "current_a": "double", "voltage_v": "double"}
    export_cells(fixtures.duty(spark, sf_dir).withColumn("part", F.floor(F.col("cyc") / 8)), list(columns), out)
    _, report = scan.cell_directory(spark, out, columns)
    cell = F.regexp_extract("path", r"cell_id=([^/]+)/", 1)
    return report.groupBy(cell.alias("cell_id")).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"), F.count(F.lit(1)).alias("n_files"))


@query("src_scan_nested_characterisation", "cell_id:s cycle:i measurement:s test_time_s:d3 capacity_ah_curve:d6",
       """SELECT cell_id, cyc AS cycle, 'C1dc' AS measurement, test_time_s, abs(current_a) AS capacity_ah_curve FROM fx_duty WHERE cyc % 2 = 0""")
def _(spark, sf_dir):
    d = fixtures.duty(spark, sf_dir)
    arrays = d.groupBy("cell_id", F.col("cyc").alias("cycle")).agg(F.array_sort(F.collect_list(
        F.struct("test_time_s", "voltage_v", (F.col("current_a") * 1000).alias("q"), "temperature_c"))).alias("s"))
    q = F.col("s.q")
    block = F.struct(F.col("s.test_time_s").alias("t"), F.col("s.voltage_v").alias("v"),
                     F.when(F.col("cycle") % 2 == 0, q).otherwise(F.slice(q, 1, F.size(q) - 1)).alias("q"), F.col("s.temperature_c").alias("temp"))
    return scan.nested_blocks(arrays.select("cell_id", "cycle", F.create_map(F.lit("C1dc"), block).alias("blocks")), 3.0)


@query("src_scan_discharge_records", "cell_id:s cycle:i test_time_s:d3 current_a:d6",
       "SELECT cell_id, cyc AS cycle, test_time_s, current_a FROM fx_duty d WHERE pos >= 4 AND (SELECT count(*) FROM fx_duty z WHERE z.cell_id = d.cell_id AND z.cyc = d.cyc AND z.current_a < -0.05) >= 5")
def _(spark, sf_dir):
    d = fixtures.duty(spark, sf_dir)
    arrays = d.groupBy("cell_id", F.col("cyc").alias("cycle")).agg(F.array_sort(F.collect_list(
        F.struct("test_time_s", "voltage_v", "current_a", "temperature_c"))).alias("s"))
    rec = arrays.select("cell_id", "cycle", F.lit(24.0).alias("ambient_c"), F.col("s.test_time_s").alias("time"), F.col("s.voltage_v").alias("voltage"),
                        F.col("s.current_a").alias("current"), F.col("s.temperature_c").alias("temperature"))
    return scan.discharge_records(rec)


@query("src_dataset_registry_scan", "cell_id:s cohort:s n:i",
       "SELECT cell_id, 'LAB_A' AS cohort, count(*) AS n FROM fx_cycles GROUP BY cell_id")
def _(spark, sf_dir):
    out = folder(spark, "registry") + ".parquet"
    cycle_frame(spark, sf_dir).drop("cohort").withColumnRenamed("capacity_ah", "cap").write.parquet(out)
    df = scan.Dataset("lab_a", out, {"cap": "capacity_ah"}, "LAB_A").load(spark)
    return df.groupBy("cell_id", "cohort").agg(F.count(F.lit(1)).alias("n"))


@query("src_sink_stage_tables", "stage:s n:i",
       "SELECT 'summary' AS stage, count(*) AS n FROM battery_summary UNION ALL SELECT 'features', count(*) FROM stressed")
def _(spark, sf_dir):
    from voltloom.operators.usage import summarize_batteries
    from voltloom.plans.fleet import behaviour
    out = folder(spark, "stages")
    features = staged(behaviour(fixtures.telemetry(spark, sf_dir)))
    scan.write_stages({"features": features, "summary": summarize_batteries(features)}, out)
    count = lambda n: spark.read.parquet(f"{out}/{n}").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(n))
    return count("features").unionByName(count("summary"))


@query("src_incremental_append_resume", "cell_id:s n:i", "SELECT cell_id, count(*) AS n FROM fx_cycles GROUP BY cell_id")
def _(spark, sf_dir):
    out = folder(spark, "append")
    frame = cycle_frame(spark, sf_dir)
    count = lambda d: d.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    scan.append_new(frame.where("cohort < 'COHORT_3'"), out, "cell_id", count)
    scan.append_new(frame, out, "cell_id", count)
    return spark.read.parquet(out)


@query("src_stream_wire_lines", "record_type:s n:i",
       """SELECT 'noise' AS record_type, count(*) AS n FROM w_counts UNION ALL SELECT 'hello', count(*) FROM w_counts UNION ALL SELECT 'status', count(*) FROM w_counts
          UNION ALL SELECT CASE WHEN fate = 'ok' THEN 'data' ELSE 'rejected' END, count(*) FROM w_rec GROUP BY 1""")
def _(spark, sf_dir):
    src, out = folder(spark, "lines"), folder(spark, "ingest")
    fixtures.lines(spark, sf_dir).write.json(src)
    live.ingest(live.lines_of(spark, src), f"{out}/raw", f"{out}/decoded", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/decoded").groupBy("record_type").agg(F.count(F.lit(1)).alias("n"))


@query("str_transition_stream", "battery_id:s from_state:s to_state:s run:i",
       """SELECT battery_id, was AS from_state, twin_state AS to_state, run FROM (
            SELECT *, lag(twin_state) OVER (PARTITION BY battery_id ORDER BY run) AS was FROM t_snap) s WHERE was IS DISTINCT FROM twin_state""")
def _(spark, sf_dir):
    src, out = folder(spark, "snapshots"), folder(spark, "transitions")
    runs(spark, sf_dir).select("battery_id", "twin_state", "evaluated_at").write.parquet(src)
    stream = spark.readStream.schema("battery_id STRING, twin_state STRING, evaluated_at TIMESTAMP").parquet(src)
    q = (live.transition_stream(stream).writeStream.format("parquet").option("path", f"{out}/t")
         .option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(live.TRANSITION).parquet(f"{out}/t").withColumn("run", run_of("at"))


@query("str_live_phase_counter", "cell_id:s test_time_s:d3 phase:s phase_mah:d4 alarm:s",
       """SELECT cell_id, test_time_s, phase, sum(CASE WHEN dt IS NULL THEN 0 ELSE abs(current_a)*dt/3.6 END) OVER (PARTITION BY cell_id, island ORDER BY rn) AS phase_mah,
            CASE WHEN phase = 'discharge' AND voltage_v < 3.4 THEN 'low voltage under load' WHEN temperature_c > 31 THEN 'cell too hot' ELSE '' END AS alarm
          FROM (SELECT *, sum(turn) OVER (PARTITION BY cell_id ORDER BY rn) AS island FROM (
            SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY cell_id ORDER BY rn) THEN 1 ELSE 0 END AS turn,
              test_time_s - lag(test_time_s) OVER (PARTITION BY cell_id ORDER BY rn) AS dt FROM (
              SELECT *, CASE WHEN abs(current_a) < 0.02 THEN 'rest' WHEN current_a < 0 THEN 'discharge' ELSE 'charge' END AS phase FROM fx_duty) a) b) c""")
def _(spark, sf_dir):
    src, out = folder(spark, "samples"), folder(spark, "watch")
    cols = "cell_id STRING, test_time_s DOUBLE, current_a DOUBLE, voltage_v DOUBLE, temperature_c DOUBLE"
    fixtures.duty(spark, sf_dir).select("cell_id", "test_time_s", "current_a", "voltage_v", "temperature_c").write.parquet(src)
    q = (live.watch_stream(spark.readStream.schema(cols).parquet(src), 3.4, 31.0).writeStream.format("parquet")
         .option("path", f"{out}/t").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(live.WATCH).parquet(f"{out}/t")
