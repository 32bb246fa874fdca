"""A cell's export files lie in its own directory, one for each part; what a path tells is read once a file."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import functions as F

from voltloom.catalog.files import CELL_FILES, export_cells
from voltloom.sources.scan import cell_directory

COLUMNS = {"test_time_s": "double", "voltage_v": "double"}


def test_each_part_is_a_file_in_its_cells_directory(spark, tmp_path):
    rows = [(c, p, float(k), 3.5 if k else None) for c, parts in (("A_1", CELL_FILES * 2 + 3), ("B 2", 1)) for p in range(parts) for k in range(3)]
    rows += rows[:2]  # equal samples stay
    out = str(tmp_path / "cells")
    export_cells(spark.createDataFrame(rows, "cell_id string, part long, test_time_s double, voltage_v double"), list(COLUMNS), out)
    folders = {d for d, _, names in os.walk(out) if any(n.startswith("part-") for n in names)}
    assert {os.path.basename(d) for d in folders} == {"cell_id=A_1", "cell_id=B 2"}
    log, report = cell_directory(spark, out, COLUMNS)
    got = {r.cell_id: (r.files, r.n, r.bad) for r in report.groupBy("cell_id").agg(
        F.count("path").alias("files"), F.sum("n_rows").alias("n"), F.sum("n_bad").alias("bad")).collect()}
    assert sorted(got.values()) == [(1, 3, 0), (CELL_FILES * 2 + 3, len(rows) - 3, 0)]
    back = sorted((r.test_time_s, r.voltage_v or 0.0) for r in log.collect())
    assert back == sorted((t, v or 0.0) for _, _, t, v in rows)


def test_paths_are_read_once_a_file(spark, tmp_path):
    folder = tmp_path / "cells" / "CELL_7"
    folder.mkdir(parents=True)
    (folder / "late_3_4_21.csv").write_text("test_time_s,voltage_v\n1,3.5\n2,x\n")
    (folder / "early_12_1_20.csv").write_text("test_time_s,voltage_v\n1,3.5\n2,3.6\n")
    log, report = cell_directory(spark, str(tmp_path / "cells"), COLUMNS)
    got = sorted((r.file_no, r.cell_id, r.file_date, r.n_rows, r.n_bad, r.status) for r in report.collect())
    assert got == [(1, "CELL_7", datetime.date(2020, 12, 1), 2, 0, "read"), (2, "CELL_7", datetime.date(2021, 3, 4), 1, 1, "partly read")]
    assert log.columns == ["path", "test_time_s", "voltage_v", "mtime", "cell_id", "file_date", "file_no"]
    assert sorted((r.cell_id, r.file_no, r.test_time_s) for r in log.collect()) == [("CELL_7", 1, 1.0), ("CELL_7", 1, 2.0), ("CELL_7", 2, 1.0)]
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "regexp_extract" not in plan.split("Aggregate [", 1)[1].split("\n", 1)[1]
