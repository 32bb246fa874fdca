"""Registered queries: what batteries remember of telemetry that came in pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog import duty_views  # noqa: F401
from voltloom.catalog.base import query
from voltloom.operators.memory import Memory
from voltloom.session import shared_dir, staged


def remembered(spark, sf_dir) -> Memory:
    """The duty log as three pieces per battery: the last comes first, and some come again under another name.

    Pieces are deliveries, so they are stored: each is read several times.
    """
    log = fixtures.duty(spark, sf_dir).withColumnsRenamed({"cell_id": "battery_id", "rn": "seq"}).withColumn(
        "piece_id", F.least(F.floor(F.col("cyc") / 7), F.lit(2)))
    log = staged(log)
    memory = Memory(spark, f"{shared_dir(spark).rstrip('/')}/memory/{uuid.uuid4().hex}")
    again = lambda n: log.where(F.col("piece_id") == n).withColumn("piece_id", F.lit(10 + n).cast("bigint"))
    for delivery in (log.where("piece_id = 2"), log.where("piece_id < 2").unionByName(again(2)).unionByName(again(0))):
        memory.absorb(delivery, chunk_s=fixtures.DUTY_CHUNK_S)
    return memory


@query("str_battery_memory_update",
       "cell_id:s soh:d6 uncertainty:d6 n_measurable:i n_accepted:i n_discharges:i resistance_growth:d6 telemetry_pieces:i",
       """SELECT r.*, p.telemetry_pieces FROM s_report r JOIN (
            SELECT cell_id, count(DISTINCT least(CAST(floor(cyc/7.0) AS INT), 2)) AS telemetry_pieces FROM fx_duty GROUP BY cell_id) p
          ON r.cell_id = p.cell_id""")
def _(spark, sf_dir):
    """Pieces in any order, some twice, give the report of the whole log."""
    return remembered(spark, sf_dir).current()


@query("str_battery_memory_readings",
       "cell_id:s cycle:i charge_ah:d6 mean_current_a:d6 avg_temp:d6 r_step_ohm:d6 r_trailing_ohm:d6 soh_window_accepted:d6",
       """SELECT d.cell_id, d.cycle, d.charge_ah, d.mean_current_a, d.avg_temp, s.r_step_ohm, g.r_trailing_ohm, g.soh_window_accepted
          FROM d_dis d LEFT JOIN d_step s ON d.cell_id = s.cell_id AND d.cycle = s.cycle
          LEFT JOIN s_gated g ON d.cell_id = g.cell_id AND d.cycle = g.cycle""")
def _(spark, sf_dir):
    return remembered(spark, sf_dir).conditions()
