"""What each battery remembers of itself: telemetry pieces are absorbed once, in any order.

An estimate needs little of the past. Kept are, in four tables under one
folder, the content keys of absorbed pieces, one row per discharge (charge,
current, step resistance, temperature), the discharge curves inside the band
of voltages that a shifted window can reach, and the readings (number,
trailing resistance, window charge). The samples themselves are not kept.

Tables are only appended to, each row with the number of its batch; a batch
counts once its keys are written, which happens last, so a lost driver leaves
rows that nothing reads. Rows are laid out in folders by batch and by bucket
of the battery: a delivery reads and writes the buckets of its own batteries.

A discharge is known by its battery and its start; the same start in another
piece is the same discharge. Trailing resistances continue from the stored
ones: the series of an affected battery, one row per discharge, is gone
through again, but a window charge is computed anew only where the discharge
is new or its ohmic drop has changed (an older piece came late, so later
steps see another past). Numbers, drops and charges are those of the whole log at
once, whatever the order of the pieces; pieces must be cut at rest, not inside
a discharge.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltloom.operators import curves, phases, soh, twin
from voltloom.operators.ordered import with_ordinal
from voltloom.session import staged

BUCKETS = 64
#: The window may move down by this much; a larger drop leaves no reading.
MAX_DROP_V = 1.0
SPAN_S = 90 * 86_400.0

TABLES = {
    "keys": "battery_id string, content_key string, batch string, bucket int",
    "discharges": "battery_id string, start_time_s double, end_time_s double, charge_ah double, n_samples bigint, "
                  "mean_current_a double, avg_temp double, r_step_ohm double, content_key string, batch string, bucket int",
    "curves": "battery_id string, start_time_s double, test_time_s double, seq bigint, voltage_v double, "
              "capacity_ah_curve double, content_key string, batch string, bucket int",
    "readings": "battery_id string, start_time_s double, ir_drop_v double, r_trailing_ohm double, window_charge_ah double, "
                "cycle_charge_ah double, batch string, bucket int",
}


def bucket_of(battery: str | Column = "battery_id") -> Column:
    return F.pmod(F.xxhash64(battery), F.lit(BUCKETS)).cast("int")


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Memory:
    """The tables of one folder, and the window of voltages that its readings use."""

    spark: SparkSession
    path: str
    v_low: float = curves.V_LOW
    v_high: float = curves.V_HIGH
    rest_below_a: float = phases.REST_BELOW_A

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TABLES[name])

    def _write(self, df: DataFrame, name: str, batch: str) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows = df.withColumns({"batch": F.lit(batch), "bucket": bucket_of()}).select(*columns)
        if "start_time_s" in columns:  # few files, and a battery with most of the rows in more than one task
            rows = rows.repartition("bucket", F.floor(F.col("start_time_s") / SPAN_S))
        rows.write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.path}/{name}")

    def keys(self) -> DataFrame:
        return self._read("keys")

    def _counted(self, name: str, batteries: DataFrame | None) -> DataFrame:
        """Rows of whole batches, of the given batteries only; their buckets prune the folders."""
        rows = self._read(name).join(self.keys().select("batch").distinct(), "batch", "left_semi")
        if batteries is None:
            return rows
        return rows.join(batteries.select("battery_id", bucket_of().alias("bucket")), ["battery_id", "bucket"], "left_semi")

    def discharges(self, batteries: DataFrame | None = None) -> DataFrame:
        """One row per discharge, numbered by start."""
        rows = _newest(self._counted("discharges", batteries), ["battery_id", "start_time_s"], [F.col("content_key")])
        return with_ordinal(rows, ["battery_id"], ["start_time_s"], F.floor(F.col("start_time_s") / SPAN_S), "cycle")

    def readings(self, batteries: DataFrame | None = None) -> DataFrame:
        """The reading of each discharge that counts: of the last batch that wrote one."""
        order = self.keys().select("batch").distinct().select("batch", F.substring_index("batch", "-", 1).cast("bigint").alias("_no"))
        rows = self._counted("readings", batteries).join(order, "batch")
        return _newest(rows, ["battery_id", "start_time_s"], [F.desc("_no")]).drop("_no")

    def _next(self) -> str:
        last = self.keys().agg(F.max(F.substring_index("batch", "-", 1).cast("bigint"))).first()[0]
        return f"{(last or 0) + 1}-{uuid.uuid4().hex[:8]}"

    def absorb(self, pieces: DataFrame, chunk_s: float = phases.DAY_S) -> int:
        """Takes in what is new of ``pieces`` (battery_id, piece_id and samples); the number of new pieces."""
        fresh = staged(twin.new_pieces(pieces, self.keys()))
        batteries = staged(fresh.select("battery_id").distinct())
        taken = fresh.count()
        if not taken:
            return 0
        batch = self._next()
        # A piece is cut on its own: what ends one piece never touches the next.
        part = F.concat_ws(":", F.length("battery_id").cast("string"), "battery_id", F.col("piece_id").cast("string"))
        named = fresh.withColumn("cell_id", part)
        samples = pieces.join(named, ["battery_id", "piece_id"]).drop("battery_id", "piece_id", "content_key")
        cut = phases.segment(phases.Log(samples, chunk_s=chunk_s, rest_below_a=self.rest_below_a))
        found = staged(cut.discharges)
        steps = curves.step_resistance(found, self.rest_below_a).select("cell_id", "cycle", "r_step_ohm")
        whose = named.select("cell_id", "battery_id", "content_key")
        warm = F.col("avg_temp") if "avg_temp" in found.columns else F.lit(None).cast("double")
        rows = found.withColumn("avg_temp", warm).join(steps, ["cell_id", "cycle"], "left").join(whose, "cell_id")
        self._write(rows, "discharges", batch)
        starts = found.select("cell_id", "cycle", "start_time_s")
        lines = curves.discharge_curves(cut).join(starts, ["cell_id", "cycle"]).join(whose, "cell_id")
        # The sample with most charge stays too: the whole charge is read from it.
        top = F.max("capacity_ah_curve").over(Window.partitionBy("cell_id", "cycle"))
        near = F.col("voltage_v").between(self.v_low - MAX_DROP_V, self.v_high)
        self._write(self._edges(lines.withColumn("_top", top), near).drop("_top"), "curves", batch)
        # The keys are not written yet, so this batch's rows are read beside the counted ones.
        self._write(self._continued(batch, batteries), "readings", batch)
        self._write(fresh, "keys", batch)
        return taken

    def _edges(self, lines: DataFrame, near: Column) -> DataFrame:
        """Samples in the band, the nearest ones beyond it on either side in voltage, and the one of most charge."""
        one = ["cell_id", "cycle"]
        v, at = F.col("voltage_v"), F.struct("test_time_s", "seq")
        ends = lines.groupBy(*one).agg(
            F.min_by(at, F.when(v >= self.v_high, F.struct(v, at))).alias("_above"),
            F.max_by(at, F.when(v <= self.v_low - MAX_DROP_V, F.struct(v, at))).alias("_below"))
        kept = lines.join(ends, one).where(
            near | (at == F.col("_above")) | (at == F.col("_below")) | (F.col("capacity_ah_curve") == F.col("_top")))
        return kept.drop("_above", "_below")

    def _with(self, name: str, batch: str, batteries: DataFrame) -> DataFrame:
        mine = self._read(name).where(F.col("batch") == batch)
        return self._counted(name, batteries).unionByName(mine)

    def _continued(self, batch: str, batteries: DataFrame) -> DataFrame:
        """New readings of the batteries: of new discharges, and of those whose ohmic drop has changed."""
        one = ["battery_id", "start_time_s"]
        rows = _newest(self._with("discharges", batch, batteries), one, [F.col("content_key")])
        rows = staged(with_ordinal(rows, ["battery_id"], ["start_time_s"], F.floor(F.col("start_time_s") / SPAN_S), "cycle"))
        steps = rows.where("n_samples >= 2").select(
            F.col("battery_id").alias("cell_id"), "cycle", "start_time_s", "mean_current_a", "r_step_ohm")
        trail = curves.trailing_resistance(curves.screen_steps(staged(steps))).select(
            F.col("cell_id").alias("battery_id"), "start_time_s", "ir_drop_v", "r_trailing_ohm")
        trail = trail.withColumn("ir_drop_v", F.when(F.col("ir_drop_v") <= MAX_DROP_V, F.col("ir_drop_v")))
        known = self.readings(batteries).select(*one, F.col("ir_drop_v").alias("_drop"), F.col("r_trailing_ohm").alias("_r"))
        changed = staged(trail.join(known, one, "left").where(
            ~(F.col("_drop").eqNullSafe(F.col("ir_drop_v")) & F.col("_r").eqNullSafe(F.col("r_trailing_ohm")))).select(*one, "ir_drop_v", "r_trailing_ohm"))
        # Of a discharge that two pieces hold, the curve of the row that counts.
        which = rows.select(*one, "content_key")
        lines = self._with("curves", batch, batteries).join(changed, one).join(which, [*one, "content_key"])
        drop = F.col("ir_drop_v")
        return curves.window_charge(lines, one, self.v_low - drop, self.v_high - drop, extra=[
            F.first("ir_drop_v").alias("ir_drop_v"), F.first("r_trailing_ohm").alias("r_trailing_ohm")])

    def charges(self, batteries: DataFrame | None = None) -> DataFrame:
        """(cell_id, cycle, window_charge_ah, cycle_charge_ah, ir_drop_v, r_trailing_ohm) from memory alone."""
        numbers = self.discharges(batteries).select("battery_id", "start_time_s", "cycle")
        return self.readings(batteries).where("ir_drop_v IS NOT NULL").join(numbers, ["battery_id", "start_time_s"]).select(
            F.col("battery_id").alias("cell_id"), "cycle", "window_charge_ah", "cycle_charge_ah", "ir_drop_v", "r_trailing_ohm")

    def table(self, batteries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The gated table per discharge, and the discharges, as a replay of the whole log gives them."""
        discharges = staged(self.discharges(batteries).withColumnRenamed("battery_id", "cell_id"))
        return staged(soh.field_gates(soh.soh_table(staged(self.charges(batteries))), discharges)), discharges

    def current(self, batteries: DataFrame | None = None) -> DataFrame:
        """One row per battery: state of health, or why there is none, and how much is remembered."""
        table, discharges = self.table(batteries)
        pieces = self.keys().groupBy(F.col("battery_id").alias("cell_id")).agg(F.count(F.lit(1)).alias("telemetry_pieces"))
        return soh.current_soh(table, discharges).join(pieces, "cell_id", "left")

    def conditions(self, batteries: DataFrame | None = None) -> DataFrame:
        """Each discharge with its current, temperature and accepted state of health."""
        table, discharges = self.table(batteries)
        return discharges.select("cell_id", "cycle", "charge_ah", "mean_current_a", "avg_temp", "r_step_ohm").join(
            table.select("cell_id", "cycle", "r_trailing_ohm", "soh_window_accepted"), ["cell_id", "cycle"], "left")
