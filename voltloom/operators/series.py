"""Time stitching, cycle numbering, thinning and positions inside a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.operators.ordered import BLOCK_ROWS, exact_quantiles, lagged, running, with_ordinal
from voltloom.session import staged


def stitched_time(df: DataFrame, keys: Sequence[str], ordinal: str, time: str = "test_time_s") -> DataFrame:
    """Every restart of the clock continues one typical positive step after the end before it.

    ``ordinal`` numbers the rows as they arrived. The typical step is the
    median of the positive steps of the key.
    """
    keys = list(keys)
    rows = staged(lagged(df, keys, ordinal, {"_was": time}, size=BLOCK_ROWS))
    step = F.col(time) - F.col("_was")
    typical = exact_quantiles(rows.withColumn("_step", F.when(step > 0, step)), keys, "_step", {"_typical": 0.5})
    joined = rows.join(typical, keys, "left")
    jump = F.when(step < 0, F.coalesce("_typical", F.lit(1.0)) - step).otherwise(F.lit(0.0))
    shifted = running(joined, keys, ordinal, sums={"_offset": jump}, size=BLOCK_ROWS)
    return shifted.withColumn("time_s", F.col(time) + F.col("_offset")).drop("_was", "_typical", "_offset")


def segment_time(df: DataFrame, keys: Sequence[str], ordinal: str, time: str = "test_time_s") -> DataFrame:
    """Whole-life variant: per restart segment, time since its start after the earlier spans."""
    keys = list(keys)
    size = BLOCK_ROWS
    rows = lagged(df, keys, ordinal, {"_was": time}, size=size)
    cut = running(rows, keys, ordinal, sums={
        "segment": F.when(F.col(time) < F.col("_was"), 1).otherwise(0)}, size=size).drop("_was")
    cut = staged(cut)
    spans = cut.groupBy(*keys, "segment").agg(F.min(time).alias("_t0"), (F.max(time) - F.min(time)).alias("_span"))
    spans = spans.withColumn("_ord", F.col("segment") + 1)
    starts = running(staged(spans), keys, "_ord", sums={"_base": F.col("_span")}, before=True, size=size)
    return cut.join(starts.select(*keys, "segment", "_t0", "_base"), [*keys, "segment"]).withColumn(
        "time_s", F.col(time) - F.col("_t0") + F.coalesce("_base", F.lit(0.0))).drop("_t0", "_base")


def reconciled_cycles(df: DataFrame, key: str, file_order: str, cycle: str = "cycle") -> DataFrame:
    """Cycle numbers that restart in every file become one running count.

    A file without cycle numbers counts as one cycle. Files per cell are few.
    """
    spans = df.groupBy(key, file_order).agg(F.min(cycle).alias("_lo"), F.max(cycle).alias("_hi"))
    spans = spans.withColumn("_n", F.coalesce(F.col("_hi") - F.col("_lo") + 1, F.lit(1)))
    w = Window.partitionBy(key).orderBy(file_order).rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(key, file_order, "_lo", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return df.join(starts, [key, file_order]).withColumn(
        "cycle_no", F.coalesce(F.col(cycle) - F.col("_lo"), F.lit(0)) + 1 + F.col("_base")).drop("_lo", "_base")


def evenly_spaced(df: DataFrame, keys: Sequence[str], order: Sequence[str], points: int,
                  chunk: Column | None = None) -> DataFrame:
    """At most ``points`` rows per key at evenly spaced positions, ends included.

    Position k of p is floor(k (n-1) / (p-1)); a row is kept when some k lands
    on it, which is tested from its own number, without a join.
    """
    keys = list(keys)
    numbered = with_ordinal(df, keys, order, chunk, "_no")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    joined = numbered.join(sizes, keys)
    last, at, steps = F.col("_size") - 1, F.col("_no") - 1, F.lit(points - 1)
    k = F.ceil(at * steps / last)
    lands = F.floor(k * last / steps) == at
    return joined.where((F.col("_size") <= points) | lands).drop("_no", "_size")


def thermal_positions(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position 0..1 of every sample inside its discharge, in time order."""
    w = Window.partitionBy(*keys).orderBy("test_time_s", "seq")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return samples.withColumn("fraction", F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(0.0))


def interval_cycles(telemetry: DataFrame, cycles: DataFrame, chunk_s: float) -> DataFrame:
    """Each row gets the cycle whose [start, end] contains it; rows in none are dropped.

    Intervals are spread over the time chunks they touch, so the join key is
    (cell, chunk). Of overlapping cycles the later one wins. Equal rows are
    counted before the join and given back as often as they came.
    """
    spread = cycles.withColumn("_chunk", F.explode(F.sequence(
        F.floor(F.col("start_time_s") / chunk_s), F.floor(F.col("end_time_s") / chunk_s))))
    cells = spread.select("cell_id", "_chunk", "cycle", "start_time_s", "end_time_s")
    own = [c for c in telemetry.columns if c != "cycle"]
    rows = telemetry.groupBy(*own).agg(F.count(F.lit(1)).cast("int").alias("_copies")).withColumn(
        "_chunk", F.floor(F.col("test_time_s") / chunk_s))
    hit = rows.join(cells, ["cell_id", "_chunk"]).where("test_time_s BETWEEN start_time_s AND end_time_s")
    return hit.groupBy(*own, "_copies").agg(F.max("cycle").alias("cycle")).withColumn(
        "_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def nearest_value(left: DataFrame, right: DataFrame, value: str, chunk_s: float, time: str = "test_time_s") -> DataFrame:
    """The nearest-in-time value of ``right`` for each left row; the earlier one on a tie.

    Both sides are laid on one time line per cell. Chunk borders are crossed by
    a table with the first and last value of each chunk.
    """
    tl = left.withColumns({"_side": F.lit(1), "_chunk": F.floor(F.col(time) / chunk_s)})
    tr = right.select("cell_id", time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_r")).withColumns(
        {"_side": F.lit(0), "_chunk": F.floor(F.col(time) / chunk_s)})
    line = tl.unionByName(tr, allowMissingColumns=True)
    edges = tr.groupBy("cell_id", "_chunk").agg(F.min_by("_r", time).alias("_first"), F.max_by("_r", time).alias("_last"))
    chunks = line.select("cell_id", "_chunk").distinct().join(edges, ["cell_id", "_chunk"], "left")
    over = Window.partitionBy("cell_id").orderBy("_chunk")
    near = chunks.select(
        "cell_id", "_chunk",
        F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
        F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_ca"))
    w = Window.partitionBy("cell_id", "_chunk").orderBy(time, "_side")
    filled = line.join(near, ["cell_id", "_chunk"]).withColumns({
        "_b": F.coalesce(F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_cb")),
        "_a": F.coalesce(F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("_ca"))})
    back, ahead = F.col(time) - F.col("_b.t"), F.col("_a.t") - F.col(time)
    pick = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b.v")).otherwise(F.col("_a.v"))
    return filled.where("_side = 1").withColumn(value, pick).drop("_side", "_chunk", "_r", "_b", "_a", "_cb", "_ca")
