"""Streams: wire lines in, raw and decoded tables out, keyed twin and phase state.

Every stream has a batch twin over the same rows; tests compare the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltloom.functions.wire import SENTINEL
from voltloom.sources.wire import decode


def lines_of(spark: SparkSession, folder: str) -> DataFrame:
    """Line files as they arrive: (capture_id, seq, line) as JSON rows."""
    return spark.readStream.schema("capture_id STRING, seq BIGINT, line STRING").json(folder)


def ingest(lines: DataFrame, raw_out: str, decoded_out: str, checkpoint: str, sentinel: str = SENTINEL):
    """Write every line unchanged and its decoding in one micro-batch, so it can be replayed.

    A micro-batch that is retried overwrites its own folder, so no row is
    written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.write.mode("overwrite").parquet(f"{raw_out}/batch={batch_id}")
        decode(kept, sentinel).write.mode("overwrite").parquet(f"{decoded_out}/batch={batch_id}")
        kept.unpersist()

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


TRANSITION = "battery_id STRING, from_state STRING, to_state STRING, at TIMESTAMP"


def _transitions(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("evaluated_at")
    out = []
    for twin, at in zip(rows["twin_state"], rows["evaluated_at"]):
        if twin != last:
            out.append((key[0], last, twin, at))
            last = twin
    state.update((last,))
    yield pd.DataFrame(out, columns=["battery_id", "from_state", "to_state", "at"])


def transition_stream(snapshots: DataFrame) -> DataFrame:
    """Twin transitions of a snapshot stream (battery_id, twin_state, evaluated_at).

    State is one word per battery; a micro-batch brings few snapshots of one battery.
    """
    return snapshots.groupBy("battery_id").applyInPandasWithState(
        _transitions, TRANSITION, "last STRING", "append", GroupStateTimeout.NoTimeout)


WATCH = "cell_id STRING, test_time_s DOUBLE, phase STRING, phase_mah DOUBLE, alarm STRING"


def watch_stream(samples: DataFrame, min_voltage: float, max_temp: float, rest_below_a: float = 0.02) -> DataFrame:
    """Running phase, charge since it began, and alarms, per device."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, mah, last = state.get if state.exists else ("rest", 0.0, None)
        rows = pd.concat(list(batches)).sort_values("test_time_s")
        out = []
        for t, i, v, tc in zip(rows["test_time_s"], rows["current_a"], rows["voltage_v"], rows["temperature_c"]):
            now = "rest" if pd.isna(i) or abs(i) < rest_below_a else ("discharge" if i < 0 else "charge")
            if now != phase:
                phase, mah = now, 0.0
            if last is not None and not pd.isna(i):
                mah += abs(i) * max(t - last, 0.0) / 3.6
            last = t
            alarm = ("low voltage under load" if now == "discharge" and v < min_voltage else
                     "cell too hot" if tc > max_temp else "")
            out.append((key[0], t, phase, mah, alarm))
        state.update((phase, mah, last))
        yield pd.DataFrame(out, columns=["cell_id", "test_time_s", "phase", "phase_mah", "alarm"])

    return samples.groupBy("cell_id").applyInPandasWithState(
        step, WATCH, "phase STRING, mah DOUBLE, last DOUBLE", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(snapshots: DataFrame, store: str, checkpoint: str):
    """Fold snapshots into a latest-per-battery table, one versioned folder per micro-batch."""
    from voltloom.operators.twin import latest, upsert

    def fold(batch: DataFrame, batch_id: int) -> None:
        newest = latest(batch)
        if batch_id > 0:
            old = batch.sparkSession.read.parquet(f"{store}/version={batch_id - 1}")
            newest = upsert(old, newest, order="evaluated_at")
        newest.write.mode("overwrite").parquet(f"{store}/version={batch_id}")

    return (snapshots.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
