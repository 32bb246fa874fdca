"""Bus frames joined to a signal dictionary, and vehicle identification.

The dictionary is a table: (can_id, signal, start_bit, bit_length, big_endian,
is_signed, factor, offset); a signal map is (signal, channel).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.functions.bus import bit_field, physical
from voltloom.functions.wire import CHANNELS, byte_values


def usable_frames(frames: DataFrame) -> DataFrame:
    """Data frames only: error and remote frames carry no payload to decode."""
    return frames.where(~F.col("is_error") & ~F.col("is_remote"))


def decode_signals(frames: DataFrame, dictionary: DataFrame, signal_map: DataFrame) -> DataFrame:
    """(cell_id, ts, seq, channel, value) for every mapped signal."""
    signals = dictionary.join(signal_map, "signal")
    octets = frames.withColumn("_octets", byte_values(F.col("data")))
    raw = bit_field(F.col("_octets"), F.col("start_bit"), F.col("bit_length"), F.col("big_endian"),
                    F.col("is_signed"))
    fits = F.size("_octets") * 8 >= F.col("bit_length")
    return octets.join(signals, "can_id").where(fits).select(
        "cell_id", "ts", "seq", "channel", physical(raw, F.col("factor"), F.col("offset")).alias("value"))


def telemetry(frames: DataFrame, dictionary: DataFrame, signal_map: DataFrame,
              channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per (cell, time): the first value of each channel in arrival order.

    Nothing is carried from one time to the next.
    """
    long = decode_signals(usable_frames(frames), dictionary, signal_map)
    picks = []
    for c in channels:
        if c == "test_time_s":
            continue
        mine = F.when((F.col("channel") == c) & F.col("value").isNotNull(), F.col("seq"))
        picks.append(F.min_by("value", mine).alias(c))
    return long.groupBy("cell_id", F.col("ts").alias("test_time_s")).agg(*picks)


def identify_vehicle(frames: DataFrame, dictionaries: DataFrame, least: float = 0.5) -> DataFrame:
    """(cell_id, vehicle, score): share of a vehicle's known ids seen on the bus.

    ``dictionaries`` is (vehicle, can_id). Under ``least`` the vehicle is unknown.
    """
    seen = frames.select("cell_id", "can_id").distinct()
    known = dictionaries.select("vehicle", "can_id").distinct()
    sizes = known.groupBy("vehicle").agg(F.count(F.lit(1)).alias("_known"))
    hits = seen.join(known, "can_id").groupBy("cell_id", "vehicle").agg(F.count(F.lit(1)).alias("_hit"))
    scored = hits.join(sizes, "vehicle").withColumn("score", F.col("_hit") / F.col("_known"))
    best = scored.groupBy("cell_id").agg(F.max_by(
        F.struct("vehicle", "score"), F.struct("score", F.col("vehicle"))).alias("b"))
    return best.select("cell_id", F.when(F.col("b.score") >= least, F.col("b.vehicle")).alias("vehicle"),
                       F.col("b.score").alias("score"))


def best_signal_map(dictionary: DataFrame, maps: DataFrame) -> DataFrame:
    """The known signal map covering most signals of the dictionary.

    ``maps`` is (map_name, signal, channel).
    """
    signals = dictionary.select("signal").distinct()
    return (maps.join(signals, "signal").groupBy("map_name").agg(F.count_distinct("signal").alias("n_signals"))
            .agg(F.max_by(F.struct("map_name", "n_signals"), F.struct("n_signals", "map_name")).alias("b"))
            .select("b.*"))
