"""Captured device lines: decode, count, gate, and turn into telemetry.

Works the same on a table of lines and on a stream. One bad capture never
stops the others: every gate is a column of the one-row-per-capture report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions import wire
from voltloom.functions.numbers import computed
from voltloom.functions.wire import CHANNELS, SENTINEL, WIRE_FIELDS
from voltloom.operators.phases import REST_BELOW_A

REQUIRED = ("current_a", "voltage_v", "temperature_c", "soc")
# What each required channel is for.
NEEDED_BY = {
    "current_a": "C-rate flags, cycle segmentation, coulomb counting",
    "voltage_v": "power, window charge",
    "temperature_c": "high-temperature flag, stress score",
    "soc": "deep-discharge and high-SOC flags",
}
MIN_ACCEPTED = 0.5
SOC_SPAN = 0.2
LINE_BLOCK = 65_536


def decode(lines: DataFrame, sentinel: str = SENTINEL) -> DataFrame:
    """Adds record_type (noise/status/hello/data/rejected), reason, channels and header."""
    kind, body, carried = F.col("_record_kind"), F.col("_body"), F.col("_carried")
    known = kind.isin("HELLO", "D", "S")
    cut = computed(lines, {f"_{n}": c for n, c in wire.split_line(F.col("line"), sentinel).items()})
    is_data = kind == "D"
    parsed = computed(cut, {
        "_sum": F.when(known & (carried != ""), wire.xor_checksum(body)),
        "_hello": F.when(kind == "HELLO", F.from_json(body, wire._HELLO)),
        **{f"_{n}": c for n, c in wire.raw_values(F.when(is_data, body)).items()}})
    texts = computed(parsed, {f"_s_{f.name}": wire.field_text(f) for f in WIRE_FIELDS})
    numbers = computed(texts, {f"_x_{f.name}": F.col(f"_s_{f.name}").try_cast("double") for f in WIRE_FIELDS})
    problems = [wire.field_problem(f, F.col(f"_s_{f.name}"), F.col(f"_x_{f.name}")) for f in WIRE_FIELDS]
    checked = computed(numbers, {"_no_number": F.coalesce(*[p[0] for p in problems]),
                                  "_range": F.concat_ws("; ", *[p[1] for p in problems])})
    bad_json = F.col("_is_json") & (F.col("_keys").isNull() | F.col("_json._bad").isNotNull())
    data_problem = (
        F.when(F.trim(body) == "", "empty record body")
        .when(bad_json, "malformed JSON: not a complete object")
        .when(F.col("_bad_token").isNotNull(), F.concat(
            F.lit("malformed key=value token '"), F.col("_bad_token"), F.lit("'")))
        .when(F.col("_s_t").isNull(), "record omits 't', the sample timestamp")
        .when(F.col("_no_number").isNotNull(), F.col("_no_number"))
        .when(F.col("_range") != "", F.col("_range")))
    reason = (
        F.when(~F.col("_has_sentinel"), None)
        .when(kind == "", "sentinel with no record type")
        .when(~known, F.concat(F.lit("unknown record type '"), kind, F.lit("'")))
        .when(F.col("_sum") != carried, F.concat(
            F.lit("checksum mismatch: line carries *"), carried, F.lit(", computed *"), F.col("_sum")))
        .when(is_data, data_problem)
        .when(kind == "HELLO", wire.hello_problem(F.col("_hello"), body)))
    judged = computed(checked, {"reason": reason})
    typed = computed(judged, {"record_type": F.when(~F.col("_has_sentinel"), "noise")
                               .when(F.col("reason").isNotNull(), "rejected")
                               .when(kind == "S", "status").when(kind == "HELLO", "hello").otherwise("data")})
    ok = F.col("record_type") == "data"
    return typed.select(
        *lines.columns, "reason", "record_type",
        *[F.when(ok, F.col(f"_x_{f.name}")).alias(f.channel) for f in WIRE_FIELDS],
        F.when(F.col("record_type") == "status", F.trim(body)).alias("status_text"),
        F.when(F.col("record_type") == "hello", wire.hello_header(F.col("_hello"))).alias("header"))


def reason_key(reason: Column) -> Column:
    return F.substring(F.trim(F.substring_index(reason, ":", 1)), 1, 80)


def decode_stats(decoded: DataFrame) -> DataFrame:
    """Per capture: lines, noise, status, accepted, rejected."""
    kind = F.col("record_type")
    return decoded.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(kind == "noise").alias("n_noise"),
        F.count_if(kind == "status").alias("n_status"), F.count_if(kind == "data").alias("n_accepted"),
        F.count_if(kind == "rejected").alias("n_rejected"))


def rejection_counts(decoded: DataFrame) -> DataFrame:
    return (decoded.where("record_type = 'rejected'")
            .groupBy("capture_id", reason_key(F.col("reason")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def headers(decoded: DataFrame) -> DataFrame:
    """The latest HELLO of every capture."""
    return decoded.where("record_type = 'hello'").groupBy("capture_id").agg(
        F.max_by("header", "seq").alias("header"))


def _declared(header: Column, seen: Column) -> Column:
    """Channels a capture supplies: as declared, else as seen."""
    by_name = F.create_map(*[F.lit(x) for f in WIRE_FIELDS for x in (f.name, f.channel)])
    named = F.array_compact(F.transform(header["fields"], lambda n: by_name[n]))
    return F.array_sort(F.array_distinct(F.coalesce(named, seen)))


def missing_channels(channels: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), channels))


def missing_text(missing: Column) -> Column:
    """Which stage needs each missing channel."""
    from voltloom.operators.scores import lookup
    return F.array_join(F.transform(missing, lambda c: F.concat(
        c, F.lit(" ("), lookup(c, NEEDED_BY), F.lit(")"))), "; ")


def capture_channels(decoded: DataFrame) -> DataFrame:
    """Per capture: header, supplied and missing channels, from one pass over the lines."""
    kind = F.col("record_type")
    channel = lambda c: F.when(F.count(F.when(kind == "data", F.col(c))) > 0, F.lit(c))
    one = decoded.groupBy("capture_id").agg(
        F.array_compact(F.array(*[channel(c) for c in CHANNELS])).alias("_seen"),
        F.max_by("header", F.when(kind == "hello", F.col("seq"))).alias("header"))
    # Lines without a capture's name tell nothing of a capture.
    named = one.withColumns({c: F.when(F.col("capture_id").isNotNull(), F.col(c)) for c in ("_seen", "header")})
    return named.withColumn("channels", F.coalesce(
        _declared(F.col("header"), F.col("_seen")), F.array().cast("array<string>"))).withColumn(
        "missing", missing_channels(F.col("channels"))).select("capture_id", "header", "channels", "missing")


def homogeneous(decoded: DataFrame, captures: DataFrame) -> DataFrame:
    """Data records with every supplied channel and, for single cells, 0-5 V; else a reason."""
    joined = decoded.where("record_type = 'data'").drop("header").join(captures, "capture_id")
    present = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in CHANNELS]))
    absent = F.array_except("channels", present)
    unit = F.coalesce(F.col("header.unit"), F.lit("other"))
    wide = (unit == "cell") & ~F.col("voltage_v").between(0.0, 5.0)
    return joined.withColumn("drop_reason", F.when(F.size(absent) > 0, F.concat(
        F.lit("record omits channel(s) "), F.array_join(F.array_sort(absent), ", "),
        F.lit(" that this rig supplies"))).when(F.coalesce(wide, F.lit(False)), "cell voltage outside 0-5 V"))


def time_reversals(records: DataFrame) -> DataFrame:
    """(capture_id, reversal_seq): the first record whose time precedes the one before it.

    Arrival order is kept. A capture is cut into blocks of lines; a block is
    checked by itself and against the last time of the block before it.
    """
    block = F.floor(F.col("seq") / LINE_BLOCK)
    w = Window.partitionBy("capture_id", "_block").orderBy("seq")
    t = F.col("test_time_s")
    blocks = (records.select("capture_id", "seq", "test_time_s").withColumn("_block", block)
              .withColumn("_was", F.lag(t).over(w))
              .groupBy("capture_id", "_block").agg(
                  F.min(F.when(t < F.col("_was"), F.col("seq"))).alias("_inside"),
                  F.min("seq").alias("_seq0"), F.min_by(t, "seq").alias("_t0"),
                  F.max_by(t, "seq").alias("_t1")))
    over = Window.partitionBy("capture_id").orderBy("_block")
    at = F.when(F.col("_t0") < F.lag("_t1").over(over), F.col("_seq0")).otherwise(F.col("_inside"))
    return blocks.withColumn("_at", at).groupBy("capture_id").agg(F.min("_at").alias("reversal_seq"))


def capture_report(decoded: DataFrame, min_accepted: float = MIN_ACCEPTED,
                   schema_id: str = wire.SCHEMA_ID, require_header: bool = False) -> DataFrame:
    """One row per capture: counts, channels, every gate, and the first that refuses.

    ``decoded`` should be stored: several aggregates read it.
    """
    captures = capture_channels(decoded)
    checked = homogeneous(decoded, captures)
    kept = checked.where("drop_reason IS NULL")
    soc, i = F.col("soc"), F.col("current_a")
    shape = checked.groupBy("capture_id").agg(
        F.count_if(F.col("drop_reason").isNotNull()).alias("n_dropped"),
        F.count_if(F.col("drop_reason").isNull()).alias("n_kept"))
    values = kept.groupBy("capture_id").agg(
        F.max(soc).alias("_soc_max"), (F.max(soc) - F.min(soc)).alias("_soc_span"),
        F.count_if(i < -REST_BELOW_A).alias("_n_dis"), F.count_if(i > REST_BELOW_A).alias("_n_chg"))
    joined = (captures.join(decode_stats(decoded), "capture_id").join(shape, "capture_id", "left")
              .join(values, "capture_id", "left").join(time_reversals(kept), "capture_id", "left"))
    zero = F.lit(0)
    n_kept, n_drop = F.coalesce("n_kept", zero), F.coalesce("n_dropped", zero)
    accepted, rejected = F.col("n_accepted") - n_drop, F.col("n_rejected") + n_drop
    share = F.coalesce(F.try_divide(accepted, accepted + rejected), F.lit(0.0))
    foreign = F.col("header").isNotNull() & (F.col("header.schema_id") != schema_id)
    fraction = F.coalesce((F.col("_soc_max") <= 1.0) & (F.col("_soc_span") >= SOC_SPAN), F.lit(False))
    refusal = (F.when(foreign, "schema_mismatch")
               .when(F.col("header").isNull() & F.lit(require_header), "no_header")
               .when(F.col("n_accepted") == 0, "no_usable_records")
               .when(F.size("missing") > 0, "missing_channels")
               .when(n_kept == 0, "no_complete_record")
               .when(share < min_accepted, "low_accepted_fraction")
               .when(F.col("reversal_seq").isNotNull(), "time_reversal")
               .when(fraction, "soc_is_a_fraction").otherwise(""))
    hint = F.when(F.coalesce((F.col("_n_chg") > 0) & (F.col("_n_dis") == 0), F.lit(False)),
                  "current_sign_may_be_inverted").otherwise("")
    return joined.select(
        "capture_id", F.col("header.cell_id").alias("declared_cell_id"), F.col("header.unit").alias("unit"),
        F.col("header.capacity_ah").alias("declared_capacity_ah"), "n_lines", "n_noise", "n_status",
        accepted.alias("n_accepted"), rejected.alias("n_rejected"), share.alias("accepted_fraction"),
        F.array_join("missing", ", ").alias("missing_channels"), "reversal_seq", hint.alias("hint"),
        refusal.alias("refusal"))


def resolve_capacity(report: DataFrame, override: Column) -> DataFrame:
    """The caller's rated capacity beats the declared one; with neither there is no C-rate."""
    declared = F.col("declared_capacity_ah")
    differs = F.abs(override - declared) > 1e-6 * F.greatest(F.abs(override), F.abs(declared))
    return report.withColumns({
        "rated_capacity_ah": F.coalesce(override, declared),
        "capacity_source": F.when(override.isNotNull() & F.coalesce(differs, F.lit(False)),
                                  "caller (differs from declared)")
        .when(override.isNotNull(), "caller").when(declared.isNotNull(), "declared").otherwise("none")})


def telemetry(decoded: DataFrame, report: DataFrame, started_at: Column | None = None) -> DataFrame:
    """Rows of the captures no gate refused; ``started_at`` turns elapsed time into a timestamp."""
    captures = capture_channels(decoded)
    good = report.where("refusal = ''").select("capture_id", "declared_cell_id")
    kept = homogeneous(decoded, captures).where("drop_reason IS NULL").join(good, "capture_id")
    out = kept.select("capture_id", F.coalesce("declared_cell_id", F.lit("UNDECLARED")).alias("cell_id"),
                      "seq", *CHANNELS)
    return out if started_at is None else out.withColumn(
        "timestamp", calendar_axis(started_at, F.col("test_time_s")))


def calendar_axis(started_at: Column, elapsed_s: Column) -> Column:
    """Capture start (a zoned timestamp) plus elapsed seconds."""
    return F.timestamp_micros((F.unix_micros(started_at) + F.round(elapsed_s * 1e6)).cast("bigint"))


def channel_profile(df: DataFrame, keys: list[str], channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """n, min, max, mean per supplied channel, also for refused captures."""
    have = [c for c in channels if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("value")) for c in have])
    long = df.select(*keys, F.inline(pairs))
    return (long.where("value IS NOT NULL").groupBy(*keys, "channel").agg(
        F.count("value").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.avg("value").alias("mean")))
