"""Registered queries: wire lines, capture gates, bus frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import fixtures
from voltloom.catalog.base import query
from voltloom.catalog.views import VIEWS
from voltloom.functions import wire as w
from voltloom.session import staged
from voltloom.sources import bus, wire

VIEWS["w_rec"] = """
SELECT cell_id, k, seq, CASE WHEN k = 3 AND seq >= 40 THEN (seq-40)*30.0 ELSE test_time_s END AS test_time_s,
  voltage_v, current_a, CASE WHEN k <> 2 THEN floor(temperature_c*10)/10.0 END AS temperature_c,
  CASE WHEN k = 4 THEN soc/100.0 ELSE soc END AS soc,
  CASE WHEN seq % 17 = 0 THEN 'cut' WHEN seq % 23 = 0 OR (k = 5 AND seq % 3 <> 0) THEN 'spoiled' ELSE 'ok' END AS fate
FROM (SELECT *, CAST(substr(cell_id, 6) AS INT) % 7 AS k FROM fx_telemetry) t
"""
VIEWS["w_counts"] = """
SELECT cell_id AS capture_id, min(k) AS k, count(*) + 3 AS n_lines, 1 AS n_noise, 1 AS n_status,
  count(CASE WHEN fate = 'ok' THEN 1 END) AS ok, count(CASE WHEN fate <> 'ok' THEN 1 END) AS bad,
  count(CASE WHEN fate = 'ok' AND seq >= 40 THEN 1 END) AS late_ok, count(CASE WHEN fate = 'ok' AND seq < 40 THEN 1 END) AS early_ok,
  min(CASE WHEN fate = 'ok' AND seq >= 40 THEN seq + 10 END) AS first_late,
  max(CASE WHEN fate = 'ok' THEN soc END) - min(CASE WHEN fate = 'ok' THEN soc END) AS span
FROM w_rec GROUP BY cell_id
"""


def decoded(spark, sf_dir):
    return staged(wire.decode(fixtures.lines(spark, sf_dir)))


@query("fn_wire_decode",
       "capture_id:s seq:i record_type:s test_time_s:d3 voltage_v:d6 current_a:d6 temperature_c:d6 soc:d6",
       """SELECT cell_id AS capture_id, seq + 10 AS seq, CASE WHEN fate = 'ok' THEN 'data' ELSE 'rejected' END AS record_type,
            CASE WHEN fate = 'ok' THEN test_time_s END AS test_time_s, CASE WHEN fate = 'ok' THEN voltage_v END AS voltage_v,
            CASE WHEN fate = 'ok' THEN current_a END AS current_a, CASE WHEN fate = 'ok' THEN temperature_c END AS temperature_c,
            CASE WHEN fate = 'ok' THEN soc END AS soc FROM w_rec
          UNION ALL SELECT DISTINCT cell_id, 0, 'noise', CAST(NULL AS DOUBLE), NULL, NULL, NULL, NULL FROM w_rec
          UNION ALL SELECT DISTINCT cell_id, 1, 'hello', NULL, NULL, NULL, NULL, NULL FROM w_rec
          UNION ALL SELECT DISTINCT cell_id, 2, 'status', NULL, NULL, NULL, NULL, NULL FROM w_rec""")
def _(spark, sf_dir):
    return wire.decode(fixtures.lines(spark, sf_dir))


@query("fn_hello_decode", "capture_id:s schema_id:s cell_id:s capacity_ah:d3 unit:s n_fields:i",
       """SELECT DISTINCT cell_id AS capture_id, cell_id, CASE WHEN k = 1 THEN 'other/9' ELSE 'battery-log/1' END AS schema_id,
          CASE WHEN k IN (1,2) THEN NULL WHEN k = 6 THEN 40.0 ELSE 2.5 END AS capacity_ah,
          CASE WHEN k = 6 THEN 'pack' ELSE 'cell' END AS unit, CASE WHEN k = 2 THEN 4 ELSE 5 END AS n_fields FROM w_rec""")
def _(spark, sf_dir):
    h = wire.headers(wire.decode(fixtures.lines(spark, sf_dir)))
    return h.select("capture_id", "header.*", F.size("header.fields").alias("n_fields"))


@query("fn_wire_encode", "cell_id:s seq:i line:s",
       """SELECT cell_id, seq, 'BATLOG1 S sample ' || CAST(seq AS VARCHAR) || '*' || upper(printf('%02x',
            list_reduce(list_transform(string_split('sample ' || CAST(seq AS VARCHAR), ''), lambda c: ascii(c)), lambda a, b: xor(a, b)))) AS line
          FROM fx_telemetry""")
def _(spark, sf_dir):
    t = fixtures.telemetry(spark, sf_dir)
    return t.withColumn("line", w.encode_status(F.concat(F.lit("sample "), F.col("seq").cast("string"))))


@query("fn_xor_checksum", "cell_id:s checksum:s",
       """SELECT DISTINCT cell_id, upper(printf('%02x', list_reduce(list_transform(string_split(cell_id, ''), lambda c: ascii(c)), lambda a, b: xor(a, b)))) AS checksum
          FROM fx_telemetry""")
def _(spark, sf_dir):
    return fixtures.telemetry(spark, sf_dir).select("cell_id").distinct().withColumn(
        "checksum", w.xor_checksum(F.col("cell_id")))


@query("agg_decode_stats", "capture_id:s n_lines:i n_noise:i n_status:i n_accepted:i n_rejected:i",
       "SELECT *, ok AS n_accepted, bad AS n_rejected FROM w_counts")
def _(spark, sf_dir):
    return wire.decode_stats(wire.decode(fixtures.lines(spark, sf_dir)))


@query("agg_rejection_reasons", "capture_id:s reason:s n:i",
       """SELECT capture_id, reason, count(*) AS n FROM (SELECT cell_id AS capture_id,
            CASE WHEN fate = 'spoiled' THEN 'checksum mismatch' WHEN seq % 2 = 1 THEN 'malformed JSON'
                 ELSE 'malformed key=value token ''t''' END AS reason FROM w_rec WHERE fate <> 'ok') r
          GROUP BY capture_id, reason""")
def _(spark, sf_dir):
    return wire.rejection_counts(wire.decode(fixtures.lines(spark, sf_dir)))


VIEWS["w_gates"] = """
SELECT *, CASE WHEN k = 1 THEN 'schema_mismatch' WHEN ok = 0 THEN 'no_usable_records' WHEN k = 2 THEN 'missing_channels'
   WHEN ok/CAST(ok+bad AS DOUBLE) < 0.5 THEN 'low_accepted_fraction'
   WHEN k = 3 AND late_ok > 0 AND early_ok > 0 THEN 'time_reversal'
   WHEN k = 4 AND span >= 0.2 THEN 'soc_is_a_fraction' ELSE '' END AS refusal,
  CASE WHEN k = 2 THEN 'temperature_c' ELSE '' END AS missing_channels,
  CASE WHEN k = 3 AND early_ok > 0 THEN first_late END AS reversal_seq
FROM w_counts
"""


def report(spark, sf_dir):
    return wire.capture_report(decoded(spark, sf_dir))


@query("prj_accept_rate_gate",
       "capture_id:s n_accepted:i n_rejected:i accepted_fraction:d6 refusal:s",
       "SELECT *, ok AS n_accepted, bad AS n_rejected, ok/CAST(ok+bad AS DOUBLE) AS accepted_fraction FROM w_gates")
def _(spark, sf_dir):
    return report(spark, sf_dir)


@query("prj_time_reversal_gate", "capture_id:s reversal_seq:d0",
       "SELECT capture_id, reversal_seq FROM w_gates")
def _(spark, sf_dir):
    return report(spark, sf_dir)


@query("prj_channel_coverage", "capture_id:s missing_channels:s why:s",
       """SELECT capture_id, missing_channels, CASE WHEN k = 2 THEN 'temperature_c (high-temperature flag, stress score)' ELSE '' END AS why
          FROM w_gates""")
def _(spark, sf_dir):
    c = wire.capture_channels(wire.decode(fixtures.lines(spark, sf_dir)))
    return c.select("capture_id", F.array_join("missing", ", ").alias("missing_channels"),
                    wire.missing_text(F.col("missing")).alias("why"))


@query("set_channel_set_difference", "capture_id:s supplied:s missing:s",
       """SELECT capture_id, CASE WHEN k = 2 THEN 'current_a,soc,test_time_s,voltage_v'
            ELSE 'current_a,soc,temperature_c,test_time_s,voltage_v' END AS supplied, missing_channels AS missing FROM w_gates""")
def _(spark, sf_dir):
    c = wire.capture_channels(wire.decode(fixtures.lines(spark, sf_dir)))
    return c.select("capture_id", F.array_join("channels", ",").alias("supplied"),
                    F.array_join("missing", ",").alias("missing"))


@query("prj_soc_scale_gate", "capture_id:s soc_fraction:b",
       "SELECT capture_id, refusal = 'soc_is_a_fraction' AS soc_fraction FROM w_gates")
def _(spark, sf_dir):
    return report(spark, sf_dir).withColumn("soc_fraction", F.col("refusal") == "soc_is_a_fraction")


@query("prj_rated_capacity_resolution", "capture_id:s rated_capacity_ah:d3 capacity_source:s",
       """SELECT capture_id, CASE WHEN k IN (0,6) THEN 2.5 WHEN k IN (1,2) THEN NULL ELSE 2.5 END AS rated_capacity_ah,
          CASE WHEN k = 6 THEN 'caller (differs from declared)' WHEN k = 0 THEN 'caller' WHEN k IN (1,2) THEN 'none' ELSE 'declared' END AS capacity_source
          FROM w_gates""")
def _(spark, sf_dir):
    rep = report(spark, sf_dir)
    k = F.pmod(F.substring_index("capture_id", "_", -1).cast("int"), F.lit(7))
    return wire.resolve_capacity(rep, F.when(k.isin(0, 6), F.lit(2.5)))


@query("prj_record_homogeneity_filter", "capture_id:s seq:i kept:b",
       "SELECT cell_id AS capture_id, seq + 10 AS seq, NOT (k <> 6 AND NOT voltage_v BETWEEN 0 AND 5) AS kept FROM w_rec WHERE fate = 'ok'")
def _(spark, sf_dir):
    d = decoded(spark, sf_dir)
    return wire.homogeneous(d, wire.capture_channels(d)).withColumn("kept", F.col("drop_reason").isNull())


@query("prj_cell_voltage_filter", "capture_id:s n_kept:i n_dropped:i",
       """SELECT cell_id AS capture_id, count(CASE WHEN NOT wide THEN 1 END) AS n_kept, count(CASE WHEN wide THEN 1 END) AS n_dropped
          FROM (SELECT *, k <> 6 AND voltage_v*1.2 > 5 AS wide FROM w_rec WHERE fate = 'ok') r GROUP BY cell_id""")
def _(spark, sf_dir):
    d = decoded(spark, sf_dir).withColumn("voltage_v", F.col("voltage_v") * 1.2)
    checked = wire.homogeneous(d, wire.capture_channels(d))
    return checked.groupBy("capture_id").agg(
        F.count_if(F.col("drop_reason").isNull()).alias("n_kept"),
        F.count_if(F.col("drop_reason") == "cell voltage outside 0-5 V").alias("n_dropped"))


@query("prj_current_sign_hint", "capture_id:s hint:s",
       """SELECT cell_id AS capture_id, CASE WHEN max(CASE WHEN abs(current_a) > 0.5 THEN 1 ELSE 0 END) = 1 THEN 'current_sign_may_be_inverted' ELSE '' END AS hint
          FROM w_rec WHERE fate = 'ok' GROUP BY cell_id""")
def _(spark, sf_dir):
    d = staged(decoded(spark, sf_dir).withColumn("current_a", F.abs("current_a")))
    return wire.capture_report(d)


@query("prj_measured_channel_profile", "capture_id:s channel:s n:i low:d6 high:d6 mean:d6",
       "\nUNION ALL\n".join(
           f"SELECT cell_id AS capture_id, '{c}' AS channel, count({c}) AS n, min({c}) AS low, max({c}) AS high, avg({c}) AS mean "
           f"FROM w_rec WHERE fate = 'ok' AND {c} IS NOT NULL GROUP BY cell_id"
           for c in ("test_time_s", "voltage_v", "current_a", "temperature_c", "soc")))
def _(spark, sf_dir):
    return wire.channel_profile(wire.decode(fixtures.lines(spark, sf_dir)), ["capture_id"])


@query("fn_calendar_axis", "capture_id:s seq:i at_time:s",
       """SELECT cell_id AS capture_id, seq + 10 AS seq,
          strftime(TIMESTAMP '2024-03-01 00:00:00' + to_milliseconds(CAST(test_time_s*1000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS at_time
          FROM w_rec r JOIN w_gates g ON r.cell_id = g.capture_id WHERE g.refusal = '' AND fate = 'ok'""")
def _(spark, sf_dir):
    d = decoded(spark, sf_dir)
    start = F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))
    rows = wire.telemetry(d, staged(wire.capture_report(d)), start)
    return rows.withColumn("at_time", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("jn_signal_dictionary_join",
       "cell_id:s test_time_s:d3 voltage_v:d6 current_a:d6 soc:d6 temperature_c:d6",
       """SELECT cell_id, test_time_s, floor(voltage_v*100)*CAST(0.01 AS DOUBLE) AS voltage_v, floor(current_a*10)*CAST(0.1 AS DOUBLE) AS current_a,
          soc, floor(temperature_c) AS temperature_c FROM fx_telemetry""")
def _(spark, sf_dir):
    return bus.telemetry(fixtures.frames(spark, sf_dir), fixtures.dictionary(spark), fixtures.signal_map(spark))


@query("fn_can_bit_extract", "cell_id:s ts:d3 channel:s value:d6",
       """SELECT cell_id, test_time_s AS ts, 'current_a' AS channel, floor(current_a*10)*CAST(0.1 AS DOUBLE) AS value FROM fx_telemetry
          UNION ALL SELECT cell_id, test_time_s, 'voltage_v', floor(voltage_v*100)*CAST(0.01 AS DOUBLE) FROM fx_telemetry
          UNION ALL SELECT cell_id, test_time_s, 'soc', soc FROM fx_telemetry
          UNION ALL SELECT cell_id, test_time_s, 'temperature_c', floor(temperature_c) FROM fx_telemetry""")
def _(spark, sf_dir):
    return bus.decode_signals(bus.usable_frames(fixtures.frames(spark, sf_dir)), fixtures.dictionary(spark),
                              fixtures.signal_map(spark))


@query("src_scan_can_frames", "cell_id:s can_id:i n:i",
       """SELECT cell_id, id AS can_id, count(*) AS n FROM fx_telemetry, (VALUES (512),(513),(999)) v(id) GROUP BY cell_id, id""")
def _(spark, sf_dir):
    return bus.usable_frames(fixtures.frames(spark, sf_dir)).groupBy("cell_id", "can_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("fn_identify_vehicle", "cell_id:s vehicle:s score:d6",
       """SELECT DISTINCT cell_id, 'two_frame' AS vehicle, 1.0 AS score FROM fx_telemetry""")
def _(spark, sf_dir):
    known = spark.createDataFrame(
        [("two_frame", 512), ("two_frame", 513), ("other", 512), ("other", 700), ("other", 701)],
        "vehicle string, can_id int")
    return bus.identify_vehicle(bus.usable_frames(fixtures.frames(spark, sf_dir)), known)
