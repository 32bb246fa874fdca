"""Wire lines: checksums by words of bytes, and one pass over the lines for a capture's channels."""

from functools import reduce

from pyspark.sql import functions as F

from voltloom.functions import wire as w
from voltloom.sources import wire


def test_checksums_of_all_lengths(spark):
    texts = ["é€😀" * (n % 3) + "x*?~" * (n // 4) + "abc"[:n % 4] for n in range(70)] + [None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", w.xor_checksum(F.col("t")).alias("c")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.c == (None if r.t is None else f"{reduce(lambda a, b: a ^ b, r.t.encode(), 0):02X}")


def test_a_checksum_takes_words_not_bytes(spark):
    plan = spark.range(1).select(w.xor_checksum(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "transform(" not in plan and ", 7)" in plan


def test_channels_from_one_pass(spark):
    header = w.encode_hello(F.lit("A"), fields=("t", "v"))
    lines = spark.createDataFrame([("a", 1, None), ("a", 2, "BATLOG1 D t=1 v=3"), ("b", 1, "BATLOG1 D t=1 i=2"), ("c", 1, "noise"),
                                   (None, 1, "BATLOG1 D t=1 v=3")], "capture_id string, seq long, line string").withColumn(
        "line", F.coalesce("line", header))
    out = wire.capture_channels(wire.decode(lines))
    got = {r.capture_id: (r.channels, len(r.missing)) for r in out.collect()}
    assert got == {"a": (["test_time_s", "voltage_v"], 3), "b": (["current_a", "test_time_s"], 3), "c": ([], 4), None: ([], 4)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_any_columns_of_a_decoded_line(spark, tmp_path):
    rows = [("a", 1, "BATLOG1 D t=1 v=3"), ("a", 2, 'BATLOG1 D {"t":2,"v":3}'), ("a", 3, "noise"), ("a", 4, "BATLOG1 D t=x"), ("a", 5, None)]
    wire.decode(spark.createDataFrame(rows, "capture_id string, seq long, line string")).select(
        "capture_id", "seq", "record_type", "test_time_s").write.parquet(str(tmp_path / "decoded"))
    got = {r.seq: (r.record_type, r.test_time_s) for r in spark.read.parquet(str(tmp_path / "decoded")).collect()}
    assert got == {1: ("data", 1.0), 2: ("data", 2.0), 3: ("noise", None), 4: ("rejected", None), 5: ("noise", None)}
