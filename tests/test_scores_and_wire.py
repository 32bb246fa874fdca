import pytest

from voltloom.operators import guardian, scores
from voltloom.plans import fleet
from voltloom.sources import wire

SUMMARY = ("battery_id string, avg_stress double, avg_temp double, deep_discharge_duration bigint, "
           "fast_charge_duration bigint, aggressive_discharge_count bigint, avg_soc double")


def test_a_missing_value_is_loud(spark):
    df = spark.createDataFrame([("a", 10.0, None, 1, 1, 1, 50.0)], SUMMARY)
    with pytest.raises(Exception, match="avg_temp"):
        scores.risk_assessment(df).collect()


def test_a_missing_value_can_refuse_one_battery(spark):
    df = spark.createDataFrame([("a", 10.0, None, 1, 1, 1, 50.0), ("b", 10.0, 25.0, 1, 1, 1, 50.0)], SUMMARY)
    out = {r["battery_id"]: r for r in scores.health_index(df, on_null="refuse").collect()}
    assert out["a"]["health_index"] is None and "avg_temp" in out["a"]["refusal"]
    assert out["b"]["health_index"] == 24.0


def test_cut_points_differ_between_the_scores(spark):
    df = spark.createDataFrame([("a", 70.0, 40.0, 100, 100, 500, 50.0)], SUMMARY)
    risk = scores.risk_assessment(df).first()["risk_score"]
    health = scores.health_index(df).first()["health_index"]
    assert risk == 100.0                      # 30 + 25 + 20 + 15 + 15, clipped
    assert health == 20.0 + 15.0 + 10.0 + 8.0 + 8.0


def test_one_battery_is_compared_with_the_ideal(spark):
    df = spark.createDataFrame([("a", 80.0, 45.0, 0, 0, 0, 50.0)], SUMMARY)
    row = guardian.guardian_report(fleet.scored(df)).first()
    assert row["health_attribution_reference"] == "ideal"
    assert row["dominant_cause"] in ("sustained high stress", "high temperature exposure")
    assert row["evidence_confidence"] == "MIXED"


LINES = [
    (0, "boot noise"),
    (1, 'xx BATLOG1 D {"t":1.0,"v":3.9,"i":-1.0,"tc":25.0,"soc":50.0}'),
    (2, "BATLOG1 D t=2 v=3.9 i=-1 tc=25 soc=50"),
    (3, "BATLOG1 D t=3 v=3.9 i=-1 tc=25 soc=50*00"),
    (4, "BATLOG1 D v=3.9 i=-1"),
    (5, "BATLOG1 D t=5 v=abc"),
    (6, "BATLOG1 D t=6 v=2000"),
    (7, "BATLOG1 Q hello"),
    (8, "BATLOG1"),
    (9, "BATLOG1 S rig started*3D"),
    (10, "BATLOG1 D t=nan"),
    (11, "BATLOG1 D t=11 extra=7 v=3.8"),
    (12, 'BATLOG1 D {"t":1.0,'),
    (13, 'BATLOG1 HELLO {"schema":"battery-log/1","fields":[]}'),
]


def test_lines_are_judged_one_by_one(spark):
    df = spark.createDataFrame([("c", s, line) for s, line in LINES], "capture_id string, seq bigint, line string")
    out = {r["seq"]: r for r in wire.decode(df).collect()}
    kinds = [out[n]["record_type"] for n in range(14)]
    assert kinds == ["noise", "data", "data", "rejected", "rejected", "rejected", "rejected", "rejected",
                     "rejected", "status", "rejected", "data", "rejected", "rejected"]
    assert out[3]["reason"].startswith("checksum mismatch")
    assert out[4]["reason"].startswith("record omits 't'")
    assert "not numeric" in out[5]["reason"] and "outside the declared range" in out[6]["reason"]
    assert "not a finite number" in out[10]["reason"]
    assert out[11]["voltage_v"] == 3.8 and out[11]["soc"] is None
    assert out[9]["status_text"] == "rig started"


def test_time_reversal_is_found_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(wire, "LINE_BLOCK", 4)
    rows = [("c", n, float(n if n < 8 else n - 5)) for n in range(16)] + [("d", n, float(n)) for n in range(16)]
    df = spark.createDataFrame(rows, "capture_id string, seq bigint, test_time_s double")
    out = {r["capture_id"]: r["reversal_seq"] for r in wire.time_reversals(df).collect()}
    assert out == {"c": 8, "d": None}


def test_nothing_of_the_report_runs_in_python(spark):
    df = spark.createDataFrame([("a", 80.0, 45.0, 0, 0, 0, 50.0)], SUMMARY)
    plan = guardian.guardian_report(fleet.scored(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
