"""Plans that must not grow with the number of steps, and shuffles that must grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltloom import session
from voltloom.operators import curves

START, ADVICE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _steps(spark):
    rows = [("a", c, 0.01 if c % 4 == 1 else 0.1 + c / 100) for c in range(1, 15)] + [("b", 1, None), ("c", 3, 0.2)]
    return spark.createDataFrame(rows, "cell_id string, cycle bigint, r_step_ohm double").withColumn("mean_current_a", F.lit(-2.0))


def _walk(rows):
    """The rule as a walk: the first five accepted steps set the limit."""
    taken, kept = {}, {}
    for r in sorted(rows, key=lambda r: (r.cell_id, r.cycle)):
        past = sorted(taken.setdefault(r.cell_id, []))
        mid = (past[(len(past) - 1) // 2] + past[len(past) // 2]) / 2 if past else None
        low = r.r_step_ohm is not None and mid is not None and r.r_step_ohm < 0.25 * mid
        kept[r.cell_id, r.cycle] = None if low else r.r_step_ohm
        if r.r_step_ohm is not None and not low and len(past) < 5:
            taken[r.cell_id].append(r.r_step_ohm)
    return kept


def test_screening_uses_each_aggregate_once(spark):
    steps = _steps(spark)
    out = curves.screen_steps(steps)
    assert {(r.cell_id, r.cycle): r.r_ok_ohm for r in out.collect()} == _walk(steps.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") <= curves.REFERENCE_STEPS


def test_trailing_resistance_reads_stored_steps(spark):
    out = curves.trailing_resistance(curves.screen_steps(_steps(spark)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2 and "LogicalRDD" not in plan
    assert out.where("cell_id = 'a' AND cycle = 14").first().r_trailing_ohm > 0.1


def test_shuffles_start_with_more_partitions_for_more_rows(spark, monkeypatch):
    before = {k: spark.conf.get(k, None) for k in (START, ADVICE)}
    have = int(before[START] or spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(1000)
    try:
        session.room_for(rows)
        assert spark.conf.get(START, None) == before[START]
        monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
        assert session.room_for(rows).groupBy((F.col("id") % 7).alias("k")).count().count() == 7
        assert int(spark.conf.get(START)) == max(have, 100)
        session.room_for(spark.range(10))
        assert int(spark.conf.get(START)) == max(have, 100)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
