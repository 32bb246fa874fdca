"""Bootstrap of medians against the same draws in plain Python."""

import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.functions.numbers import DRAW_RANGE
from voltloom.operators import evaluate


def drawn(seed, *parts):
    m = DRAW_RANGE
    h = seed % m
    for p in parts:
        h = (h * 48_271 + p % m * 16_807 + 12_345) % m
    return (h * 48_271 + 11) % m


def coded(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("reach", [6.0, 0.0])
def test_bootstrap_medians(spark, monkeypatch, reach):
    """With borders too near, medians beyond them come from all draws."""
    monkeypatch.setattr(evaluate, "DRAW_REACH", reach)
    monkeypatch.setattr(evaluate, "DRAW_BLOCK", 50)
    monkeypatch.setattr(evaluate, "DRAW_PARTITIONS", 4)
    table = [("m", f"f{i}", float(i * 37 % 101) ** 2) for i in range(300)] + [("few", f"f{i}", 1.0) for i in range(3)]
    frame = spark.createDataFrame(table, "model string, held_out string, mae double")
    got = {r.model: r for r in evaluate.bootstrap_median_ci(frame, ["model"], "mae", "held_out", resamples=40).collect()}
    by_code = [r[2] for r in sorted(table[:300], key=lambda r: (coded(r[1]), r[1]))]
    medians = [statistics.median(by_code[drawn(7, rep, pos) % 300] for pos in range(1, 301)) for rep in range(1, 41)]
    low, high = np.quantile(medians, [0.025, 0.975])
    assert got["few"].n_folds == 3 and got["few"].ci_low is None
    assert got["m"].n_folds == 300 and (got["m"].ci_low, got["m"].ci_high) == pytest.approx((low, high))


def test_draws_are_never_the_side_held_in_memory(spark):
    """One row of a plan becomes millions of draws, which an estimate from the plan takes for few."""
    model = F.concat(F.lit("m"), F.col("id") % 1).alias("model")
    plan = spark.range(1).select(model, F.lit(300).cast("bigint").alias("n_folds"), F.lit(1).alias("_rep"))
    folds = spark.range(1, 301).select(model, F.col("id").alias("_i"), F.rand(1).alias("_v"))
    text = evaluate._drawn(plan, folds, ["model"], 7)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text and "ShuffledHashJoin [model" in text and "BuildRight" in text
