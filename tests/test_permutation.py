"""Permutations against the same draws in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltloom.functions.numbers import DRAW_RANGE, draw, draw_turn
from voltloom.operators import stats


def drawn(seed, *parts):
    m = DRAW_RANGE
    h = seed % m
    for p in parts:
        h = (h * 48_271 + p % m * 16_807 + 12_345) % m
    return (h * 48_271 + 11) % m


def coded(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def test_the_last_part_turns_a_draw(spark):
    rows = spark.range(1, 200).select("id", draw(11, 7, F.col("id")).alias("d"), draw(11, 7, 0).alias("z"), draw_turn(F.col("id")).alias("t"))
    assert all(r.d == drawn(11, 7, r.id) == (r.z + r.t) % DRAW_RANGE for r in rows.collect())


@pytest.mark.parametrize("block", [2048, 3])
def test_permutations_by_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(stats, "PRODUCT_BLOCK", block)
    monkeypatch.setattr(stats, "PRODUCT_PARTITIONS", 4)
    table = [(f"c{i}", float(i * 7 % 10), float(i * i % 13 + i % 3)) for i in range(14)]
    frame = spark.createDataFrame(table, "cell_id string, x double, y double")
    got = stats.permutation_test(frame, "cell_id", "x", "y", permutations=60).first()
    by_code = sorted(table, key=lambda r: (coded(r[0]), r[0]))
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    rx, ry = rank([r[1] for r in by_code]), rank([r[2] for r in by_code])
    real = np.corrcoef(rx, ry)[0, 1]
    hits = 0
    for rep in range(1, 61):
        order = sorted(range(14), key=lambda i: (drawn(11, rep, i + 1), i))
        hits += abs(np.corrcoef([rx[i] for i in order], ry)[0, 1]) >= abs(real) - 1e-12
    assert got.n == 14 and got.rho == pytest.approx(real) and got.p_value == pytest.approx((hits + 1) / 61)


@pytest.mark.parametrize("rows", [0, 1, 3])
def test_permutations_without_spread(spark, rows):
    frame = spark.createDataFrame([(f"c{i}", 1.0, 2.0) for i in range(rows)], "cell_id string, x double, y double")
    got = stats.permutation_test(frame, "cell_id", "x", "y", permutations=5).first()
    assert got.n == rows and got.rho is None and got.p_value == pytest.approx(1 / 6)
