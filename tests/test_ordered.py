"""The chunked helpers give what a plain window gives, on a table with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltloom.operators.ordered import (
    _bucketed, exact_quantiles, lagged, near_window, running, spearman, value_counts, with_ordinal,
)


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    sizes = {"hot": 700, "a": 40, "b": 3, "c": 1}
    rows = [(k, i, float(np.round(rng.normal(), 1)), None if rng.random() < 0.2 else float(rng.integers(0, 9)))
            for k, n in sizes.items() for i in range(n)]
    return pd.DataFrame(rows, columns=["k", "t", "x", "y"])


@pytest.fixture(scope="module")
def df(spark, frame):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r)
            for r in frame.sample(frac=1, random_state=1).itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t int, x double, y double")


def numbered(df):
    return with_ordinal(df, ["k"], ["t"], F.floor(F.col("t") / 13), "n")


def ordered(df, *cols):
    return df.select("k", "n", *cols).toPandas().sort_values(["k", "n"]).reset_index(drop=True)


def test_ordinal_is_dense_and_in_order(df):
    out = numbered(df).toPandas().sort_values(["k", "t"])
    for _, g in out.groupby("k"):
        assert g["n"].tolist() == list(range(1, len(g) + 1))


@pytest.mark.parametrize("size", [7, 50])
def test_near_window_matches_plain_window(df, size):
    exprs = {"m": (F.avg("x"), -4, 2), "p": (F.percentile("y", 0.5), -5, 0), "s": (F.stddev_samp("x"), -6, 0)}
    args = (numbered(df), ["k"], "n", exprs)
    a = ordered(near_window(*args, before=6, after=2, size=size), "m", "p", "s")
    b = ordered(near_window(*args, before=6, after=2, size=None), "m", "p", "s")
    pd.testing.assert_frame_equal(a, b)


@pytest.mark.parametrize("before", [False, True])
def test_running_matches_plain_window(df, before):
    kw = dict(sums={"s": F.col("y")}, maxima={"m": F.col("x")}, fills={"f": F.col("y")}, before=before)
    a = ordered(running(numbered(df), ["k"], "n", size=11, **kw), "s", "m", "f")
    b = ordered(running(numbered(df), ["k"], "n", size=None, **kw), "s", "m", "f")
    pd.testing.assert_frame_equal(a, b)


def test_lag_crosses_block_borders(df):
    a = ordered(lagged(numbered(df), ["k"], "n", {"w": "x"}, size=5), "w")
    b = ordered(lagged(numbered(df), ["k"], "n", {"w": "x"}, size=None), "w")
    pd.testing.assert_frame_equal(a, b)


def test_quantiles_without_gathering_a_group(df, frame):
    probs = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    out = exact_quantiles(df, ["k"], "x", probs).toPandas().set_index("k")
    for k, g in frame.groupby("k"):
        for name, p in probs.items():
            assert out.loc[k, name] == pytest.approx(np.quantile(g["x"], p))
    one = exact_quantiles(df, [], "y", {"m": 0.5}).first()["m"]
    assert one == pytest.approx(frame["y"].median())


def test_spearman(df, frame):
    out = {r["k"]: r["rho"] for r in spearman(df, ["k"], "x", "y").collect()}
    for k in ("hot", "a"):
        g = frame[frame["k"] == k].dropna()
        assert out[k] == pytest.approx(g["x"].rank().corr(g["y"].rank()))


def test_quantiles_keep_keys_without_values_and_take_outliers(spark):
    rows = [("a", float(i)) for i in range(5000)] + [("a", 1e12), ("b", None), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    out = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], "x", {"m": 0.5}).collect()}
    assert out == {"a": 2500.0, "b": None, "c": 7.0}
    assert exact_quantiles(df.where("k = 'b'"), [], "x", {"m": 0.5}).first()["m"] is None


def test_buckets_hold_equal_counts_beside_an_outlier(spark):
    rows = [("a", float(i)) for i in range(20_000)] + [("a", 1e12)]
    counts = value_counts(spark.createDataFrame(rows, "k string, x double"), ["k"], "x")
    largest = _bucketed(counts, ["k"]).groupBy("_bucket").count().agg({"count": "max"}).first()[0]
    assert largest < 100
