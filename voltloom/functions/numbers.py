"""Small numeric helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = DRAW_RANGE = 2_147_483_647


def draw(seed: int, *parts: Column | int) -> Column:
    """A repeatable whole number in [0, 2^31-1) from integer parts.

    Takes the place of a random generator: the same row always gets the same
    number, on any cluster and after any retry.
    """
    h: Column = F.lit(seed % _M).cast("bigint")
    for p in parts:
        p = F.lit(p) if isinstance(p, int) else p
        h = F.pmod(h * 48_271 + F.pmod(p.cast("bigint"), F.lit(_M)) * 16_807 + 12_345, F.lit(_M))
    return F.pmod(h * 48_271 + 11, F.lit(_M))


def draw_turn(part: Column) -> Column:
    """What the last part adds to a draw, modulo DRAW_RANGE.

    draw(seed, *parts, part) = draw(seed, *parts, 0) + draw_turn(part). So rows ordered by their draws stand,
    for any seed and other parts, in one circular order that only begins elsewhere.
    """
    return F.pmod(F.pmod(part.cast("bigint"), F.lit(_M)) * (48_271 * 16_807 % _M), F.lit(_M))


def text_number(text: Column) -> Column:
    """A whole number from a string key (the first 32 bits of its md5)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Least-squares coefficients from the moment matrix and vector of one fit per row.

    The matrix comes row by row, intercept first. A singular system gives null.
    """
    def one(xx, xy):
        if xx is None or xy is None:
            return None
        k = len(xy)
        a, b = np.asarray(xx, float).reshape(k, k), np.asarray(xy, float)
        scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
        scaled = a / np.outer(scale, scale)
        if not np.isfinite(scaled).all() or np.linalg.matrix_rank(scaled, tol=1e-12) < k:
            return None
        return (np.linalg.solve(scaled, b / scale) / scale).tolist()

    for xx, xy in batches:
        yield pd.Series([one(m, v) for m, v in zip(xx, xy)], dtype=object)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later expressions use many times.

    A generator keeps the optimizer from pasting a parser call into each of
    its uses.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
