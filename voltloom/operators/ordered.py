"""Ordered computations per key that never put a whole key into one task.

A fleet table is skewed: one battery can hold a third of all samples. A plain
``Window.partitionBy(cell).orderBy(t)`` sends that battery to one task. The
helpers here cut every series into chunks, work inside (key, chunk), and carry
what crosses a border through a table with one row per chunk. Results are the
same as those of the plain window, whatever the number of rows of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
# Value buckets per key: two to this power.
BUCKET_BITS = 8


def _before(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 chunk: Column | None, out: str = "ordinal") -> DataFrame:
    """Exact 1..n numbering per key.

    ``chunk`` must not decrease along ``order`` (a time range, a value range);
    None numbers a key in one task, for keys known to be small.
    """
    keys = list(keys)
    if chunk is None:
        return df.withColumn(out, F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    on = keys + ["_chunk"]
    chunked = df.withColumn("_chunk", chunk)
    local = chunked.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*on).orderBy(*order)))
    starts = (
        chunked.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(_before(keys, "_chunk")), F.lit(0)))
        .drop("_n")
    )
    return (
        local.join(starts, on)
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_chunk", "_local", "_start")
    )


def block_of(ordinal: str | Column, size: int) -> Column:
    col = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.floor((col - 1) / F.lit(size))


def _over(exprs: Mapping[str, Column | tuple], base, before: int, after: int) -> dict[str, Column]:
    columns = {}
    for name, expr in exprs.items():
        if isinstance(expr, tuple):
            col, start, end = expr
            columns[name] = col.over(base if start is None else base.rowsBetween(start, end))
        else:
            columns[name] = expr.over(base.rowsBetween(-before, after))
    return columns


def near_window(df: DataFrame, keys: Sequence[str], ordinal: str,
                exprs: Mapping[str, Column | tuple[Column, int, int]],
                before: int = 0, after: int = 0, size: int | None = BLOCK_ROWS,
                block: str | None = None) -> DataFrame:
    """Window expressions whose frame reaches ``before`` rows back, ``after`` ahead.

    ``ordinal`` numbers the rows of a key densely from 1. Rows near a block
    border are also given to the neighbouring block, so that every frame is
    whole. An expression is evaluated over rows [-before, after], or over its
    own (column, start, end) frame inside that range; ``lag``/``lead`` are
    given as plain columns over a start/end of None. ``block`` names a column to
    keep the block in: a ``running`` of the same size given it needs no shuffle.
    """
    if size is None:
        base = Window.partitionBy(*keys).orderBy(ordinal)
        return df.withColumns(_over(exprs, base, before, after))
    if size < max(before, after):
        raise ValueError("a block must hold a whole frame")
    pos = F.pmod(F.col(ordinal) - 1, F.lit(size))
    own = block_of(ordinal, size)
    targets = [own]
    if before:
        targets.append(F.when(pos >= size - before, own + 1))
    if after:
        targets.append(F.when((pos < after) & (own > 0), own - 1))
    spread = (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    )
    base = Window.partitionBy(*keys, "_block").orderBy(ordinal)
    out = spread.withColumns(_over(exprs, base, before, after)).filter("_own = _block").drop("_own")
    return out.withColumnRenamed("_block", block) if block else out.drop("_block")


def lagged(df: DataFrame, keys: Sequence[str], ordinal: str, cols: Mapping[str, str | Column],
           offset: int = 1, size: int | None = BLOCK_ROWS) -> DataFrame:
    """``lag`` (offset > 0) or ``lead`` (offset < 0) of columns along ``ordinal``."""
    exprs = {n: (F.lag(c, offset) if offset > 0 else F.lead(c, -offset), None, None)
             for n, c in cols.items()}
    return near_window(df, keys, ordinal, exprs, before=max(offset, 0),
                       after=max(-offset, 0), size=size)


def running(df: DataFrame, keys: Sequence[str], ordinal: str,
            sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None,
            fills: Mapping[str, Column] | None = None, before: bool = False,
            size: int | None = BLOCK_ROWS, block: str | None = None) -> DataFrame:
    """Running sums, running maxima and last non-null values along ``ordinal``.

    The current row is included unless ``before`` is set. One block table, with
    one row per (key, block), carries all of them over the block borders; give
    a table that is cheap to read twice (stored, or staged). ``block`` names the
    column that a ``near_window`` of the same size has left; it is dropped.
    """
    keys = list(keys)
    on = keys + ["_block"]
    kinds: dict[str, tuple[str, Column]] = {}
    for kind, group in (("sum", sums), ("max", maxima), ("fill", fills)):
        kinds.update({n: (kind, c) for n, c in (group or {}).items()})
    valued = df.withColumns({f"_v_{n}": c for n, (_, c) in kinds.items()})
    upto = -1 if before else 0

    def over(kind: str, name: str, window) -> Column:
        if kind == "fill":
            return F.last(name, ignorenulls=True).over(window)
        return (F.sum(name) if kind == "sum" else F.max(name)).over(window)

    if size is None:
        plain = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, upto)
        return valued.withColumns({n: over(k, f"_v_{n}", plain) for n, (k, _) in kinds.items()}).drop(
            *[f"_v_{n}" for n in kinds])
    work = valued.withColumnRenamed(block, "_block") if block else valued.withColumn("_block", block_of(ordinal, size))
    w = Window.partitionBy(*on).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, upto)

    def total(kind: str, name: str) -> Column:
        if kind == "fill":
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(ordinal)))
        return F.sum(name) if kind == "sum" else F.max(name)

    local = work.withColumns({f"_l_{n}": over(k, f"_v_{n}", w) for n, (k, _) in kinds.items()})
    totals = work.groupBy(*on).agg(*[total(k, f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in kinds.items()])
    carried = totals.select(*on, *[
        over(k, f"_t_{n}", _before(keys, "_block")).alias(f"_c_{n}") for n, (k, _) in kinds.items()])
    out = {}
    for n, (k, _) in kinds.items():
        here, came = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if k == "sum":
            out[n] = F.coalesce(came + here, here, came)
        elif k == "max":
            out[n] = F.greatest(here, came)
        else:
            out[n] = F.coalesce(here, came)
    return local.join(carried, on).withColumns(out).drop(
        "_block", *[f"_{p}_{n}" for n in kinds for p in "vlc"])


def running_total(df: DataFrame, keys: Sequence[str], ordinal: str,
                  sums: Mapping[str, Column], size: int | None = BLOCK_ROWS) -> DataFrame:
    """Running sums along ``ordinal`` (current row included)."""
    return running(df, keys, ordinal, sums=sums, size=size)


def forward_fill(df: DataFrame, keys: Sequence[str], ordinal: str,
                 fills: Mapping[str, Column], size: int | None = BLOCK_ROWS) -> DataFrame:
    """Last non-null value up to and including the current row."""
    return running(df, keys, ordinal, fills=fills, size=size)


def value_counts(df: DataFrame, keys: Sequence[str], value: str | Column) -> DataFrame:
    """(keys, v, n): copies of a value collapse before the shuffle."""
    v = F.col(value) if isinstance(value, str) else value
    return (df.select(*keys, v.cast("double").alias("v")).where("v IS NOT NULL")
            .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")))


def _bucketed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts with a value bucket per key, and the rows below each bucket.

    The borders are approximate quantiles of the key's distinct values, so the
    buckets hold about equally many of them, however the values are spread; a
    binary search, folded over its step widths, finds a value's bucket.
    """
    lone = keys or ["_all"]
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    buckets = 1 << BUCKET_BITS
    shares = [i / buckets for i in range(1, buckets)]
    borders = counts.groupBy(*lone).agg(F.percentile_approx("v", shares, 10 * buckets).alias("_borders"))
    steps = F.array(*[F.lit(1 << bit) for bit in range(BUCKET_BITS - 1, -1, -1)])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.element_at("_borders", at + step) < F.col("v"), at + step).otherwise(at))
    placed = counts.join(borders, lone).withColumn("_bucket", bucket).drop("_borders")
    sizes = placed.groupBy(*lone, "_bucket").agg(F.sum("n").alias("_bn"))
    w = Window.partitionBy(*lone)
    starts = sizes.select(
        *lone, "_bucket",
        F.coalesce(F.sum("_bn").over(_before(lone, "_bucket")), F.lit(0)).alias("_start"),
        F.sum("_bn").over(w).alias("_total"))
    joined = placed.join(starts, [*lone, "_bucket"])
    inside = Window.partitionBy(*lone, "_bucket").orderBy("v")
    return joined.withColumn(
        "_below", F.col("_start") + F.coalesce(
            F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str | Column,
                  weight: str | None = None) -> DataFrame:
    """(keys, v, avg_rank): average rank of every distinct value of a key."""
    keys = list(keys)
    if weight is None:
        counts = value_counts(df, keys, value)
    else:
        v = F.col(value) if isinstance(value, str) else value
        counts = (df.select(*keys, v.cast("double").alias("v"), F.col(weight).alias("_w"))
                  .where("v IS NOT NULL").groupBy(*keys, "v").agg(F.sum("_w").alias("n")))
    return _bucketed(counts, keys).select(
        *keys, "v", "n", (F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                    probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, exact at any group size.

    A group is never gathered: equal values are counted, the counts are laid
    out in value buckets, and only the one or two order statistics that a
    quantile needs are picked out. A key without any value gets NULLs.
    """
    keys = list(keys)
    ranked = _bucketed(value_counts(df, keys, value), keys)
    last = F.col("_below") + F.col("n")
    aggs = []
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        aggs += [
            F.max(F.when((F.col("_below") < lo) & (lo <= last), F.col("v"))).alias(f"_a_{name}"),
            F.max(F.when((F.col("_below") < hi) & (hi <= last), F.col("v"))).alias(f"_b_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
    picked = ranked.groupBy(*keys).agg(*aggs).select(*keys, *[
        (F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs])
    return df.select(*keys).distinct().join(picked, keys, "left") if keys else picked


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks per key: (keys, n, rho).

    Equal pairs collapse first; the ranks of the distinct values are joined to
    the distinct pairs.
    """
    keys = list(keys)
    pairs = (
        df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .where("_x IS NOT NULL AND _y IS NOT NULL")
        .groupBy(*keys, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    )
    rx = average_ranks(pairs, keys, "_x", "_w").select(*keys, F.col("v").alias("_x"), F.col("avg_rank").alias("_rx"))
    ry = average_ranks(pairs, keys, "_y", "_w").select(*keys, F.col("v").alias("_y"), F.col("avg_rank").alias("_ry"))
    ranked = pairs.join(rx, [*keys, "_x"]).join(ry, [*keys, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy(*keys).agg(
        F.sum(w).alias("n"), F.sum(w * a).alias("_sa"), F.sum(w * b).alias("_sb"),
        F.sum(w * a * a).alias("_saa"), F.sum(w * b * b).alias("_sbb"),
        F.sum(w * a * b).alias("_sab"))
    n = F.col("n")
    num = F.col("_sab") - F.col("_sa") * F.col("_sb") / n
    den = F.sqrt((F.col("_saa") - F.pow("_sa", F.lit(2.0)) / n) * (F.col("_sbb") - F.pow("_sb", F.lit(2.0)) / n))
    return sums.select(*keys, "n", F.when(den > 0, num / den).alias("rho"))
