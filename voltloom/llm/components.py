"""Connected components, without gathering links or members anywhere.

``connected`` alternates the large-star and small-star steps (Kiveris et al.,
2014): each round hangs every node under the smallest node near it, until all
links point straight at the smallest node of their component. A round is two
sums per node and two joins, written to the shared folder; hot nodes are
pre-aggregated, and the joins may be split where they are skewed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.base import staged


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and the links (a, b): the smallest node of each node's component."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        before = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        while not np.array_equal(low, hop := low[low]):
            low = hop
        if np.array_equal(low, before):
            break
        apart = low[a] != low[b]
        a, b = low[a[apart]], low[b[apart]]
    while not np.array_equal(low, hop := low[low]):
        low = hop
    return low


def _hung(sides: DataFrame, keep) -> DataFrame:
    """Each (u, v) with the smallest node next to u, or u itself."""
    lowest = sides.groupBy("u").agg(F.min("v").alias("m"))
    return sides.join(lowest.withColumn("m", F.least("m", "u")), "u").where(keep)


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link to another; root is the smallest reachable.

    ``links`` may hold repeated and reversed rows and rows with a = b.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .where("u <> v").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_hung(both, F.col("v") > F.col("u")).where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small)
        # Stable when no node has two links and no link's target has one of its own.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def whole_units(batches: Iterator[pa.RecordBatch], keys: Sequence[str],
                rows: int = 1 << 16) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Columns of many whole units at a time, and where each unit starts (with the end of the last).

    The input is sorted by ``keys`` inside the partition; a unit is a run of
    equal keys. At most ``rows`` rows and one unit are held.
    """
    held: list[pa.RecordBatch] = []
    count = 0

    def cut(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        cols = {}
        for name in table.column_names:
            c = table.column(name).combine_chunks()
            cols[name] = c
        change = np.zeros(table.num_rows, bool)
        change[:1] = True
        for k in keys:
            v = cols[k].to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        return cols, np.append(np.flatnonzero(change), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            _, starts = cut(table)
            if len(starts) > 2:
                done = table.slice(0, starts[-2])
                yield cut(done)
                held = table.slice(starts[-2]).to_batches()
                count = table.num_rows - starts[-2]
    if held:
        yield cut(pa.Table.from_batches(held))
