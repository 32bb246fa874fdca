"""Prefix sums along a linked list that lies spread over a cluster.

Random-mate contraction: every round each element draws a coin, a fixed hash
of its name and the round. An element with heads swallows its successor with
tails: it takes over the successor's link and adds its weights. A quarter of
the elements goes in a round, each round is one join on unique names, and the
work of all rounds together is a small multiple of the first one's. When at
most ``base`` elements are left (a fixed bound, whatever the list) one task
follows them from the head; then the rounds are undone, each swallowed element
adding what stood between it and its swallower.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import staged

BASE = 1 << 16


def doubled(succ: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element its chain's last element and the summed weights from itself up to, not with, that one.

    ``succ`` is -1 at a chain's last element; chains hold no circle.
    """
    end = np.where(succ < 0, np.arange(len(succ)), succ)
    total = np.where((succ < 0)[:, None], 0, weights)
    while True:
        further = end[end]
        if np.array_equal(further, end):
            return end, total
        total = total + total[end]
        end = further


def _followed(sums: Sequence[str]):
    """One task's work on the remaining list: every element's sums before it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        names = table.column("name").to_numpy()
        order = np.argsort(names)
        following = table.column("following")
        has = ~np.asarray(following.is_null())
        succ = np.full(len(names), -1, np.int64)
        succ[has] = order[np.searchsorted(names[order], following.drop_null().to_numpy())]
        weights = np.stack([table.column(s).to_numpy() for s in sums], 1)
        last, behind = doubled(succ, weights)
        behind = behind + weights[last]  # the sums from an element to the list's end
        before = behind.max(axis=0) - behind  # the head has all; weights are not negative
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), *(pa.array(before[:, i]) for i in range(len(sums)))], ["name", *sums])
    return work


def list_ranked(elements: DataFrame, sums: Sequence[str], base: int = BASE) -> DataFrame:
    """(name, sums): of each element, the sums over all elements before it in its list.

    ``elements`` holds (name long, following long or null, sums long >= 0): one
    list, unique names. Give it a staged table.
    """
    sums = list(sums)
    undone: list[DataFrame] = []
    level = 0
    while elements.count() > base:
        level += 1

        def heads(name: str, level: int = level):
            return F.xxhash64(F.lit(level), F.col(name)) % 2 == 0

        eaters = elements.where(heads("name") & F.col("following").isNotNull() & ~heads("following")).select(
            F.col("following").alias("_eaten"), F.col("name").alias("_by"), *(F.col(s).alias(f"_{s}") for s in sums))
        met = staged(elements.join(eaters, F.col("name") == F.col("_eaten"), "left"))
        eats = heads("name") & F.col("following").isNotNull() & ~heads("following")
        # An eater's new row comes from the row of what it ate.
        elements = met.where(F.col("_by").isNotNull() | ~F.coalesce(eats, F.lit(False))).select(
            F.coalesce("_by", "name").alias("name"), "following",
            *(F.coalesce(F.col(f"_{s}") + F.col(s), F.col(s)).alias(s) for s in sums))
        undone.append(met.where("_by IS NOT NULL").select("name", "_by", *(F.col(f"_{s}").alias(s) for s in sums)))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("name", *sums)])
    ranked = elements.coalesce(1).mapInArrow(_followed(sums), schema)
    for eaten in reversed(undone):
        ranked = staged(ranked)
        came = ranked.select(F.col("name").alias("_by"), *(F.col(s).alias(f"_{s}") for s in sums))
        ranked = ranked.unionByName(eaten.join(came, "_by").select(
            "name", *((F.col(s) + F.col(f"_{s}")).alias(s) for s in sums)))
    return ranked
