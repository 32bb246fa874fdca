"""Mixing sources to target weights by subset sums over document lengths.

Each source gets a budget of words. Documents are counted by (source, exact
length); that table, not the documents, is what gets planned. A source takes
all its documents as often as the budget allows, then the same share of every
length, then the largest that fit; what remains of the budget, some ten
thousand words, is filled by a bounded knapsack over the lengths that are
left, which mostly hits it exactly. Of each length the planned number of
documents is taken by seeded hash.

Scale. A source has fewer than sqrt(2 x its words) distinct lengths, so its
plan fits one task whatever the number of its documents. Which documents of a
length are taken follows from one hash limit per (source, length): it is
found by counting hash ranges, and only the range in which the limit lies is
ranked. No source and no length goes to one task.

Defined results: a null or blank text has size 0 and is taken 0 words. The
null source is a source, the last one. Rows with the same key, source and
size have the same hash: they are taken together or not at all, so that a
limit may fall short of the plan by their number. A null key hashes as such.
An empty table gives an empty result. Reruns with the same seed agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.base import staged

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20_24
#: Words of a budget that are left to the knapsack.
LEFT = 1 << 15
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The weights repeat over the sources in code point order, null last. A
    target above ``most`` times its source stops there; the level of all
    others is found anew until none is above.
    """
    spark = sources.sparkSession
    ordered = sources.orderBy(F.asc_nulls_last("source")).rdd.zipWithIndex()
    numbered = staged(spark.createDataFrame(
        ordered.map(lambda r: (r[0]["source"], r[0]["source_size"], r[1])),
        "source string, source_size long, place long"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("place") % len(weights) + 1).cast("int"))
    table, cap = numbered.withColumn("weight", weight), F.col("source_size") * float(most)
    level, stopped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        total, held, n, rest = table.agg(
            F.sum("source_size"), F.sum(F.when(over, cap)), F.count(F.when(over, 1)),
            F.sum(F.when(~over, F.col("weight")))).first()
        if not total or not rest or n == stopped:
            break
        stopped, level = n, (share * total - (held or 0.0)) / rest
    return table.select("source", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def fill(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, so that their sum is as near below the budget as can be.

    Bounded knapsack: sums that can be reached are the bits of a number;
    counts are split into powers of two.
    """
    take = np.zeros(len(sizes), np.int64)
    reach, mask = 1, (1 << (budget + 1)) - 1
    came = np.full(budget + 1, -1, np.int64)
    pieces: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size, left, k = int(sizes[i]), int(min(counts[i], budget // max(1, int(sizes[i])))), 1
        while left > 0 and size > 0:
            k = min(k, left)
            new = (reach << (k * size)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                came[np.flatnonzero(bits)] = len(pieces)
                pieces.append((int(i), k))
                reach |= new
            left, k = left - k, 2 * k
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, k = pieces[came[at]]
        take[i] += k
        at -= k * int(sizes[i])
    return take


def plan(sizes: np.ndarray, counts: np.ndarray, target: float, left: int = LEFT) -> tuple[np.ndarray, np.ndarray]:
    """(copies of all documents of each size, how many of each size to take once more)."""
    total, more = int(sizes @ counts), np.zeros(len(sizes), np.int64)
    if not total or target <= 0:
        return more, more
    goal = int(target + 1e-6)
    copies = min(MOST, goal // total)
    every, budget = np.full(len(sizes), copies), goal - copies * total
    if copies >= MOST or budget <= 0:
        return every, more
    more = np.floor(counts * max(0.0, (budget - left) / total)).astype(np.int64)
    budget -= int(more @ sizes)
    for i in np.argsort(-sizes, kind="stable"):
        if budget <= left:
            break
        if sizes[i] > 0:
            extra = int(min(counts[i] - more[i], (budget - left) // sizes[i]))
            more[i] += extra
            budget -= extra * int(sizes[i])
    last = fill(sizes, counts - more, budget)
    if budget > int(last @ sizes) and goal <= left:
        # A source that fits the knapsack whole may come nearer if no copy of any document is given.
        free = fill(sizes, MOST * counts, goal)
        if goal - int(free @ sizes) < budget - int(last @ sizes):
            return free // counts, free % counts
    return every, more + last


def plans(df: DataFrame, key: str, text: str, source: str, weights: Sequence[int], share: float,
          most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents without text (key, source, size, hash) and, for each (source, size), its plan.

    A plan has source_size, target, copies and the hash limit up to which a
    document is taken once more (null: none).
    """
    slim = staged(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                            words(text).alias("size")).withColumn("hash", seeded("key", seed)))
    lengths = staged(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    goal = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                   weights, share, most)

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        copies, more = plan(rows["size"].to_numpy(), rows["n"].to_numpy(), float(rows["target"][0]))
        return rows.assign(copies=copies, more=more)

    wanted = lengths.join(goal, lengths.source.eqNullSafe(goal.source)).drop(goal.source)
    wanted = staged(wanted.groupBy("source").applyInPandas(
        planned, "source string, size long, n long, source_size long, target double, copies int, more long"))
    # Counts by hash range, then the range in which the wanted number is reached, then the limit inside it.
    on = ["source", "size"]
    partly = wanted.where("more > 0 AND more < n").select(*on, "more")
    ranged = _null_safe(slim, partly, on).withColumn("range", F.shiftright("hash", 64 - 12))
    counts = ranged.groupBy(*on, "range", "more").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*on).orderBy("range")) - F.col("n")
    border = counts.withColumn("before", before).where("before < more AND before + n >= more")
    inside = _null_safe(ranged.drop("more"), border.select(*on, "range", "before", "more"), [*on, "range"])
    # A range has about 1/4096 of the documents of a length.
    place = F.count(F.lit(1)).over(Window.partitionBy(*on, "range").orderBy("hash"))
    limit = (inside.withColumn("place", place + F.col("before")).where("place <= more")
             .groupBy(*on).agg(F.max("hash").alias("limit")))
    # Where the first rows of the range are more than wanted, all of the ranges before are taken.
    floor = border.select(*on, F.shiftleft("range", 64 - 12).alias("floor"))
    got = _null_safe(wanted, floor, on, "left")
    got = _null_safe(got, limit, on, "left")
    last = F.when(F.col("more") >= F.col("n"), F.lit((1 << 63) - 1)).when(
        F.col("more") > 0, F.coalesce("limit", F.expr("try_subtract(floor, 1L)")))
    return slim, got.select(*on, "source_size", "target", "copies", last.alias("limit"))


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal or both null columns."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in on]
    both = same[0]
    for s in same[1:]:
        both = both & s
    return left.join(named, both, how).drop(*(f"_r_{c}" for c in on))


def seeded(key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(key, size, source_size, target, taken): a row for each row of ``df``."""
    slim, planned = plans(df, key, text, source, weights, share, most, seed)
    return _null_safe(slim, planned, ["source", "size"]).select(
        F.col("key").alias(key), "size", "source_size", "target",
        (F.col("size") * copies_of("hash")).alias("taken"))


def copies_of(hashed: str) -> Column:
    return (F.col("copies") + F.when(F.col(hashed) <= F.col("limit"), 1).otherwise(0)).cast("long")


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    _, planned = plans(df, key, text, source, weights, share, most, seed)
    plan_of = planned.select(F.col("source").alias("_m_source"), F.col("size").alias("_m_size"), "copies",
                             F.col("limit")).withColumnsRenamed({"copies": "_m_copies", "limit": "_m_limit"})
    rows = df.withColumn("_m_words", words(text))
    joined = rows.join(plan_of, (rows["_m_words"] == plan_of["_m_size"])
                       & rows[source].cast("string").eqNullSafe(plan_of["_m_source"]))
    extra = F.when(seeded(key, seed) <= F.col("_m_limit"), 1).otherwise(0)
    times = F.when(F.col("_m_words") > 0, F.col("_m_copies") + extra).otherwise(0).cast("int")
    return (joined.withColumn("_m_time", F.explode(F.array_repeat(F.lit(1), times)))
            .select(*(F.col(f"`{c}`") for c in df.columns)))
