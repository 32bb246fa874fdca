"""Sharding by vector bin packing.

A group of equal texts is an item with three weights: bytes, tokens, rows, as
shares of the totals. Items are placed, the largest first, into the shard
where the dot product of the item with the residual capacity is highest, so
that all three stay balanced together.

Scale. Groups that hold more than a small share of any weight are items of
their own; there are no more of them than that share allows. A group above a
quarter of a shard is split into pieces by key hash: left whole it would
break the balance. All other groups are bundled by hash into cells, a few
hundred for each shard. Items and cells are counted by Spark; the driver
packs some ten thousand numbers, whatever the size of the corpus. Slots are
numbered in parts of a shard, by hash, and moved by the parts' counts.

Law: ``bytes`` (the sizes of shards are near equal).

Defined results: the size of a null text is 8, its crc32 is null, and null
texts are a group. Rows of a group stay in one shard unless the group is
split. Rows that repeat a key and a text go to the same piece. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.base import staged
from voltloom.llm.mixing import words

SHARDS, OVERHEAD, SEED = 24, 8, 3
CELLS_PER_SHARD = 256
#: A group is an item of its own above this part of a shard, and split above the second one.
OWN, SPLIT = 1 / 64, 1 / 4
PARTS = 256
WEIGHTS = ("size", "tokens", "one")
LAW = "bytes"


def pack(weights: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of shares of bytes, tokens, rows).

    Largest first, each where its dot product with the residual capacity is
    highest; equal products go to the lower shard.
    """
    room = np.full((shards, weights.shape[1]), 1.0 / shards)
    out = np.zeros(len(weights), np.int32)
    # Bytes lead: the law promises them.
    lead = np.array([2.0, 1.0, 1.0])
    for i in np.lexsort((np.arange(len(weights)), -weights.max(axis=1))):
        best = int(np.argmax(room @ (weights[i] * lead)))
        out[i] = best
        room[best] -= weights[i]
    return out


def assign(df: DataFrame, key: str, text: str, shards: int, seed: int = SEED) -> DataFrame:
    """(key, size, text_crc32, shard): a row for each row of ``df``."""
    raw = F.col(text).cast("binary")
    rows = staged(df.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        words(text).alias("tokens"), F.crc32(raw).alias("text_crc32"), F.lit(1).alias("one"),
        F.xxhash64(F.lit(seed), F.col(text), F.col(text).isNull()).alias("text_hash")))
    group = ["text_hash", "text_crc32", "size"]
    rows = rows.withColumn("text_crc32", F.coalesce("text_crc32", F.lit(-1)))
    totals = rows.agg(*(F.sum(w).cast("double").alias(w) for w in WEIGHTS)).first()
    total = [max(1.0, totals[w] or 0.0) for w in WEIGHTS]
    share = F.greatest(*(F.col(f"w_{w}") / F.lit(t) for w, t in zip(WEIGHTS, total))) * shards
    groups = rows.groupBy(*group).agg(*(F.sum(w).cast("double").alias(f"w_{w}") for w in WEIGHTS))
    # Each of the three weights allows shards / OWN groups of that share.
    own = staged(groups.where(share > OWN).select(
        *group, F.when(share > SPLIT, F.ceil(share / SPLIT)).otherwise(1).cast("int").alias("pieces")))
    cells = shards * CELLS_PER_SHARD
    salted = F.pmod(F.xxhash64(F.lit(seed), F.lit("piece"), F.col("key")), F.col("pieces"))
    rows = (rows.join(F.broadcast(own), group, "left")
            .withColumn("salt", F.coalesce(salted, F.lit(-1)))
            .withColumn("item", F.when(F.col("pieces").isNotNull(), F.col("text_hash"))
                        .otherwise(F.pmod("text_hash", F.lit(cells)))))
    items = rows.groupBy("item", "salt").agg(*(F.sum(w).cast("double").alias(w) for w in WEIGHTS))
    found = items.orderBy("item", "salt").collect()
    weights = np.array([[r[w] / t for w, t in zip(WEIGHTS, total)] for r in found]).reshape(-1, 3)
    placed = [(r["item"], r["salt"], int(s)) for r, s in zip(found, pack(weights, shards))]
    table = df.sparkSession.createDataFrame(placed or [(0, -2, 0)], "item long, salt long, shard int")
    return rows.join(F.broadcast(table), ["item", "salt"]).select(
        "key", "size", F.when(F.col("text_crc32") >= 0, F.col("text_crc32")).alias("text_crc32"), "shard")


def numbered(rows: DataFrame, shard: str, order: list[str | Column], parts: int = PARTS) -> DataFrame:
    """``rows`` with slot: gapless from 0 in each shard, without one task for a shard."""
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    rows = staged(rows.withColumn("part", part))
    counts = rows.groupBy(shard, "part").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.partitionBy(shard).orderBy("part")) - F.col("n")
    # shards x parts rows
    starts = F.broadcast(counts.select(shard, "part", start.alias("start")))
    place = F.row_number().over(Window.partitionBy(shard, "part").orderBy(*order))
    return (rows.withColumn("place", place).join(starts, [shard, "part"])
            .withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long")).drop("start", "place", "part"))


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): a row for each row of ``df``."""
    slots = numbered(assign(df, key, text, shards), "shard", ["key", "text_crc32", "size"])
    return slots.select(F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the rows of ``df`` as Parquet, a folder for each shard; keys must be unique and not null."""
    where = shard(df, key, text, shards).select(F.col(key).alias("_s_key"), "shard", "slot")
    (df.join(where, df[key] == where["_s_key"]).drop("_s_key")
     .repartition("shard", F.pmod(F.xxhash64("slot"), F.lit(16))).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
