"""Near-duplicate texts by SimHash, with bit-sliced comparison of fingerprints.

Fingerprints. Each text is reduced in one pass over its partition to 64 bits;
texts are never shuffled. Equal fingerprints are one node from then on, so
thousands of copies cost one comparison partner.

Candidates. 64 bits are cut into six blocks. Two fingerprints that differ in
at most four bits agree on at least two blocks, so they share one of the 15
keys "two blocks and their bits": nothing within the radius is missed. Keys
that hold more than ``tile`` nodes are cut into tiles, and each pair of tiles
becomes a unit of its own; no key goes to one task whole.

Comparison. The fingerprints of a unit are stored as bit planes: word j of
plane p holds bit p of 64 fingerprints. One fingerprint is compared with 64
others at once; differing bits are added into counters that are bit-sliced
too, by carry-save adders. Words in which all 64 exceed the radius are
abandoned after each 16 planes.

A unit hands over a forest of its links, no more rows than it has members.

Defined results: a null text has no words and fingerprint zero, like an empty
one; it links like any other. A row with a null key gets a fingerprint and
the component of its fingerprint (null if no row with a key shares it). Rows
that repeat a key count like others. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import append, partitions, staged
from voltloom.llm.components import connected, forest, whole_units

SHINGLE, SEED, RADIUS = 4, 42, 4
#: First bits of the six blocks, and the end.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
#: A text is cut into words in parts of about so many bytes, and the bits of so many shingles are counted at a time.
PART_BYTES, COUNTED = 1 << 18, 1 << 14
SPACE = re.compile(rb"[\x20\x09-\x0D]")
TILE = 2048
WORDS = 4096  # words of one set of bit planes
ENTRIES = 1 << 16  # (fingerprint, word) pairs compared at a time


def shingle_hashes(raw: bytes | None, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of the lower-cased words (of the whole sequence, if it is shorter), in bounded parts."""
    digest = xxhash.xxh64_intdigest
    words: list[bytes] = []
    start, whole, short = 0, (raw or b"").lower(), True
    while start < len(whole):
        space = SPACE.search(whole, start + PART_BYTES)
        end = space.start() if space else len(whole)
        words = (words[1 - size:] if size > 1 else []) + whole[start:end].split()
        if len(words) >= size:
            joined, short = b" ".join(words), False
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            yield np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, starts[size:])], np.uint64)
        start = end
    if short and words:
        yield np.array([digest(b" ".join(words), seed)], np.uint64)


def fingerprints(raws: Iterable[bytes | None], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """A 64-bit fingerprint of each text, as signed numbers; bits are counted for ``COUNTED`` shingles at a time."""
    sums: list[np.ndarray] = []
    owners: list[int] = []
    parts: list[np.ndarray] = []
    n = held = 0

    def count() -> None:
        lengths = np.array([len(p) for p in parts])
        bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.int64)
        sums.extend(2 * ones - lengths[:, None])
        parts.clear()

    for n, raw in enumerate(raws, 1):
        for hashes in shingle_hashes(raw, size, seed):
            for at in range(0, len(hashes), COUNTED):
                parts.append(hashes[at:at + COUNTED])
                owners.append(n - 1)
                held += len(parts[-1])
                if held >= COUNTED:
                    count()
                    held = 0
    if parts:
        count()
    surplus = np.zeros((n, 64), np.int64)
    if owners:
        np.add.at(surplus, owners, np.array(sums))
    return np.packbits((surplus > 0).astype(np.uint8), axis=1, bitorder="little").view(np.int64).ravel()


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint",
                     size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df`` with the fingerprint of each whole text as a long."""
    def work(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        column = batch.column(batch.schema.names.index(text)).cast(pa.binary())
        return {out: fingerprints((value.as_py() for value in column), size, seed)}

    return append(df, {out: T.LongType()}, work)


def exceeds(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, more: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, kept in bit-sliced counters, is above the radius."""
    above, equal = np.zeros_like(ones), ~np.zeros_like(ones)
    for k, c in ((4, fours), (2, twos), (1, ones)):
        if radius & k:
            equal &= c
        else:
            above |= equal & c
            equal &= ~c
    return above | more


def add(total: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: sum and carry of three bits in every lane."""
    half = total ^ x
    return half ^ y, (total & x) | (half & y)


def close_pairs(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in the same unit within the radius; ``starts`` cuts the units.

    Units are padded to a power of two (or to whole words of 64 lanes) and
    laid out by falling size, so that no small unit lies across two words.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return
    n = sizes[order]
    padded = np.where(n > 64, -(-n // 64) * 64, 1 << np.ceil(np.log2(n)).astype(np.int64))
    ends = np.cumsum(padded)
    at = 0
    while at < len(order):
        base = ends[at] - padded[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WORDS * 64, "right")))
        yield from _compare(fps, starts[order[at:to]], n[at:to], (ends - padded)[at:to] - base, radius)
        at = to


def _compare(fps, first, n, lane0, radius):
    unit = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)
    rows, lane = first[unit] + inner, lane0[unit] + inner
    words = int(lane[-1] >> 6) + 1
    words = max(words, int((lane >> 6).max()) + 1)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[lane] = fps[rows].view(np.uint64)
    owner = np.zeros(words * 64, np.int64)
    owner[lane] = rows
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)
    # A row meets its own word (the lanes after it) and the unit's later words.
    last = (lane0 + n - 1)[unit]
    spread = (last >> 6) - (lane >> 6) + 1
    for lo, hi in _portions(spread):
        q = np.repeat(np.arange(lo, hi), spread[lo:hi])
        step = np.arange(len(q)) - np.repeat(np.cumsum(spread[lo:hi]) - spread[lo:hi], spread[lo:hi])
        word = (lane[q] >> 6) + step
        full = ~np.uint64(0)
        upto = np.where(word == last[q] >> 6, last[q] & 63, 63).astype(np.uint64)
        alive = full >> (np.uint64(63) - upto)
        mine = (lane[q] & 63).astype(np.uint64)
        alive &= np.where(step == 0, ~(full >> (np.uint64(63) - mine)), full)
        keep = alive != 0
        q, word, alive = q[keep], word[keep], alive[keep]
        own = fps[rows].view(np.uint64)
        ones, twos, fours, more = (np.zeros(len(q), np.uint64) for _ in range(4))
        for p in range(0, 64, 4):
            d = [planes[k][word] ^ (np.uint64(0) - ((own[q] >> np.uint64(k)) & np.uint64(1))) for k in range(p, p + 4)]
            ones, c1 = add(ones, d[0], d[1])
            ones, c2 = add(ones, d[2], d[3])
            twos, c4 = add(twos, c1, c2)
            more |= fours & c4
            fours = fours ^ c4
            if p % 16 == 12:
                alive &= ~exceeds(ones, twos, fours, more, radius)
                keep = alive != 0
                if not keep.all():
                    q, word, alive, ones, twos, fours, more = (
                        x[keep] for x in (q, word, alive, ones, twos, fours, more))
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, k = np.nonzero(hit)
            yield rows[q[e]], owner[(word[e] << 6) + k]


def _portions(spread: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that make about ENTRIES comparisons each."""
    total = np.cumsum(spread)
    lo = 0
    while lo < len(spread):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + ENTRIES, "right")))
        yield lo, hi
        lo = hi


def candidates(nodes: DataFrame, tile: int) -> DataFrame:
    """(keys, left, right, node, fp): rows of a unit are to be compared with each other."""
    keys = []
    for number, (x, y) in enumerate(combinations(range(6), 2)):
        def block(i: int):
            width = BLOCKS[i + 1] - BLOCKS[i]
            return F.shiftrightunsigned("fp", BLOCKS[i]).bitwiseAND((1 << width) - 1)
        keys.append(F.lit(number).cast("long") * F.lit(1 << 22) + block(x) * F.lit(1 << 11) + block(y))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # A tile of a key is a part of its nodes by hash; one tile meets itself and each other one.
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    cut = rows.join(sizes, "key").withColumn("tiles", tiles).withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    return cut.select(
        "key", "node", "fp", "own",
        F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "node", "fp")


def close_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the same nodes as all pairs of ``nodes`` (node, fp) within the radius."""
    if radius > 4:
        raise ValueError("two of six blocks agree up to a radius of four bits")
    keys = ["key", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_units(batches, keys):
            node, fps = cols["node"].to_numpy(), cols["fp"].to_numpy()
            for a, b in close_pairs(fps, starts, radius):
                low = forest(len(node), a, b)
                moved = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[low[moved]])], ["a", "b"])

    units = candidates(nodes, tile).repartition(partitions(nodes.sparkSession), *keys)
    return units.sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def grouped(df: DataFrame, keys: list[str], text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(keys, fingerprint, root, component_id): a row for each row of ``df``; root tells all components apart."""
    rows = staged(with_fingerprint(df.select(*keys, text), text).select(*keys, "fingerprint"))
    nodes = staged(rows.groupBy("fingerprint").agg(F.min(keys[0]).alias("first")))
    links = close_links(nodes.select(F.col("fingerprint").alias("node"), F.col("fingerprint").alias("fp")), radius, tile)
    roots = connected(links).withColumnRenamed("node", "fingerprint")
    member = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    owner = staged(member.join(smallest, "root").select("fingerprint", "root", "component_id"))
    return rows.join(owner, "fingerprint").select(*keys, "fingerprint", "root", "component_id")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS,
                    tile: int = TILE) -> DataFrame:
    """(key, fingerprint as long, component_id): a row for each row of ``df``."""
    return grouped(df, [key], text, radius, tile).drop("root")
