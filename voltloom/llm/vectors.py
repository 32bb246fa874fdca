"""Near-duplicate vectors by sorted projection passes.

Each pass has random hyperplanes of its own; the signs of a vector's
projections, put together, are its key. The vectors of a label are ordered by
that key, and each is compared with the ``window`` vectors before it. Near
vectors differ in few signs, so they stand side by side in some pass. Links
are verified by cosine in double precision before they count, and are united
over all passes.

The window does not bound the search in dense data: vectors of a label whose
keys share the first ``prefix`` signs are a run, and where a run is longer
than a window all its pairs are compared, tile by tile. So the chance to miss
a link depends on its cosine, not on how many other vectors are near; the price
is the square of the runs' lengths. Once components are known, their members
are compared completely, too, so that the number of links is exact inside a
component however large it is. Equal vectors are one node from the start, with
the number of their rows.

Scale. A pass is a range partitioning by (pass, label, key, node), so no
label, however hot, goes to one task; the rows that follow a range are given
to it too, from as many ranges as a window reaches, so that windows do not
depend on the number of ranges. A task hands over a forest of its links.

Defined results: rows that take no part (null label, null vector, a null or
non-finite component, length zero, null id) have no links, are their own
component (null if the id is null) and are kept. Vectors of different
dimensions are not compared. Repeated rows are vectors of their own: each
counts as a link of the others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltloom.llm.base import partitions, staged
from voltloom.llm.components import connected, forest, whole_units

THRESHOLD, PASSES, WINDOW, SEED = 0.98, 24, 64, 77
PLANES = 48
#: Rows that share so many first signs are compared completely. At a cosine of 0.98 a plane parts a pair with a chance
#: of 0.064, so a pass holds both in one run with 0.453, and all passes miss them with 5e-7, whatever else the label holds.
PREFIX = 12
TILE = 1024
BLOCK = 256


def hyperplanes(number: int, dimensions: int, planes: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, number, dimensions)).standard_normal((dimensions, planes))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one dimension as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def comparable(vector: str) -> F.Column:
    """True for a vector that has a direction."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def pass_keys(nodes: DataFrame, passes: int, planes: int, seed: int) -> DataFrame:
    """A row for each node and pass: (pass, label, dim, key, node, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(planes, dtype=np.int64)[::-1]
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            dims = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = table.filter(pa.array(dims == dim)).combine_chunks().to_batches()[0]
                x = unit_rows(matrix(part.column(3)))
                for p in range(passes):
                    key = (x @ hyperplanes(p, int(dim), planes, seed) > 0) @ weights
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), p, np.int32)), part.column(0), part.column(2),
                         pa.array(key), part.column(1), part.column(3)],
                        ["pass", "label", "dim", "key", "node", "vector"])

    return nodes.select("label", "node", "dim", "vector").mapInArrow(
        run, "pass int, label string, dim int, key long, node long, vector array<double>")


def reached(rows: dict[int, int], window: int) -> list[tuple[int, int, int]]:
    """(range, later range that its windows reach, rows between them); ``rows`` has the ranges that hold any."""
    parts, out = sorted(rows), []
    for i, p in enumerate(parts):
        between = 0
        for q in parts[i + 1:]:
            if between >= window:
                break
            out.append((p, q, between))
            between += rows[q]
    return out


def window_links(nodes: DataFrame, threshold: float, passes: int, window: int,
                 planes: int = PLANES, seed: int = SEED, prefix: int = PREFIX, tile: int = TILE) -> DataFrame:
    """Verified links (a, b) between neighbours, and in runs of equal prefixes, in any pass, as forests."""
    spark = nodes.sparkSession
    order = ["pass", "label", "dim", "key", "node"]
    n = max(partitions(spark), 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(at, at + k))],
                [*b.schema.names, "part", "place"])
            at += k

    keyed = pass_keys(nodes, passes, planes, seed)
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = staged(ranged.mapInArrow(number, "pass int, label string, dim int, key long, node long, "
                                              "vector array<double>, part int, place long"))
    # Each range also gets the ``window`` rows after it, from however many ranges: a row of each range on the driver.
    rows = dict(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    reach = [(q, p, window - between) for p, q, between in reached(rows, window)]
    takers = spark.createDataFrame(reach, "part int, taker int, upto int")
    edge = (placed.join(F.broadcast(takers), "part").where(F.col("place") < F.col("upto"))
            .withColumn("part", F.col("taker")))
    ranges = placed.select("part", *order, "vector").unionByName(edge.select("part", *order, "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_units(batches, ["part", "pass", "label", "dim"]):
            node = cols["node"].to_numpy()
            pairs = [_near(matrix(cols["vector"].slice(s, e - s)), window, threshold, s)
                     for s, e in zip(starts, starts[1:]) if e - s > 1]
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs))
                low = forest(len(node), a, b)
                moved = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[low[moved]])], ["a", "b"])

    near = (ranges.repartition(n, "part").sortWithinPartitions("part", *order)
            .mapInArrow(run, "a long, b long"))
    return near.unionByName(run_links(placed, threshold, window, planes - prefix, tile))


def tiled(rows: DataFrame, keys: list[str], tile: int, least: int = 0) -> DataFrame:
    """``rows`` of the groups that have more than ``least``, once for each pair of tiles (left, right); own is the tile."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return (rows.join(sizes, keys).withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other")))


def run_links(placed: DataFrame, threshold: float, window: int, rest: int, tile: int) -> DataFrame:
    """Verified links (a, b) inside runs longer than a window, as forests; ``rest`` signs of the key do not count."""
    group = ["pass", "label", "dim", "prefix"]
    keys = [*group, "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_units(batches, keys, 1 << 14):
            node = cols["node"].to_numpy()
            for s, e in zip(starts, starts[1:]):
                a, b = _near(matrix(cols["vector"].slice(s, e - s)), int(e - s), threshold, 0)
                low = forest(int(e - s), a, b)
                moved = np.flatnonzero(low != np.arange(len(low)))
                yield pa.RecordBatch.from_arrays([pa.array(node[s + moved]), pa.array(node[s + low[moved]])], ["a", "b"])

    rows = placed.select("pass", "label", "dim", F.shiftrightunsigned("key", rest).alias("prefix"), "node", "vector")
    units = tiled(rows, group, tile, window + 1).select(*keys, "node", "vector")
    return (units.repartition(max(partitions(placed.sparkSession), 1), *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a long, b long"))


def _near(x: np.ndarray, window: int, threshold: float, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows of which one is at most ``window`` rows after the other."""
    x = unit_rows(x)
    left, right = [], []
    for i in range(0, len(x), BLOCK):
        rows, others = x[i:i + BLOCK], x[i:i + BLOCK + window]
        a, b = np.nonzero(rows @ others.T >= threshold)
        near = (b > a) & (b - a <= window)
        left.append(a[near] + i + base)
        right.append(b[near] + i + base)
    return np.concatenate(left), np.concatenate(right)


def count_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, links): the exact number of rows linked with each node inside its component.

    ``members`` has (root, node, copies, vector). A component is cut into
    tiles, and each ordered pair of tiles is a unit.
    """
    cut = tiled(members, ["root"], tile)
    keys = ["root", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts in whole_units(batches, keys, 1 << 14):
            node, copies, own = (cols[c].to_numpy() for c in ("node", "copies", "own"))
            out = np.zeros(len(node), np.int64)
            for s, e in zip(starts, starts[1:]):
                x = unit_rows(matrix(cols["vector"].slice(s, e - s)))
                linked = x @ x.T >= threshold
                if cols["left"][int(s)].as_py() != cols["right"][int(s)].as_py():
                    linked &= own[s:e, None] != own[None, s:e]  # equal tiles meet in a unit of their own
                np.fill_diagonal(linked, False)
                out[s:e] = linked @ copies[s:e]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(out)], ["node", "links"])

    units = cut.select(*keys, "node", "copies", "own", "vector").repartition(
        partitions(members.sparkSession), *keys).sortWithinPartitions(*keys)
    return units.mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW,
                    tile: int = TILE) -> DataFrame:
    """(key, n_links, component_id, kept): a row for each row of ``df``."""
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("part", comparable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    # One node for equal vectors of a label; its number is fixed by writing the table.
    nodes = staged(
        rows.where("part").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
        .groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
        .withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vector")))
    roots = connected(window_links(nodes, threshold, passes, window, tile=tile))
    member = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = member.join(roots.select("root").distinct(), "root")
    links = count_links(linked.select("root", "node", "copies", "vector"), threshold, tile)
    firsts = member.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = staged(
        member.join(firsts, "root").join(links, "node", "left")
        .select("label", "vector", "component_id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    inside = rows.where("part").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).join(
        answer, ["label", "vector"]).select("id", "n_links", "component_id")
    outside = rows.where(~F.col("part")).select("id", F.lit(0).cast("long").alias("n_links"),
                                                F.col("id").alias("component_id"))
    return inside.unionByName(outside).select(
        F.col("id").alias(key), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
