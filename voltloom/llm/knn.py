"""Exact top-k by inner product: a Voronoi join of queries and data.

Pivots are data vectors. Every data vector and every query belongs to its
nearest pivot's cell. A summary of each cell (number, largest distance from
the pivot, largest length) is all the driver sees. From it follow two bounds
for a cell of queries and a cell of data:

    at most   pivots' product + |data pivot| r_q + |query pivot| r_d + r_q r_d
    at least  pivots' product - |data pivot| r_q - |query pivot| r_d - r_q r_d

A query cell's k-th best score is at least the highest lower bound that cells
with at least k vectors besides the query's own rows in total reach (as many
rows as the most repeated id has may be its own); a data cell whose upper
bound is below it is not sent there. What remains is solved exactly, in integers.

Scale. Cells of queries are cut into tiles of ``query_tile``, what a tile
needs of the data is dealt to slices of about ``slice_rows`` rows, and a task
streams its slice past the tile, holding k results per query only. Every
slice hands over k rows per query; the last step ranks those. The pivots are a
bounded sample (``pivots`` vectors); a dimension that the sample lacks is one
cell around the origin. The driver sees a row per cell: ``pivots`` of them, and
one for each further length that vectors of the table have.

Defined results: components are floor(256 x) in double precision. A vector
that is null, or has a null or non-finite component, takes no part; nor does a
null id. Different dimensions are not compared. A query does not meet rows
with its own id. Repeated rows of the data are candidates of their own;
repeated query rows give one answer. Ties go to the smaller id. A score or
component beyond a long raises an error. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.llm.base import bounded_sample, partitions, staged

K, PIVOTS, SCALE, SEED = 5, 32, 256, 11
QUERY_TILE, SLICE_ROWS = 1024, 65_536
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
#: No score yet; its negative is a long, too.
LOWEST = np.iinfo(np.int64).min + 1


def whole_numbers(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>, dim) of the rows that take part."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.where(F.col(key).isNotNull() & v.isNotNull()).where(~bad)
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .withColumn("dim", F.size("v")))


def longs(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


class Pivots(dict):
    """The pivots of each dimension; one without a sampled vector has the origin alone."""

    def __missing__(self, dim: int) -> np.ndarray:
        return np.zeros((1, dim))


def with_cell(df: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``df`` with the nearest pivot's number, the distance from it (rounded up) and the length."""
    names = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(names.index("dim")).to_numpy()
            for dim in np.unique(dims):
                part = pa.Table.from_batches([batch]).filter(pa.array(dims == dim)).combine_chunks().to_batches()[0]
                x = longs(part.column(names.index("v"))).astype(np.float64)
                p = pivots[int(dim)]
                best, far = np.zeros(len(x), np.int32), np.full(len(x), np.inf)
                for c in range(len(p)):
                    d = np.sqrt(((x - p[c]) ** 2).sum(axis=1))
                    near = d < far
                    best[near], far[near] = c, d[near]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(best), pa.array(far * (1 + 1e-9))], [*names, "cell", "far"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, schema + ", cell int, far double")


def needed(pivots: np.ndarray, queries: dict[int, float], data: dict[int, tuple[int, float]],
           k: int, repeats: int = 1) -> list[tuple[int, int]]:
    """(query cell, data cell) pairs that may hold a result; data gives (number, radius); an id has ``repeats`` rows at most."""
    out = []
    length = np.sqrt((pivots ** 2).sum(axis=1))
    for q, rq in queries.items():
        bounds = []
        for d, (n, rd) in data.items():
            mid = float(pivots[q] @ pivots[d])
            slack = (length[d] * rq + length[q] * rd + rq * rd) * (1 + 1e-9) + 1e-6 * (abs(mid) + 1)
            bounds.append((mid - slack, mid + slack, n, d))
        bounds.sort(reverse=True)
        have, least = 0, -np.inf
        for low, _, n, _ in bounds:
            have += n
            if have >= k + repeats:  # so many of them may be the query itself
                least = low
                break
        out += [(q, d) for _, high, _, d in bounds if high >= least]
    return out


def best_of(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int,
            scores: np.ndarray, found: np.ndarray) -> None:
    """Take the data into the best ``scores`` and ``found`` ids of each query, in place."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    if top < EXACT:
        product = (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    elif top < float(1 << 63):
        product = queries @ data.T
    else:
        raise OverflowError("an inner product may be beyond a long")
    low = LOWEST
    product[query_ids[:, None] == ids[None, :]] = low
    m = min(k, len(ids))
    if m < len(ids):  # every score that reaches the m-th best, ties included
        bar = np.partition(product, len(ids) - m, axis=1)[:, len(ids) - m]
    else:
        bar = np.full(len(queries), low)
    bar = np.maximum(bar, scores[:, -1])
    for i in np.flatnonzero((product.max(axis=1) >= bar)):
        at = np.flatnonzero((product[i] >= bar[i]) & (product[i] > low))
        s = np.concatenate([scores[i], product[i, at]])
        f = np.concatenate([found[i], ids[at]])
        order = np.lexsort((f, -s))[:k]
        scores[i], found[i] = s[order], f[order]


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K,
          pivots: int = PIVOTS, query_tile: int = QUERY_TILE, slice_rows: int = SLICE_ROWS,
          seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (over column id) holds."""
    spark = df.sparkSession
    numbers = whole_numbers(df, key, vector)
    sample = bounded_sample(numbers.select("id", "v", "dim"), "id", pivots, seed).collect()
    centres: dict[int, list] = {}
    for r in sample:
        centres.setdefault(r["dim"], []).append(r["v"])
    chosen = Pivots({d: np.unique(np.array(v, np.float64).reshape(len(v), -1), axis=0) for d, v in centres.items()})
    data = staged(with_cell(numbers, chosen))
    queries = data.where(is_query).dropDuplicates(["id", "v"])

    def summary(rows: DataFrame) -> dict[int, dict[int, tuple[int, float]]]:
        out: dict[int, dict[int, tuple[int, float]]] = {}
        for r in rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
            out.setdefault(r["dim"], {})[r["cell"]] = (r["n"], r["far"])
        return out

    of_data, of_queries = summary(data), summary(queries)
    # Rows with a query's own id: what the most repeated id has.
    repeats = data.groupBy("dim", "id").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n")).collect()
    repeats = {r[0]: r[1] for r in repeats}
    units = []
    for dim, cells in of_queries.items():
        pairs = needed(chosen[dim], {c: r for c, (_, r) in cells.items()}, of_data[dim], k,
                       repeats[dim])
        for q, (n, _) in cells.items():
            mine = [d for c, d in pairs if c == q]
            rows = sum(of_data[dim][d][0] for d in mine)
            tiles, parts = -(-n // query_tile), -(-rows // slice_rows)
            units += [(dim, q, d, tiles, parts) for d in mine]
    # Pairs of cells: no more than the square of the number of pivots.
    plan = spark.createDataFrame(units or [(0, -1, -1, 1, 1)], "dim int, query_cell int, cell int, tiles int, parts int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = plan.select("dim", F.col("query_cell").alias("cell"), "query_cell", "tiles", "parts").distinct()
    asked = (queries.join(F.broadcast(own), ["dim", "cell"])
             .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
             .withColumn("part", spread("parts")).withColumn("kind", F.lit(0)))
    given = (data.join(F.broadcast(plan), ["dim", "cell"])
             .withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
             .withColumn("tile", spread("tiles")).withColumn("kind", F.lit(1)))
    keys = ["dim", "query_cell", "tile", "part"]
    both = asked.select(*keys, "kind", "id", "v").unionByName(given.select(*keys, "kind", "id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking = None, []
        state: list[np.ndarray] = []

        def answer() -> Iterator[pa.RecordBatch]:
            if state:
                ids, _, scores, found = state
                q, c = np.nonzero(scores > LOWEST)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q]), pa.array(found[q, c]), pa.array(scores[q, c])], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
            starts = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)])
            for s, e in zip(starts, [*starts[1:], batch.num_rows]):
                unit, kind = tuple(marks[s, :4]), marks[s, 4]
                ids, v = batch.column(5).slice(s, e - s).to_numpy(), longs(batch.column(6).slice(s, e - s))
                if unit != now:
                    yield from answer()
                    now, asking, state = unit, [], []
                if kind == 0:
                    asking.append((ids, v))
                    continue
                if not state and asking:
                    q_ids, q = np.concatenate([a for a, _ in asking]), np.concatenate([b for _, b in asking])
                    state = [q_ids, q, np.full((len(q), k), LOWEST), np.zeros((len(q), k), np.int64)]
                if state:
                    for i in range(0, len(ids), 4096):
                        best_of(state[1], state[0], v[i:i + 4096], ids[i:i + 4096], k, state[2], state[3])
        yield from answer()

    local = (both.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "kind")
             .mapInArrow(run, "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
