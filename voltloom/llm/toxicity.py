"""Toxicity by a factorization machine over hashed terms.

The score of a text is a bias, a weight for each of its terms, and for each
pair of its terms the product of two short vectors: pairs that mean more
together than apart (an insult with a mention of a group) get a weight of
their own without one parameter per pair. Terms are hashed words; a text has
a term or not.

Every word has a row: its hash modulo ``buckets``. No term is chosen or left
out. Each row has a scale, which is higher for terms in more rows and for
terms that tell the classes apart (chi-square), but never below ``FLOOR``
times that of the best one of equal frequency: a pair of words that mean
nothing one by one is still learned, and the many words that stand in a few
rows only cannot explain a class.

Learning uses a bounded sample: of each class the ``rows_per_class`` rows
with the smallest seeded hash, and of these, in that order, as many as hold
at most ``places_per_class`` terms. Spark finds the sample's terms; the fit
sees at most so many rows and terms, whatever the corpus. A second fit without
a third of the sample tells how to stretch margins so that scores are chances.
The share of the classes among ALL training labels sets the bias. The model (at most
``buckets`` rows) is sent to all tasks: its size does not depend on the
corpus. Scoring is one pass over the documents without a shuffle.

Defined results: a null text is scored like an empty one (the bias alone).
Labels that are null are left out; several labels of one document count as
toxic if one of them is. Without labels of both classes every score is the
share of toxic labels (0 without any). A null key counts as empty text in the
fold. Empty tables give empty results. Repeated rows get repeated scores; of a
labelled id with several texts, the text with the smallest hash is learned.
Words whose row no sampled text holds count for nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import append, bounded_sample, crc_fold, staged

ROWS_PER_CLASS, PLACES_PER_CLASS, BUCKETS, FACTORS, SEED = 10_000, 4_000_000, 1 << 18, 8, 5
#: The least scale of a term beside that of the most telling one, and the rows at which a term has half its full scale.
FLOOR, HALF_ROWS = 0.05, 3.0
THRESHOLD = 0.7
WORDS = re.compile(r"\w+")
REMEMBERED = 500_000


def term_of(word: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % buckets


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


@dataclass
class Machine:
    """A fitted factorization machine; ``terms`` are the hashes its rows stand for, of ``buckets`` possible ones."""
    bias: float
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    buckets: int = BUCKETS

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Scores on the logistic scale of rows of zeros and ones."""
        s = x @ self.factors
        return self.bias + x @ self.weights + 0.5 * ((s * s).sum(1) - x @ (self.factors ** 2).sum(1))

    def margin(self, rows: Sequence[int] | np.ndarray) -> float:
        v = self.factors[rows]
        s = v.sum(0)
        return float(self.bias + self.weights[rows].sum() + 0.5 * (s @ s - (v * v).sum()))


def logistic(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, terms: np.ndarray, share: float, **how) -> Machine:
    """``fit_sparse`` for rows of zeros and ones; column i stands for ``terms[i]``."""
    model = fit_sparse([np.flatnonzero(r) for r in x], y, x.shape[1], share, **how)
    return Machine(model.bias, terms[model.terms], model.weights, model.factors, model.buckets)


def scales(rows: Sequence[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """How much each term may say before the fit: 0 to 1, above 0 for every term that stands in a row."""
    n, toxic = len(y), y.sum()
    held = np.zeros(buckets)
    with_it = np.zeros(buckets)
    for row, t in zip(rows, y):
        held[row] += 1
        with_it[row] += t
    chi = (with_it * n - held * toxic) ** 2 * n / (np.maximum(held, 1) * (n - held + 1) * max(toxic * (n - toxic), 1e-9))
    found = held / (held + HALF_ROWS) * np.sqrt(FLOOR ** 2 + chi / (chi.max() + 10))
    return found / max(found.max(), 1e-12)


@dataclass
class Step:
    """Some rows of the sample, laid out for sums by row and by term."""
    rows: np.ndarray     # places in the sample
    terms: np.ndarray    # distinct terms of these rows
    at: np.ndarray       # of each cell, row after row: its place in ``terms``
    starts: np.ndarray   # of each row: its first cell
    filled: np.ndarray   # rows that have a cell
    by_term: np.ndarray  # the row of each cell, term after term
    first: np.ndarray    # of each term: its first place in ``by_term``

    def per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.rows), *values.shape[1:]))
        if len(self.at):
            out[self.filled] = np.add.reduceat(values[self.at], self.starts[self.filled], axis=0)
        return out

    def per_term(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.by_term], self.first, axis=0) if len(self.at) else values[:0]


def step(rows: Sequence[np.ndarray], part: np.ndarray) -> Step:
    sizes = np.array([len(rows[i]) for i in part])
    cells = np.concatenate([rows[i] for i in part]).astype(np.int32)
    terms, at = np.unique(cells, return_inverse=True)
    order = np.argsort(at, kind="stable")
    return Step(part, terms, at.astype(np.int32), np.cumsum(sizes) - sizes, np.flatnonzero(sizes),
                np.repeat(np.arange(len(part), dtype=np.int32), sizes)[order],
                np.searchsorted(at[order], np.arange(len(terms))))


def fit_sparse(rows: Sequence[np.ndarray], y: np.ndarray, buckets: int, share: float, factors: int = FACTORS,
               epochs: int = 12, rate: float = 0.3, lead: float = 8.0, ridge: tuple[float, float] = (0.01, 0.03), size: int = 128, seed: int = SEED) -> Machine:
    """Adaptive gradient steps over rows of distinct terms; rows are weighed to the share of toxic labels.

    ``ridge`` holds back weights and factors, as often in an epoch for a rare term as for a frequent one. Weights move
    ``lead`` times as fast as factors, so that a pair gets what its terms do not say alone.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    scale = scales(rows, y, buckets).astype(np.float32)
    used = np.flatnonzero(scale)
    bias, past_b = float(np.log(share / (1 - share))), 1.0
    w, past_w, met = (np.full(buckets, v, np.float32) for v in (0, 1, 0))
    v, past_v = np.zeros((buckets, factors), np.float32), np.ones((buckets, factors), np.float32)
    v[used] = rng.normal(0, 0.05, (len(used), factors))
    steps = [step(rows, order[i:i + size]) for i in range(0, len(order), size)]
    for s in steps:
        met[s.terms] += 1
    for _ in range(epochs):
        for k in rng.permutation(len(steps)):
            s = steps[k]
            x, wt, vt = scale[s.terms], w[s.terms], v[s.terms]
            scaled = vt * x[:, None]
            held = s.per_row(scaled)
            z = bias + s.per_row(wt * x) + 0.5 * ((held * held).sum(1) - s.per_row((scaled * scaled).sum(1)))
            g = (logistic(z) - y[s.rows]) * weight[s.rows]
            by_term, seen = s.per_term(g), met[s.terms]
            gw = x * by_term + ridge[0] / seen * wt
            gv = x[:, None] * (s.per_term(g[:, None] * held) - scaled * by_term[:, None]) + (ridge[1] / seen)[:, None] * vt
            gb = float(g.sum())
            past_b += gb * gb
            past_w[s.terms] += gw * gw
            past_v[s.terms] += gv * gv
            bias -= rate * gb / past_b ** 0.5
            w[s.terms] = wt - lead * rate * gw / np.sqrt(past_w[s.terms])
            v[s.terms] = vt - rate * gv / np.sqrt(past_v[s.terms])
    return Machine(bias, used, (w * scale)[used].astype(float), (v * scale[:, None])[used].astype(float), buckets)


def slope_and_shift(z: np.ndarray, y: np.ndarray, weight: np.ndarray, hold: float = 5.0, rounds: int = 50) -> tuple[float, float]:
    """(a, b) for which logistic(a z + b) fits ``y`` best; ``hold`` keeps them near (1, 0) where few rows tell."""
    z = np.clip(z, -30, 30)
    x = np.stack([z, np.ones(len(z))], axis=1)
    at = start = np.array([1.0, 0.0])

    def loss(ab: np.ndarray) -> float:
        m = x @ ab
        return float((weight * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * hold * ((ab - start) ** 2).sum())

    for _ in range(rounds):
        p = logistic(x @ at)
        slope = x.T @ (weight * (p - y)) + hold * (at - start)
        move = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(2), slope)
        length, now = 1.0, loss(at)
        while length > 1e-6 and (at[0] - length * move[0] <= 0 or loss(at - length * move) > now):
            length /= 2
        if length <= 1e-6 or np.abs(length * move).max() < 1e-9:
            break
        at = at - length * move
    return float(at[0]), float(at[1])


def fit_calibrated(rows: Sequence[np.ndarray], y: np.ndarray, buckets: int, share: float, seed: int = SEED) -> Machine:
    """``fit_sparse`` on all rows, its margins stretched and shifted so that a score is a chance.

    The holding back of ``fit_sparse`` keeps margins of rows it has not seen near the bias. How far is told by a
    machine fitted without every third row, on those rows. Slope (above 0) and shift go into the machine itself: the
    order of scores stays.
    """
    back = np.arange(len(rows)) % 3 == 0
    model = fit_sparse(rows, y, buckets, share, seed=seed)
    if not 0 < y[~back].mean() < 1 or not 0 < y[back].mean() < 1:
        return model
    part = fit_sparse([r for r, b in zip(rows, back) if not b], y[~back], buckets, share, seed=seed)
    place = np.full(buckets, -1, np.int64)
    place[part.terms] = np.arange(len(part.terms))
    found = (place[r] for r, b in zip(rows, back) if b)
    z, truth = np.array([part.margin(p[p >= 0]) for p in found]), y[back]
    weight = np.where(truth > 0, share / truth.mean(), (1 - share) / (1 - truth.mean()))
    a, b = slope_and_shift(z, truth, weight)
    return Machine(a * model.bias + b, model.terms, a * model.weights, a ** 0.5 * model.factors, buckets)


def sample_terms(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """(toxic, hash, n, terms) of the sample's rows; ``terms`` as four-byte numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted({term_of(w, buckets) for w in words_of(t.as_py())}), np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([f.tobytes() for f in found], pa.binary())], ["toxic", "hash", "n", "terms"])

    return docs.select("toxic", "hash", text).mapInArrow(run, "toxic int, hash long, n long, terms binary")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 3, held_out: int = 1, rows_per_class: int = ROWS_PER_CLASS,
          places_per_class: int = PLACES_PER_CLASS, buckets: int = BUCKETS, seed: int = SEED) -> Machine:
    training = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (crc_fold(key, folds) != held_out))
                .groupBy(key).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic")))
    # One row for each document that has a label; documents that are missing count for nothing.
    labelled = staged(docs.select(key).distinct().join(training, key))
    count = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if not toxic or not clean:
        p = min(max(toxic / max(1, toxic + clean), 1e-12), 1 - 1e-12)
        return Machine(float(np.log(p / (1 - p))))
    picked = bounded_sample(labelled.where("toxic = 1"), key, rows_per_class, seed).unionByName(
        bounded_sample(labelled.where("toxic = 0"), key, rows_per_class, seed))
    # At most two classes of rows_per_class keys: a size that does not grow with the corpus.
    mine = docs.select(key, text).join(F.broadcast(picked), key)
    first = F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")))
    sample = mine.groupBy(key, "toxic").agg(first.alias("first")).select(
        "toxic", F.xxhash64(F.lit(seed), F.col(key)).alias("hash"), F.col("first.text").alias(text))
    # At most 2 x rows_per_class rows in these windows, and 2 x places_per_class numbers of four bytes reach the driver.
    so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy("hash", "terms").rowsBetween(Window.unboundedPreceding, 0))
    seen = staged(sample_terms(sample, text, buckets))
    kept = seen.select("toxic", "hash", so_far.alias("so_far")).where(F.col("so_far") <= places_per_class)
    last = {r["toxic"]: r["hash"] for r in kept.groupBy("toxic").agg(F.max("hash").alias("hash")).collect()}
    inside = F.lit(False)
    for kind, edge in last.items():
        inside = inside | ((F.col("toxic") == kind) & (F.col("hash") <= edge))
    # Sorted here, not in Spark: the sample is small, and two classes would be two keys.
    table = seen.where(inside).select("toxic", "hash", "terms").toArrow().sort_by([("toxic", "ascending"), ("hash", "ascending")])
    if len(last) < 2:
        return Machine(float(np.log(toxic / clean)))
    rows = [np.frombuffer(t, np.int32) for t in table.column("terms").to_pylist()]
    y = table.column("toxic").to_numpy().astype(np.float64)
    return fit_calibrated(rows, y, buckets, toxic / (toxic + clean), seed)


class Places(dict):
    """Word to the model's row, -1 for none."""

    def __init__(self, terms: np.ndarray, buckets: int) -> None:
        super().__init__()
        self.row = np.full(buckets, -1, np.int32)
        self.row[terms] = np.arange(len(terms), dtype=np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = at = int(self.row[term_of(word, len(self.row))])
        return at


def score(df: DataFrame, model: Machine, text: str = "text", threshold: float = THRESHOLD,
          out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from the threshold on)."""
    kept: list[Places] = []  # one for a task's slices

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        if not kept:
            kept.append(Places(model.terms, model.buckets))
        places, scores = kept[0], []
        for value in batch.column(batch.schema.names.index(text)):
            if len(places) > REMEMBERED:
                places.clear()
            rows = [r for r in map(places.__getitem__, words_of(value.as_py())) if r >= 0]
            scores.append(float(logistic(model.margin(sorted(rows)))))
        return {out[0]: scores, out[1]: [int(s >= threshold) for s in scores]}

    return append(df, {out[0]: T.DoubleType(), out[1]: T.IntegerType()}, work)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          folds: int = 3, held_out: int = 1, threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, score all documents."""
    model = learn(docs, labels, key, text, label, folds, held_out, **how)
    return score(docs, model, text, threshold).withColumn("held_out", crc_fold(key, folds) == held_out)
