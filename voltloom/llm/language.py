"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A group of three letters is
bound into one vector: the letters' vectors, rotated by their place, are
multiplied. The vectors of all groups of a text are bundled (added); so are
those of all training texts of a language, which gives its prototype. A text
gets the language whose prototype has the highest cosine with its vector.

Adding a group's vector once for each occurrence is the same as adding it
times its count, so texts and languages are counted first. Prototypes come
from counts of ALL training rows: each task counts its own partition, and the
counts meet in a sum over (language, group). What reaches the driver is one
vector per language; more than ``max_languages`` languages are refused.
Documents are read twice and never shuffled.

Defined results: a null text, and one without a letter, is ``und`` with score
0; so is every text if no training row has a letter. Equal cosines go to the
language that comes first by code point. Repeated rows count as often as they
occur. A null key counts as empty text in the fold. An empty table gives an
empty result. Columns with the names of the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import append, crc_fold, let_go, slices

#: Letters are 1 to 63 (a to z have numbers of their own, others share 27 to 63); 0 is all else.
LETTERS = 64
GROUPS = LETTERS ** 3
DIMENSIONS = 1024
SEED = 20_240_607
UNKNOWN = "und"
#: Cells of one table of counts.
CELLS = 1 << 20
#: Letter groups whose vectors are made at one time.
VECTORS = 2048


@lru_cache(maxsize=1)
def letter_numbers() -> np.ndarray:
    """The number of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            out[cp] = cp - 96 if 97 <= cp <= 122 else 27 + cp % 37
    return out


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the letters in the first, second and third place."""
    own = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (LETTERS, dimensions))
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def group_vectors(groups: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    first, second, third = letter_vectors(dimensions, seed)
    bound = first[groups // LETTERS ** 2] * second[groups // LETTERS % LETTERS] * third[groups % LETTERS]
    return bound.astype(np.float32)


def letter_groups(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, letter group) of each group of three, word ends included."""
    padded = [f" {t.lower()} " if t else "" for t in texts]
    joined = "".join(padded).encode("utf-32-le", "surrogatepass")
    numbers = letter_numbers()[np.frombuffer(joined, np.uint32)]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    kept = numbers > 0  # and the first of each run of other characters
    kept[1:] |= (numbers[:-1] > 0) | (owner[1:] != owner[:-1])
    kept[:1] = True
    numbers, owner = numbers[kept].astype(np.int32), owner[kept]
    if len(numbers) < 3:
        return owner[:0], numbers[:0]
    groups = (numbers[:-2] * LETTERS + numbers[1:-1]) * LETTERS + numbers[2:]
    whole = (owner[:-2] == owner[2:]) & (groups > 0)
    return owner[:-2][whole], groups[whole]


def bundle(owner: np.ndarray, groups: np.ndarray, n: int, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of n texts: counts of the groups that occur, times the groups' vectors."""
    present = np.flatnonzero(np.bincount(groups, minlength=1))
    place = np.zeros(GROUPS, np.int32)
    place[present] = np.arange(len(present), dtype=np.int32)
    width = len(present)
    step = max(1, CELLS // width)  # texts whose table of counts is within CELLS
    out = np.zeros((n, dimensions), np.float32)
    bounds = np.searchsorted(owner, np.arange(0, n + step, step))
    for i, start in enumerate(range(0, n, step)):
        rows = min(step, n - start)
        part = slice(bounds[i], bounds[i + 1])
        cells = (owner[part] - start).astype(np.int64) * width + place[groups[part]]
        counts = np.bincount(cells, minlength=rows * width).reshape(rows, width)
        for k in range(0, width, VECTORS):
            out[start:start + rows] += (counts[:, k:k + VECTORS].astype(np.float32)
                                        @ group_vectors(present[k:k + VECTORS], dimensions, seed))
    return out


def language_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, letter group, count) over all rows of ``df``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                names, which = np.unique(np.array(langs[a:b], dtype=object), return_inverse=True)
                owner, groups = letter_groups(texts[a:b])
                for k, name in enumerate(names):
                    if name not in seen:
                        seen[name] = np.zeros(GROUPS, np.int64)
                    seen[name] += np.bincount(groups[which[owner] == k], minlength=GROUPS)
                if len(seen) > 64:  # many languages: hand over what was counted so far
                    yield from emit(seen)
                    seen.clear()
        yield from emit(seen)
        seen.clear()
        let_go()

    def emit(seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                ["lang", "letters", "n"])

    counted = df.select(F.col(text), F.col(lang).cast("string")).mapInArrow(run, "lang string, letters int, n long")
    return counted.groupBy("lang", "letters").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS,
          seed: int = SEED, max_languages: int = 1024) -> dict[str, np.ndarray]:
    """A unit prototype for each non-null language of the training rows."""
    def prototype(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(dimensions)
        groups, counts = rows["letters"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
        for i in range(0, len(groups), VECTORS):
            total += counts[i:i + VECTORS] @ group_vectors(groups[i:i + VECTORS], dimensions, seed)
        return pd.DataFrame({"lang": [key[0]], "vector": [total / (np.linalg.norm(total) or 1.0)]})

    counts = language_counts(df.where(F.col(lang).isNotNull()), text, lang)
    # A language has at most GROUPS rows here, however many texts it has.
    found = (counts.groupBy("lang").applyInPandas(prototype, "lang string, vector array<double>")
             .limit(max_languages + 1).collect())
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    return {r["lang"]: np.array(r["vector"]) for r in sorted(found, key=lambda r: r["lang"])}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
            dimensions: int = DIMENSIONS, seed: int = SEED,
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with lang_pred and score (the cosine, from 0 to 1)."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).T.astype(np.float32) if names else None

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        owner, groups = letter_groups(texts)
        preds, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if matrix is None or not len(groups):
            return preds, scores
        vectors = bundle(owner, groups, len(texts), dimensions, seed)
        cosines = (vectors @ matrix) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        best = np.argmax(cosines, axis=1)
        for i in np.flatnonzero(np.bincount(owner, minlength=len(texts))):
            preds[i] = names[best[i]]
            scores[i] = float(min(1.0, max(0.0, cosines[i, best[i]])))
        return preds, scores

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(batch.schema.names.index(text)).to_pylist()
        all_preds, all_scores = [], []
        for a, b in slices(texts):
            preds, scores = score(texts[a:b])
            all_preds += preds
            all_scores += scores
        return {out[0]: all_preds, out[1]: all_scores}

    return append(df, {out[0]: T.StringType(), out[1]: T.DoubleType()}, work)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             folds: int = 5, held_out: int = 0, **how: int) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all rows."""
    training = df.where(crc_fold(key, folds) != held_out).select(text, lang)
    predicted = predict(df, learn(training, text, lang, **how), text)
    return predicted.withColumn("held_out", crc_fold(key, folds) == held_out)
