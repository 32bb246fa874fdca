"""Language-model scores from a weighted backoff automaton.

Model. Words and the end of a text are tokens. The unigram probability is the
base: (c + 0.5) / (N + 0.5 (V + 1)). A pair h w that occurs at least ``least``
times in training (2: every pair seen more than once) has an arc out of the
state h with

    p(w | h) = (c(hw) - D) / c(h) + backoff(h) p(w),

and backoff(h) is what the arcs of h leave of its probability, so that each
state's probabilities add up to one. Every other word takes the failure arc
of h, which weighs backoff(h), to the root, and the root's arc, its unigram.
A text is scored from left to right in the automaton; the state after a word
is that word, so all steps of a chunk are looked up at once.

Scale. Words and pairs grow with the corpus and are sent nowhere as a whole. A
task cuts its documents into chunks; a chunk stores its texts as numbers of
its own dictionary, and the dictionary as 64-bit hashes with training counts.
Dictionaries are shuffled in ranges of the hash: each range sums the counts
of its words over all chunks and gives each chunk back the sums of its own
words. Pairs go the same way, in ranges of a 64-bit hash of the pair, so the
followers of a frequent word are spread over all ranges. Of the chunks that
hold a pair, one counts it for its first word; these counts of arcs are summed
by word, again in ranges, and give each state's backoff. So a frequent word or
pair is one entry for each chunk, never one for each occurrence, no task holds
more than a range, and a chunk holds the part of the automaton that its own
texts can reach. Texts move as compressed numbers, chunk by chunk.

Defined results: a null text is empty: one token, its end. Words are told
apart by their 64-bit hash, and so are pairs. A null key counts as empty text in the fold (fold
0). Without training rows every token has probability 1 (N = V = 0: 0.5 /
0.5). Repeated rows count as often as they occur. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voltloom.llm.base import crc_fold, partitions, staged

LEAST, DISCOUNT, SEED = 2, 0.5, 42
#: A token counts as six bytes at least, so that a chunk has at most 2 M tokens besides its last text.
CHUNK_BYTES, TOKEN_BYTES = 12 << 20, 6
#: Odd, so that pairs of uniform hashes are uniform.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: No word holds white space, so no word has this hash's text.
END = xxhash.xxh64_intdigest(b" end of text", SEED)


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def opened(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the empty upper ones take no room."""
    return squeezed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    flat, width = opened(raw, np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, len(flat) // width).T).view(kind).ravel()


class Numbers(dict):
    """Words to numbers in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def hash_ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal ranges of 64-bit hashes starts in the sorted hashes, with the end."""
    edges = np.array([(i << 64) // parts for i in range(parts)], np.uint64)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


class Chunk:
    """Texts as numbers, and the dictionary they refer to."""

    def __init__(self) -> None:
        self.words, self.rows, self.size = Numbers(), [], 0

    def add(self, key: object, held: bool, raw: bytes | None) -> None:
        words = raw.lower().split() if raw else []
        self.rows.append((key, held, np.array(list(map(self.words.__getitem__, words)), np.int32)))
        self.size += max(len(raw or b""), TOKEN_BYTES * len(words)) + 64

    def close(self, parts: int) -> tuple[list[tuple], tuple, list[tuple]]:
        """(rows of documents, the texts, rows of dictionary ranges); numbers follow the order of the hashes."""
        digest = xxhash.xxh64_intdigest
        hashes = np.array([*(digest(w, SEED) for w in self.words), END], np.uint64)
        hashes, place = np.unique(hashes, return_inverse=True)
        end = len(place) - 1
        texts = [x for _, _, numbers in self.rows for x in (numbers, [end])]
        tokens = place[np.concatenate(texts).astype(np.int64)].astype(np.int32)
        # The length of a held-out text is negative.
        lengths = np.array([-len(x) - 1 if held else len(x) + 1 for _, held, x in self.rows], np.int64)
        trained = tokens[np.repeat(lengths > 0, np.abs(lengths))]
        counts = np.bincount(trained, minlength=len(hashes)).astype(np.int64)
        docs = [(key, held, i) for i, (key, held, _) in enumerate(self.rows)]
        cut = hash_ranges(hashes, parts)
        ranges = [(i, hashes[a:b].tobytes(), squeezed(counts[a:b]), len(trained) if i == 0 else 0)
                  for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a or i == 0]
        return docs, (hashes.tobytes(), planes(tokens), squeezed(lengths)), ranges


def chunks(df: DataFrame, key: str, text: str, held: F.Column, parts: int) -> DataFrame:
    """(chunk, part, key, held_out, a, b, c, n): numbered documents (part null), texts (part -1), dictionary ranges."""
    kind = df.schema[key].dataType
    arrow = to_arrow_type(kind)
    names = ["chunk", "part", "key", "held_out", "a", "b", "c", "n"]

    def rows(number: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        docs, texts, ranges = chunk.close(parts)
        rest = [(-1, None, None, *texts, 0)] + [(i, None, None, h, c, None, n) for i, h, c, n in ranges]
        for out in ([(None, key, held, None, None, None, i) for key, held, i in docs], rest):
            kinds = [pa.int32(), arrow, pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(out), pa.int64()),
                 *(pa.array(list(c), k) for c, k in zip(zip(*out), kinds))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for k, h, raw in zip(batch.column(0), batch.column(1), batch.column(2)):
                chunk.add(k.as_py(), h.as_py(), raw.as_py())
                if chunk.size >= CHUNK_BYTES:
                    yield from rows(number, chunk)
                    number, chunk = number + 1, Chunk()
        if chunk.rows:
            yield from rows(number, chunk)

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("key", kind),
        T.StructField("held_out", T.BooleanType()), T.StructField("a", T.BinaryType()),
        T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()), T.StructField("n", T.LongType())])
    return df.select(F.col(key), held, F.col(text).cast("binary")).mapInArrow(run, schema)


def word_counts(stored: DataFrame) -> DataFrame:
    """(chunk, part, counts, known): for each chunk and range the sums of its words over all chunks.

    Chunk -1 holds the number of known words of each range.
    """
    def total(table: pa.Table) -> pa.Table:
        chunk, part = table.column("chunk").to_pylist(), table.column("part")[0].as_py()
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, place, np.concatenate([opened(x.as_py(), np.int64) for x in table.column("b")]))
        mine = np.split(sums[place], np.cumsum([len(h) for h in hashes])[:-1])
        return pa.table({"chunk": pa.array([-1, *chunk], pa.int64()),
                         "part": pa.array([part] * (len(chunk) + 1), pa.int32()),
                         "counts": pa.array([None, *map(squeezed, mine)], pa.binary()),
                         "known": pa.array([int((sums > 0).sum()), *[0] * len(chunk)], pa.int64())})

    ranges = stored.where("part >= 0").select("chunk", "part", "a", "b")
    return ranges.groupBy("part").applyInArrow(total, "chunk long, part int, counts binary, known long")


def pairs_of(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, number of the first and of the second word, training count) of a chunk's pairs, by hash."""
    size = np.abs(lengths)
    later = np.ones(len(tokens), bool)
    later[np.cumsum(size) - size] = False
    at = np.flatnonzero(later)
    keys = tokens[at - 1].astype(np.int64) * len(hashes) + tokens[at]
    training = np.repeat(lengths > 0, size)[at]
    del at, later
    trained, times = np.unique(keys[training], return_counts=True)
    keys = np.unique(keys)
    n = np.zeros(len(keys), np.int64)
    n[np.searchsorted(keys, trained)] = times
    h, w = keys // len(hashes), keys % len(hashes)
    mixed = hashes[h] * MIX + hashes[w]
    order = np.argsort(mixed)
    return mixed[order], h[order], w[order], n[order]


def opened_texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, lengths, hashes of the words) of a chunk."""
    return unplaned(row["b"], np.int32), opened(row["c"], np.int64), np.frombuffer(row["a"], np.uint64)


def pair_counts(stored: DataFrame, least: int, parts: int) -> DataFrame:
    """(chunk, part, counts, heads, n, arcs): the sums of a chunk's pairs over all chunks, in order of their hash.

    Of the chunks that hold a pair, one has it among its ``heads``: numbers of
    first words, with the occurrences and the number of their arcs.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                pairs, h, _, n = pairs_of(*opened_texts(r))
                cut = hash_ranges(pairs, parts)
                out = [(r["chunk"], i, planes(np.diff(pairs[a:b], prepend=np.uint64(0))), planes(n[a:b]),
                        planes(h[a:b].astype(np.int32))) for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["chunk", "part", "pairs", "n", "h"])

    def total(table: pa.Table) -> pa.Table:
        column = lambda c, kind: [unplaned(x.as_py(), kind) for x in table.column(c)]
        pairs = [np.cumsum(x, dtype=np.uint64) for x in column("pairs", np.uint64)]
        every, first, place = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, place, np.concatenate(column("n", np.int64)))
        sums[sums < least] = 0
        mine, counted = sums[place], np.zeros(len(place), bool)
        counted[first] = sums > 0
        out, at = [], 0
        for c, h in zip(table.column("chunk").to_pylist(), column("h", np.int32)):
            n, own = mine[at:at + len(h)], counted[at:at + len(h)]
            heads, where = np.unique(h[own], return_inverse=True)
            sizes = np.bincount(where, weights=n[own], minlength=len(heads)).astype(np.int64)
            arcs = np.bincount(where, minlength=len(heads)).astype(np.int64)
            out.append((c, planes(n), planes(heads), planes(sizes), planes(arcs)))
            at += len(h)
        chunk, *rest = zip(*out)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "part": table.column("part").combine_chunks(),
                         **{k: pa.array(x, pa.binary()) for k, x in zip(("counts", "heads", "n", "arcs"), rest)}})

    local = stored.where("part = -1").select("chunk", "a", "b", "c").mapInArrow(
        count, "chunk long, part int, pairs binary, n binary, h binary")
    return local.groupBy("part").applyInArrow(
        total, "chunk long, part int, counts binary, heads binary, n binary, arcs binary")


def state_counts(stored: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """(chunk, part, n, arcs): what the arcs of a chunk's words hold over all chunks: occurrences and arcs."""
    def spread(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = np.frombuffer(next(r["a"] for r in rows if r["a"] is not None), np.uint64)
        n, arcs = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for r in rows:
            if r["a"] is None:
                heads = unplaned(r["heads"], np.int32)
                n[heads] += unplaned(r["n"], np.int64)
                arcs[heads] += unplaned(r["arcs"], np.int64)
        cut = hash_ranges(hashes, parts)
        out = [(rows[0]["chunk"], i, hashes[a:b].tobytes(), planes(n[a:b]), planes(arcs[a:b]))
               for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                        names=["chunk", "part", "a", "n", "arcs"])

    def total(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")]
        every, place = np.unique(np.concatenate(hashes), return_inverse=True)
        out = {"chunk": table.column("chunk"), "part": table.column("part")}
        for c in ("n", "arcs"):
            sums = np.zeros(len(every), np.int64)
            np.add.at(sums, place, np.concatenate([unplaned(x.as_py(), np.int64) for x in table.column(c)]))
            mine = np.split(sums[place], np.cumsum([len(h) for h in hashes])[:-1])
            out[c] = pa.array(list(map(planes, mine)), pa.binary())
        return pa.table(out)

    words = stored.where("part = -1").select("chunk", "a")
    both = pairs.select("chunk", "heads", "n", "arcs").unionByName(words, allowMissingColumns=True)
    local = both.groupBy("chunk").applyInArrow(spread, "chunk long, part int, a binary, n binary, arcs binary")
    return local.groupBy("part").applyInArrow(total, "chunk long, part int, n binary, arcs binary")


class Automaton:
    """States are words with arcs; the root is state -1.

    ``used`` is the probability mass times c(h) that all arcs of each state
    hold; without it, the given arcs are all.
    """

    def __init__(self, counts: np.ndarray, h: np.ndarray, w: np.ndarray, n: np.ndarray, total: int, known: int,
                 discount: float = DISCOUNT, used: np.ndarray | None = None) -> None:
        self.width = max(1, len(counts))
        self.total, self.known = total, known
        if used is None:
            used = np.bincount(h, weights=n - discount, minlength=len(counts)) if len(h) else np.zeros(len(counts))
        left = 1 - used / np.maximum(counts, 1)
        self.root = np.log10(self.unigram(counts))
        p = (n - discount) / np.maximum(counts[h], 1) + left[h] * self.unigram(counts[w])
        keys = h * self.width + w
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], np.log10(p)[order]
        self.backoff = np.log10(left)
        self.is_state = used > 0

    @property
    def arcs(self) -> dict[int, float]:
        return dict(zip(self.keys.tolist(), self.weights.tolist()))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.total + 0.5 * (self.known + 1))

    def walk(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 weight of each step: arcs where there are any, else the failure arc and the root's arc.

        At ``starts`` texts begin, in the root.
        """
        weights = self.root[tokens]
        inside = np.ones(len(tokens), bool)
        inside[starts] = False
        inside[1:] &= self.is_state[tokens[:-1]]
        at = np.flatnonzero(inside)
        h = tokens[at - 1].astype(np.int64)
        keys = h * self.width + tokens[at]
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        arc = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        weights[at[~arc]] += self.backoff[h[~arc]]
        weights[at[arc]] = self.weights[place[arc]]
        return weights


def score(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1,
          least: int = LEAST) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``df``."""
    parts = max(64, partitions(df.sparkSession))
    stored = staged(chunks(df, key, text, crc_fold(key, folds) == held_out, parts))
    total = stored.where("part >= 0").agg(F.sum("n")).first()[0] or 0
    words = staged(word_counts(stored))
    known = words.where("chunk = -1").agg(F.sum("known")).first()[0] or 0
    pairs = staged(pair_counts(stored, least, parts))
    states = state_counts(stored, pairs, parts)
    kind = df.schema[key].dataType

    def walk(table: pa.Table) -> pa.Table:
        of = table.column("of").to_numpy()
        docs = table.filter(pa.array(of == 0)).sort_by("number")
        tokens, lengths, hashes = opened_texts(table.filter(pa.array(of == 1)).to_pylist()[0])

        def whole(what: int, column: str, read=unplaned) -> np.ndarray:
            rows = table.filter(pa.array(of == what)).sort_by("part")
            return np.concatenate([np.zeros(0, np.int64), *(read(x.as_py(), np.int64) for x in rows.column(column))])

        counts = whole(2, "a", opened)
        _, h, w, _ = pairs_of(tokens, lengths, hashes)
        n = whole(3, "a")
        arc = n > 0
        automaton = Automaton(counts, h[arc], w[arc], n[arc], total, known,
                              used=whole(4, "a") - DISCOUNT * whole(4, "b"))
        size = np.abs(lengths)
        starts = np.cumsum(size) - size
        sums = lambda x: np.add.reduceat(x, starts)
        return pa.table([
            docs.column("key"), docs.column("held_out"), pa.array(size), pa.array(sums((counts[tokens] > 0).astype(int))),
            pa.array([total] * len(size), pa.int64()), pa.array(sums(automaton.root[tokens])),
            pa.array(sums(automaton.walk(tokens, starts)))],
            names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = T.StructType([
        T.StructField("key", kind), T.StructField("held_out", T.BooleanType()),
        *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score"))])
    of = lambda df, what, *columns: df.select("chunk", F.lit(what).alias("of"), *columns)
    every = of(stored.where("part IS NULL"), 0, "key", "held_out", F.col("n").alias("number"))
    for more in (of(stored.where("part = -1"), 1, "a", "b", "c"),
                 of(words.where("chunk >= 0"), 2, "part", F.col("counts").alias("a")),
                 of(pairs, 3, "part", F.col("counts").alias("a")),
                 of(states, 4, "part", F.col("n").alias("a"), F.col("arcs").alias("b"))):
        every = every.unionByName(more, allowMissingColumns=True)
    return every.groupBy("chunk").applyInArrow(walk, schema).withColumnRenamed("key", key)
