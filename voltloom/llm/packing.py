"""Packing documents into sequences by order-preserving dynamic programming.

Documents stay in the order in which the table's files hold them; a document's
ids and one end id follow each other, and the stream is cut into windows of at
most ``size`` tokens. A cut may stand behind a document (no penalty), behind a
sentence (``SENTENCE``) or, where no such place is near, every ``GRID`` tokens
inside a long sentence (``HARD``). A window costs what it is padded with:
``SHORT`` if its length is a power of two below ``size`` (it needs no padding,
but is one more sequence), else what it lacks to ``size``. The
sum of padding and penalties is the least over all choices of cuts in a block:

    least(j) = penalty(j) + min over i, place(j) - place(i) <= size, of
               least(i) + size - (place(j) - place(i))

where the minimum of least(i) + place(i) comes from a monotone queue, so each
place enters and leaves it once, and windows whose length is a power of two
are looked up besides.

No shuffle: each partition of the scan packs its own rows, and no sequence
reaches over a partition's end. A block of ``BLOCK`` tokens is cut at a time;
its last window stays open and opens the next block, so nothing is padded at
a block's end, and memory holds one block and one document's ids, whatever
the partition. Give it a table that reads alike on every run (files, a staged
table): then reruns and recomputed partitions give the same sequences.

Defined results: a null text is an empty one; its document is the end id
alone. Repeated rows are packed as often as they occur, null ids too; an
empty table gives an empty result. Pieces carry ``doc_id`` (any type) and no
other column of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from voltloom.llm.tokens import Bytes, File

SIZE, BLOCK, GRID = 1024, 1 << 18, 32
SENTENCE, HARD, SHORT = 8, 32, 32

#: A task's sequences are numbered from its partition's number times this.
NUMBERS = 1 << 33

PIECE = {"start": T.LongType(), "length": T.LongType(), "doc_tokens": T.LongType(), "sequence_id": T.LongType(),
         "offset": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "ids_crc32": T.LongType()}
BASIC = ("start", "length", "doc_tokens", "sequence_id", "offset")


def sentence_marks(strings: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether a sentence may end with it, and whether what follows a sentence may begin with it."""
    # The last entry is for special tokens, which end and begin nothing.
    return (np.array([*(s[-1:] in (b".", b"!", b"?", b"\n") for s in strings), False]),
            np.array([*(s[:1] in (b" ", b"\n", b"\r", b"\t") for s in strings), False]))


def places(sentences: np.ndarray, documents: np.ndarray, total: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may stand, ascending from 0 to ``total``, and the penalty of each."""
    natural = np.union1d(np.concatenate([sentences, documents]), [0, total]).astype(np.int64)
    gaps = np.diff(natural)
    # Inside a gap above two steps: every step, so that no two places are further apart than that.
    more = np.where(gaps > 2 * grid, (gaps - 1) // grid, 0)
    first = np.repeat(np.cumsum(more) - more, more)
    added = np.repeat(natural[:-1], more) + (np.arange(len(first)) - first + 1) * grid
    at = np.union1d(natural, added)
    penalty = np.full(len(at), HARD, np.int64)
    penalty[np.searchsorted(at, natural)] = SENTENCE
    penalty[np.searchsorted(at, np.union1d(documents, [0, total]).astype(np.int64))] = 0
    return at, penalty


def cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """The places, first and last included, between which padding and penalties are the least."""
    exact_to, exact_from = [], []
    length = 1
    while length < size:
        found = np.minimum(np.searchsorted(at, at - length), len(at) - 1)
        hit = np.flatnonzero(at[found] == at - length)
        exact_to.append(hit)
        exact_from.append(found[hit])
        length *= 2
    to = np.concatenate(exact_to)
    order = np.argsort(to, kind="stable")
    exact = list(zip(to[order].tolist(), np.concatenate(exact_from)[order].tolist()))
    exact.append((len(at), 0))
    place, extra = at.tolist(), penalty.tolist()
    least, came, value = [0] * len(place), [0] * len(place), [0] * len(place)
    value[0] = place[0]
    queue, head, e = [0], 0, 0
    for j in range(1, len(place)):
        here = place[j]
        while here - place[queue[head]] > size:
            head += 1
        best_from = queue[head]
        best = value[best_from] + size - here
        while exact[e][0] == j:
            i = exact[e][1]
            if least[i] + SHORT < best:
                best, best_from = least[i] + SHORT, i
            e += 1
        best += extra[j]
        least[j], came[j] = best, best_from
        value[j] = best = best + here
        while len(queue) > head and value[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out = [len(place) - 1]
    while out[-1]:
        out.append(came[out[-1]])
    return at[out[::-1]]


class Packer:
    """The open stream of one task: documents' parts that no closed sequence holds yet."""

    def __init__(self, bpe: Bytes, size: int, end_id: int, first: int, block: int) -> None:
        self.bpe, self.size, self.end_id, self.block = bpe, size, end_id, block
        self.ends, self.begins = sentence_marks(bpe.strings)
        self.parts: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []
        self.tokens, self.next = 0, first

    def add(self, doc_id: object, text: str | None) -> Iterator[tuple]:
        ids = np.append(self.bpe.encode(text, special=True) if text else np.zeros(0, np.int32), np.int32(self.end_id))
        for start in range(0, len(ids), self.block):
            part = ids[start:start + self.block]
            known = np.minimum(ids[start:start + len(part) + 1], len(self.ends) - 1)
            marks = np.flatnonzero(self.ends[known[:-1]] & self.begins[known[1:]]) + 1
            self.parts.append((doc_id, start, len(ids), part, marks))
            self.tokens += len(part)
            if self.tokens >= self.block:
                yield from self.close(keep=True)

    def close(self, keep: bool) -> Iterator[tuple]:
        """Pieces of the closed sequences; ``keep`` leaves the last window open."""
        if not self.parts:
            return
        lengths = np.array([len(p[3]) for p in self.parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        sentences = np.concatenate([p[4] + b for p, b in zip(self.parts, bounds)])
        whole = [b for p, b in zip(self.parts, bounds[1:]) if p[1] + len(p[3]) == p[2]]
        at = cuts(*places(sentences, np.array(whole, np.int64), int(bounds[-1]), GRID), self.size)
        last = int(at[-2]) if keep else int(at[-1])
        at = at[at <= last]
        edges = np.union1d(at, bounds[bounds <= last])
        part_of = np.searchsorted(bounds, edges[:-1], "right") - 1
        window = np.searchsorted(at, edges[:-1], "right") - 1
        # A document cut between two blocks' feeds is one piece all the same if no sequence ends there.
        open_piece = None
        for k, w, start, stop in zip(part_of.tolist(), window.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            doc_id, begin, doc_tokens, ids, _ = self.parts[k]
            inside = start - int(bounds[k])
            ids = ids[inside:inside + stop - start]
            if open_piece and open_piece[4] == self.next + w and begin + inside and open_piece[6] == k - 1:
                ids = np.concatenate([open_piece[3], ids])
                open_piece = (*open_piece[:3], ids, *open_piece[4:6], k)
                continue
            if open_piece:
                yield open_piece[:6]
            open_piece = (doc_id, begin + inside, doc_tokens, ids, self.next + w, start - int(at[w]), k)
        if open_piece:
            yield open_piece[:6]
        self.next += max(len(at) - 1, 0)
        rest = []
        for k, (doc_id, begin, doc_tokens, ids, marks) in enumerate(self.parts):
            gone = min(max(last - int(bounds[k]), 0), len(ids))
            if gone < len(ids):
                rest.append((doc_id, begin + gone, doc_tokens, ids[gone:].copy(), marks[marks > gone] - gone))
        self.parts, self.tokens = rest, int(bounds[-1]) - last


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 0, key: str = "doc_id", text: str = "text",
         outputs: Sequence[str] = ("ids",), block: int = BLOCK) -> DataFrame:
    """One row per piece: key, ``BASIC`` and the wanted ones of ``ids`` and ``ids_crc32``.

    ``vocabulary`` is the path of a byte-level BPE file on the driver;
    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit numbers.
    """
    if size < 2 * GRID or block < 16 * size:
        raise ValueError(f"a sequence must hold {2 * GRID} tokens, and a block 16 sequences, at least")
    file = File(docs.sparkSession, vocabulary)
    kind = docs.schema[key].dataType
    names = [*BASIC, *outputs]
    schema = T.StructType([T.StructField(key, kind), *(T.StructField(n, PIECE[n]) for n in names)])
    key_kind = to_arrow_type(kind)

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([p[0] for p in pieces], key_kind)]
        for n in names:
            if n == "ids_crc32":
                values = [zlib.crc32(p[3].astype("<u4").tobytes()) for p in pieces]
            elif n == "ids":
                values = [p[3] for p in pieces]
            elif n == "length":
                values = [len(p[3]) for p in pieces]
            else:
                values = [p[{"start": 1, "doc_tokens": 2, "sequence_id": 4, "offset": 5}[n]] for p in pieces]
            columns.append(pa.array(values, to_arrow_type(PIECE[n])))
        return pa.RecordBatch.from_arrays(columns, [key, *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(file.bytes(), size, end_id, TaskContext.get().partitionId() * NUMBERS, block)
        made: list[tuple] = []

        def full() -> Iterator[pa.RecordBatch]:
            if len(made) >= 1024:
                yield rows(made)
                made.clear()

        for batch in batches:
            keys, texts = (batch.column(batch.schema.names.index(c)) for c in (key, text))
            for k, t in zip(keys, texts):
                for piece in packer.add(k.as_py(), t.as_py()):
                    made.append(piece)
                    yield from full()
        for piece in packer.close(keep=False):
            made.append(piece)
            yield from full()
        if made:
            yield rows(made)

    return docs.select(*(F.col(f"`{c}`") for c in (key, text))).mapInArrow(work, schema)
