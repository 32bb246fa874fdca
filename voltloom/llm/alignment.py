"""How two tokenizers cut the same texts, by exact-text deduplication.

Documents are shuffled by their full text, equal ones meeting before the
shuffle already (map-side combine), so each distinct text is encoded and
aligned once, with the number of its copies. An id pair counts once for each
copy of each link that holds it. Measures go back to all documents by the
text's SHA-256; the join's document side may be split at a hot text (adaptive
skew join), the other side has one row for each distinct text.

Tokens that end together end with the same bytes, so the string of one is the
end of the other: the pairs that can occur at all are listed from the two
vocabulary files (``possible``: a few hundred thousand, at most the summed
lengths of all entries), whatever the corpus. Links travel as places in that
list, counts are summed by place in Spark, and only this table, bounded by the
vocabularies, is broadcast to score the links.

Defined results: null and empty texts, and those whose tokens do not spell a
space and the text (such as texts with the mark that stands for a space), get
zeros and an empty ``groups``; every row of the input has a row in the result,
repeated rows and null ids included; an empty table gives an empty one; extra
columns pass through, and one with the name of an output is replaced.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltloom.llm.base import staged
from voltloom.llm.bpe import spans
from voltloom.llm.tokens import File, joined, spells

#: Texts whose links are held at one time.
ROWS = 64

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def possible(a: Sequence[bytes], b: Sequence[bytes]) -> np.ndarray:
    """All (A id) * len(b) + (B id) of which one string is the end of the other, ascending."""
    ids_of: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for ids, strings in zip(ids_of, (a, b)):
        for i, s in enumerate(strings):
            if s:
                ids[s].append(i)
    pairs: set[int] = set()
    for s, mine in ids_of[0].items():
        for cut in range(len(s)):
            pairs.update(i * len(b) + j for j in ids_of[1].get(s[cut:], ()) for i in mine)
    for s, mine in ids_of[1].items():
        for cut in range(1, len(s)):
            pairs.update(i * len(b) + j for i in ids_of[0].get(s[cut:], ()) for j in mine)
    return np.array(sorted(pairs), np.int64)


class Aligner:
    """Cuts a text with both vocabularies and lays the cuts over each other."""

    def __init__(self, a, b, pairs: np.ndarray) -> None:
        self.a, self.b, self.pairs = a, b, pairs
        self.marks = spans([b"%d%c" % (i, c) for n, other in ((len(a.strings), 124), (len(b.strings), 59))
                            for i in range(n) for c in (44, other)])

    def align(self, text: str) -> tuple[int, int, np.ndarray, np.ndarray] | None:
        """Tokens of A and of B, the links' places in the list of pairs, and the marks of the groups' text."""
        raw = b" " + text.encode()
        a, b = self.a.encode(" " + text, special=False), self.b.encode(text)
        if not (spells(self.a.table, a, raw) and spells(self.b.table, b, raw)):
            return None
        ends = [np.cumsum(t.table[2][ids]) for t, ids in ((self.a, a), (self.b, b))]
        there = np.zeros((2, len(raw) + 1), bool)
        there[0, ends[0]] = there[1, ends[1]] = True
        last_a, last_b = there[1, ends[0]], there[0, ends[1]]
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        links = np.searchsorted(self.pairs, a[at_a].astype(np.int64) * len(self.b.strings) + b[at_b])
        # A token's place in the groups' text: the tokens of its own kind before it, and the others of earlier groups.
        before_a = np.concatenate([[0], at_b + 1])[np.cumsum(last_a) - last_a]
        before_b = (at_a + 1)[np.cumsum(last_b) - last_b]
        marks = np.empty(len(a) + len(b), np.int32)
        marks[np.arange(len(a)) + before_a] = 2 * a + last_a
        marks[np.arange(len(b)) + before_b] = 2 * (len(self.a.strings) + b) + last_b
        return len(a), len(b), links.astype(np.int32), marks

    def groups(self, marks: np.ndarray) -> Iterator[bytes]:
        """`a1,a2|b1;a3|b2,b3`, some at a time."""
        held = b""
        for part in joined(self.marks, marks):
            yield held
            held = part
        yield held[:-1]


def aligned(texts: DataFrame, a: File, b: File, pairs, wanted: Sequence[str]) -> DataFrame:
    """Each row's (key, copies, n_a, n_b, links) and the wanted ones of groups, groups_sha256."""
    schema = T.StructType([
        T.StructField("key", T.BinaryType()), T.StructField("copies", T.LongType()),
        T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
        T.StructField("links", T.ArrayType(T.IntegerType())), *(T.StructField(w, T.StringType()) for w in wanted)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a.bytes(), b.pieces(), pairs.value)
        for batch in batches:
            keys, copies, column = (batch.column(batch.schema.names.index(n)) for n in ("key", "copies", "text"))
            for start in range(0, batch.num_rows, ROWS):
                end = start + ROWS
                counts, links, found = [], [], {w: [] for w in wanted}
                for value in column[start:end]:
                    got = aligner.align(value.as_py())
                    counts.append(got[:2] if got else (0, 0))
                    links.append(got[2] if got else np.zeros(0, np.int32))
                    if "groups" in found:
                        found["groups"].append(b"".join(aligner.groups(got[3])).decode() if got else "")
                    if "groups_sha256" in found:
                        digest = hashlib.sha256()
                        for part in aligner.groups(got[3]) if got else ():
                            digest.update(part)
                        found["groups_sha256"].append(digest.hexdigest() if got else "")
                n = np.array(counts, np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, links)]), pa.int32()), pa.array(np.concatenate(links)))
                yield pa.RecordBatch.from_arrays(
                    [keys[start:end].cast(pa.binary()), copies[start:end], pa.array(n[:, 0]), pa.array(n[:, 1]), lists,
                     *(pa.array(found[w], pa.string()) for w in wanted)],
                    ["key", "copies", "n_a", "n_b", "links", *wanted])

    return texts.mapInArrow(work, schema)


def pair_counts(links: DataFrame, size: int) -> np.ndarray:
    """How many links hold each possible pair; summed in Spark, one row at most for each of the ``size`` pairs."""
    rows = links.select(F.explode("links").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("n"))
    found = rows.toArrow()
    counts = np.zeros(size, np.int64)
    counts[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return counts


def scored(links: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """n_groups, n_links, n_best and count_sum instead of ``links``."""
    shared = links.sparkSession.sparkContext.broadcast((counts, best))
    kept = [f for f in links.schema.fields if f.name not in ("links", "copies")]
    new = ("n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in new)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, top = shared.value
        for batch in batches:
            lists = batch.column(batch.schema.names.index("links"))
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            n = np.diff(ends, prepend=0)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends], prepend=0)
                    for v in (top[flat].astype(np.int64), count[flat])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(f.name)) for f in kept),
                 *(pa.array(v, pa.int64()) for v in (n, n, *sums))], [*(f.name for f in kept), *new])

    return links.mapInArrow(work, schema)


def align(docs: DataFrame, vocabulary: str, pieces: str, text: str = "text",
          outputs: Sequence[str] = ("groups",)) -> DataFrame:
    """``docs`` with ``MEASURES`` and the wanted ones of ``groups`` and ``groups_sha256``.

    ``vocabulary`` (A) is a byte-level BPE file, ``pieces`` (B) a piece model;
    both are read on the driver. Each group has one link: the tokens that end
    it, since no token that spells text is empty.
    """
    spark, wanted = docs.sparkSession, list(outputs)
    key = F.unhex(F.sha2(F.col("text"), 256))
    texts = docs.select(F.col(f"`{text}`").alias("text")).where("text <> ''").groupBy("text").agg(
        F.count(F.lit(1)).alias("copies")).withColumn("key", key)
    a, b = File(spark, vocabulary), File(spark, pieces)
    strings = a.bytes().strings, b.pieces().strings
    pairs = possible(*strings)
    links = staged(aligned(texts, a, b, spark.sparkContext.broadcast(pairs), wanted))
    counts = pair_counts(links, len(pairs))
    highest = np.zeros(len(strings[1]), np.int64)
    np.maximum.at(highest, pairs % len(highest), counts)
    measured = scored(links, counts, counts == highest[pairs % len(highest)])
    new = [*MEASURES, *wanted]
    left = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in new)).withColumn(
        "_al_key", F.unhex(F.sha2(F.col(f"`{text}`"), 256)))
    right = measured.select(F.col("key").alias("_al_right"), *(F.col(c).alias(f"_al_{c}") for c in new))
    return left.join(right, F.col("_al_key") == F.col("_al_right"), "left").select(
        *(F.col(f"`{c}`") for c in left.columns if c != "_al_key"),
        *(F.coalesce(f"_al_{c}", F.lit(0 if c in MEASURES else "")).alias(c) for c in new))
