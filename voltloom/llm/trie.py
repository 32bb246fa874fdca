"""The trie of conversation prefixes, measured along its Euler tour.

**Rebuilding.** Rows are put in order by one range shuffle on (conversation,
turn, role and text's digest) and stored with the number of their part; places
inside a conversation, its running keys and everything else that runs over it
are computed in (part, conversation) and carried over part borders by a table
of one row each, so a conversation with a third of all turns lies in many
tasks. Texts are needed for a digest and a word count only.

**Nodes.** A prefix is named by the exclusive or of the 128-bit hashes of (place,
turn digest): it runs along a conversation without a chain. Grouping the
prefixes (combined before the shuffle) gives the nodes. In results and from
there on a node is (its smallest member, its depth), which is unique.

**Euler tour.** Each node has an enter and an exit arc. Enter leads to the
first child's enter, or to the own exit; exit to the next sibling's enter, or
to the parent's exit. The next sibling is found in a range-sorted table, again
with carries, so a node may have any number of children. Ranking the list:
nodes sorted by (smallest member, depth) keep a run of single children in one
block; each block of ``BLOCK`` nodes or so follows the tour inside itself, only
the arcs by which it is entered form the list that ``ranking.list_ranked``
ranks over the cluster, and each block then adds what stands before its entries.
A subtree's leaves and savings are prefix sums at exit minus those at enter.

Defined results: rows without conv_id belong to no conversation and are left
out; equal turns are put in order by their digest, so ties and repeated rows
give the same result on every run; an empty table has no node, not even a
root. ``conv_id - conv_id mod 20`` is taken downwards for negative ids. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voltloom.llm.base import partitions, staged
from voltloom.llm.ranking import BASE, doubled, list_ranked

BLOCK = 1 << 18
#: Ids of one node's ends that travel as one row.
ENDS = 256
SUMS = ["leaves", "saved"]
KEY = ["depth", "k1", "k2"]


def in_parts(df: DataFrame, order: Sequence[Column], parts: int) -> DataFrame:
    """``df`` stored in parts by range of ``order``, each row with its part's number."""
    return staged(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))


def _earlier(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words) of each row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations (conv_id, part, place, digest, words) and (conv_id, n_turns).

    Conversation c starts with the first h turns of the first of its family,
    h = crc32(c) mod ``shared``; its own first h turns go.
    """
    spark = conversations.sparkSession
    # The last term parts rows that are equal in all else; which of them comes first makes no difference.
    # Stored first, since a range shuffle reads its input twice: for the borders and for the rows.
    rows = in_parts(
        staged(turns(conversations).withColumn("tie", F.monotonically_increasing_id())),
        [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")], partitions(spark)).drop("tie")
    pieces = staged(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("h"),
        (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("first_id"))
    firsts = sizes.select(F.col("conv_id").alias("first_id"), F.col("n").alias("first_n"))
    convs = staged(sizes.join(firsts, "first_id", "left").select(
        "conv_id", "first_id", "h", F.least("h", F.coalesce("first_n", F.lit(0))).alias("taken"),
        (F.least("h", F.coalesce("first_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    starts = pieces.select("conv_id", "part", F.coalesce(F.sum("n").over(_earlier(["conv_id"])), F.lit(0)).alias("start"))
    here = Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = staged(rows.withColumn("local", F.row_number().over(here)).join(
        starts.join(convs.drop("n_turns"), "conv_id"), ["part", "conv_id"]).select(
        "conv_id", "part", "h", "taken", (F.col("start") + F.col("local")).alias("at"), "digest", "words"))
    own = placed.where("at > h").select(
        "conv_id", "part", (F.col("at") - F.col("h") + F.col("taken")).alias("place"), "digest", "words")
    heads = placed.where((F.pmod("conv_id", F.lit(family)) == 0) & (F.col("at") < shared)).select(
        F.col("conv_id").alias("first_id"), "at", "digest", "words")
    given = convs.where("taken > 0").select("conv_id", "first_id", "taken").join(heads, "first_id").where("at <= taken")
    given = given.select("conv_id", F.lit(-1).alias("part"), F.col("at").alias("place"), "digest", "words")
    return staged(own.unionByName(given)), convs.select("conv_id", "n_turns")


def prefixes(steps: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words): each rebuilt turn with the key of its prefix and of the one before."""
    hashed = steps.select("conv_id", "part", "place", "words", *(
        F.xxhash64(F.lit(seed), "place", "digest").alias(f"h{seed}") for seed in (1, 2)))
    carried = hashed.groupBy("conv_id", "part").agg(*(F.bit_xor(f"h{s}").alias(f"t{s}") for s in (1, 2))).select(
        "conv_id", "part", *(F.coalesce(F.bit_xor(f"t{s}").over(_earlier(["conv_id"])), F.lit(0)).alias(f"c{s}") for s in (1, 2)))
    here = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    keyed = hashed.withColumns({f"r{s}": F.bit_xor(f"h{s}").over(here) for s in (1, 2)}).join(carried, ["conv_id", "part"])
    return keyed.select(
        "conv_id", F.col("place").cast("long").alias("depth"),
        *(F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"k{s}") for s in (1, 2)),
        *(F.col(f"r{s}").bitwiseXOR(F.col(f"c{s}")).bitwiseXOR(F.col(f"h{s}")).alias(f"p{s}") for s in (1, 2)), "words")


def ends(last: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of (KEY, conv_id): the hash of each node's sorted ids, in bounded memory.

    Ids of a node that lie in one part are put into rows of at most ``ENDS``;
    the last task hashes a node's rows in order, one after the other, because
    the digest of one string is wanted. It never holds more than one batch.
    """
    order = [*KEY, "conv_id"]
    kinds = [T.StructField(c, T.LongType()) for c in KEY]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple[list, int, list[str]]] = []
            for *key, conv_id in zip(*(batch.column(c).to_pylist() for c in order)):
                if made and made[-1][0] == key and len(made[-1][2]) < ENDS:
                    made[-1][2].append(str(conv_id))
                else:
                    made.append((key, conv_id, [str(conv_id)]))
            if made:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([m[0][i] for m in made]) for i in range(3)), pa.array([m[1] for m in made]),
                     pa.array([",".join(m[2]) for m in made])], [*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            done = []
            for *this, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if this != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, digest.hexdigest())], [*KEY, "ends_sha256"])

    n = partitions(last.sparkSession)
    rows = last.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        grouped, T.StructType([*kinds, T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())]))
    return rows.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        hashed, T.StructType([*kinds, T.StructField("ends_sha256", T.StringType())]))


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, words, ends_sha256): all nodes of the trie."""
    steps, convs = rebuilt(conversations)
    met = staged(prefixes(steps))
    inner = met.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
        *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    found = staged(inner.unionByName(root))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         F.col("conv_id").alias("parent_conv_id"))
    linked = found.join(above, ["depth", "p1", "p2"], "left")
    lengths = convs.select("conv_id", F.col("n_turns").alias("depth"))
    last = met.join(lengths, ["conv_id", "depth"]).select(*KEY, "conv_id").unionByName(
        convs.where("n_turns = 0").select(*(F.lit(0).cast("long").alias(c) for c in KEY), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return staged(linked.join(ends(last), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "words", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))


def toured(found: DataFrame) -> DataFrame:
    """The nodes with the next sibling's, the first child's smallest member, and n_children."""
    order = ["parent_conv_id", "depth", "conv_id"]
    rows = in_parts(found, [F.col(c) for c in order], partitions(found.sparkSession))
    family = ["parent_conv_id", "depth"]
    runs = rows.groupBy("part", *family).agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = staged(runs.withColumn("over", F.lead("first").over(Window.partitionBy(*family).orderBy("part"))))
    here = Window.partitionBy("part", *family).orderBy("conv_id")
    met = rows.withColumn("following", F.lead("conv_id").over(here)).join(
        runs.select(*(F.col(c).alias(f"_{c}") for c in ("part", *family)), "over"),
        (F.col("part") == F.col("_part")) & F.col("parent_conv_id").eqNullSafe(F.col("_parent_conv_id"))
        & (F.col("depth") == F.col("_depth")))
    children = runs.where("parent_conv_id IS NOT NULL").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.min("first").alias("child"), F.sum("n").alias("n_children"))
    return met.select(*found.columns, F.coalesce("following", "over").alias("sibling")).join(
        children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


class Block:
    """The arcs of one block's nodes, with what can be followed inside it.

    Arc 2 i enters node i, arc 2 i + 1 leaves it; nodes are sorted by (conv_id,
    depth), and a conv_id's depths lie next to each other.
    """

    def __init__(self, table: pa.Table) -> None:
        self.table = table = table.sort_by([("conv_id", "ascending"), ("depth", "ascending")])
        conv, depth = self.conv, self.depth = [table.column(c).to_numpy() for c in ("conv_id", "depth")]
        self.ids, self.first, self.count = np.unique(conv, return_index=True, return_counts=True)
        self.low = depth[self.first]
        n = len(conv)
        links = {c: table.column(c) for c in ("child", "sibling", "parent_conv_id")}
        child, sibling, parent = (c.is_valid().to_numpy() for c in links.values())
        known = {c: v.fill_null(0).to_numpy() for c, v in links.items()}
        # Where each arc leads: conversation, depth, 0 to enter or 1 to leave.
        to = np.zeros((2 * n, 3), np.int64)
        to[0::2] = np.where(child[:, None], np.stack([known["child"], depth + 1, 0 * depth], 1),
                            np.stack([conv, depth, 0 * depth + 1], 1))
        to[1::2] = np.where(sibling[:, None], np.stack([known["sibling"], depth, 0 * depth], 1),
                            np.stack([known["parent_conv_id"], depth - 1, 0 * depth + 1], 1))
        self.to = to
        self.over = np.zeros(2 * n, bool)
        self.over[1::2] = ~sibling & ~parent  # the tour's last arc
        self.succ = np.where(self.over, -1, self.arc(to))
        self.weights = np.zeros((2 * n, 2), np.int64)
        self.weights[0::2, 0] = table.column("n_children").to_numpy() == 0
        self.weights[0::2, 1] = (table.column("n_convs").to_numpy() - 1) * table.column("words").to_numpy()
        self.last, self.behind = doubled(self.succ, self.weights)
        entered = np.ones(2 * n, bool)
        entered[self.succ[self.succ >= 0]] = False
        self.entries = np.flatnonzero(entered)

    def arc(self, at: np.ndarray) -> np.ndarray:
        """The number of the arc (conversation, depth, kind) in this block, else -1."""
        found = np.minimum(np.searchsorted(self.ids, at[:, 0]), len(self.ids) - 1)
        down = at[:, 1] - self.low[found]
        inside = (self.ids[found] == at[:, 0]) & (down >= 0) & (down < self.count[found])
        return np.where(inside, 2 * (self.first[found] + down) + at[:, 2], -1)


def measured(tree: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """``tree`` (of ``toured``) with n_leaves and saved_tokens, by ranking its Euler tour."""
    spark = tree.sparkSession
    tree = staged(tree)
    parts = max(partitions(spark), -(-tree.count() // block))
    rows = in_parts(tree, [F.col("conv_id"), F.col("depth")], parts)
    arc, to = ["conv_id", "depth", "leaving"], ["to_conv_id", "to_depth", "to_leaving"]
    long = T.LongType()
    entry = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, long) for c in (*arc, *to, *SUMS))])

    def contracted(table: pa.Table) -> pa.Table:
        b = Block(table)
        at, last = b.entries, b.last[b.entries]
        total = b.behind[at] + b.weights[last]
        part = pa.array(np.full(len(at), table.column("part")[0].as_py(), np.int32))
        columns = [b.conv[at // 2], b.depth[at // 2], at % 2, *(pa.array(b.to[last, i], mask=b.over[last]) for i in range(3)), *total.T]
        return pa.table([part, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], schema=to_arrow_schema(entry))

    # Entries get numbers: a part's entries follow those of the parts before it.
    found = staged(rows.groupBy("part").applyInArrow(contracted, entry))
    sizes = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    numbered = staged(found.join(F.broadcast(starts), "part").withColumn(
        "name", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(*arc))).drop("start"))
    names = numbered.select(*(F.col(a).alias(t) for a, t in zip(arc, to)), F.col("name").alias("following"))
    listed = staged(numbered.join(names, to, "left").select("name", "following", *SUMS))
    before = list_ranked(listed, SUMS, base)
    brought = numbered.select("part", *arc, "name").join(before, "name").drop("name")
    columns = tree.columns
    result = T.StructType([*tree.schema.fields, T.StructField("n_leaves", long), T.StructField("saved_tokens", long)])

    def expanded(table: pa.Table, entries: pa.Table) -> pa.Table:
        b = Block(table)
        at = b.arc(np.stack([entries.column(c).to_numpy() for c in arc], 1))
        # A chain has one entry; sums before an arc are those before the chain's last arc minus those behind the arc.
        of_chain = np.zeros((len(b.last), 2), np.int64)
        of_chain[b.last[at]] = np.stack([entries.column(s).to_numpy() for s in SUMS], 1) + b.behind[at]
        before = of_chain[b.last] - b.behind
        inside = before[1::2] - before[0::2]
        kept = [b.table.column(c) for c in columns]
        return pa.table([*kept, *map(pa.array, inside.T)], schema=to_arrow_schema(result))

    return rows.groupBy("part").cogroup(brought.groupBy("part")).applyInArrow(expanded, result)


def prefix_trie(conversations: DataFrame, block: int = BLOCK, base: int = BASE) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return measured(toured(nodes(conversations)), block, base).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
