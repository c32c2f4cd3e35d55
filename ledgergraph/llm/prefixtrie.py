"""Trie of conversation prefixes, its subtree totals by time-forward processing.

**Turns in order.**  A conversation may hold any share of all rows, so its turns
are numbered without gathering it: rows are range-sorted by (conversation, turn,
...), each task runs over its sorted rows once, and a table of one row per
partition and open conversation supplies what earlier partitions hold
(``running``).  Texts are hashed where they lie; only turns that tie within
their conversation carry their text to be ordered by it.

**Nodes.**  A prefix is named by 128 bits: the XOR of hashes of (depth, role,
text) of its turns, again a running value.  A node's members are counted by one
grouped aggregate, combined before its shuffle, however common the prefix.

**Totals.**  Nodes with one member need none (one leaf, nothing saved): they are
final at once and the top one of each such tail sends its parent one message.
The others are sharded by subtree: nodes with more than C = max(``shard_convs``,
rows / ``TOP_NODES``) members are the trie's top (fewer than ``TOP_NODES`` by
that choice); each subtree below is a shard's own.  In a shard, nodes are sorted
externally by reverse level order (Spark's sort, which spills); one pass reads
them, and totals wait for their parent in a priority queue in the same order,
which spills sorted runs to disk beyond ``QUEUE`` messages.  Shard roots' totals
are summed per parent and the same pass runs across the top.

**Ends.**  Ids that end in a node are joined in ascending order in blocks of rows,
and the blocks are hashed in order by one stream, as SHA-256 asks.

Defined cases: null role or text count as empty; turns are ordered by (turn,
role, text), null turn first, so ties and repeated rows have one order and all
stay; rows without conv_id belong to no conversation; texts may be of any
length; an empty table gives an empty result (a root would have no member);
extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small

#: Members of a subtree that is a shard's own, at least; nodes of the top, at most; messages held before a spill;
#: rows of a block of ended conversations.
SHARD_CONVS, TOP_NODES, QUEUE, END_ROWS = 2000, 100_000, 1_000_000, 4096
_KEY = ["k1", "k2"]


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    """Rows in order over range partitions, written: the partitions stay what they are when read again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
               .withColumn("row_no", F.monotonically_increasing_id()))


def _runs(pdf: pd.DataFrame, by: str) -> np.ndarray:
    """Number of the run of equal values that each row is in."""
    c = pdf[by].to_numpy()
    return np.concatenate(([0], np.cumsum(c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)


def running(rows: DataFrame, by: str, add: list[str], xor: list[str]) -> DataFrame:
    """Running sums of ``add`` and running XORs of ``xor`` (in their place) over each value of ``by``, in row order.

    ``rows`` come from ``_sorted``.  A task runs over its own rows; what a value holds in earlier partitions is one row
    per partition that begins within it, summed up from each partition's last value (a table as long as there are
    partitions).
    """
    names = rows.columns
    schema = rows.schema

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {c: 0 for c in add + xor}
        for pdf in batches:
            if not len(pdf):
                continue
            run = _runs(pdf, by)
            first = np.flatnonzero(np.diff(run, prepend=-1))
            goes_on = last is not None and pdf[by].iloc[0] == last
            for c in add + xor:
                v = pdf[c].to_numpy(np.int64).copy()
                if goes_on:
                    v[0] = v[0] + held[c] if c in add else v[0] ^ held[c]
                if c in add:
                    s = np.cumsum(v)
                    v = s - np.repeat((s[first] - v[first]), np.diff(np.append(first, len(v))))
                else:
                    s = np.bitwise_xor.accumulate(v)
                    v = s ^ np.repeat(s[first] ^ v[first], np.diff(np.append(first, len(v))))
                pdf[c] = v
                held[c] = int(v[-1])
            last = pdf[by].iloc[-1]
            yield pdf[names]

    done = cut(rows.mapInPandas(pass_over, schema)).withColumn("part", F.shiftright("row_no", 33))
    # the last row of each partition: its value goes on where the next partition begins with the same one
    tail = done.groupBy("part").agg(F.max_by(F.struct(by, *add, *xor), "row_no").alias("t"),
                                    F.min(by).alias("head")).select("part", "head", "t.*").toPandas()
    tail = tail.sort_values("part")  # as many rows as partitions
    carry, value, held = [], None, {}
    for r in tail.to_dict("records"):
        if value is not None and r["head"] == value:
            carry.append((int(r["part"]), int(r["head"]), *[held[c] for c in add + xor]))
            if r[by] == value:  # the whole partition is one value
                held = {c: held[c] + int(r[c]) if c in add else held[c] ^ int(r[c]) for c in add + xor}
                continue
        value, held = r[by], {c: int(r[c]) for c in add + xor}
    if not carry:
        return done.select(*names)
    more = done.sparkSession.createDataFrame(carry, "part bigint, value bigint, " + ", ".join(
        f"c{i} bigint" for i in range(len(add + xor))))
    j = done.join(F.broadcast(more), (done["part"] == more["part"]) & (done[by] == more["value"]), "left")
    old = {c: F.coalesce(F.col(f"c{i}"), F.lit(0).cast("long")) for i, c in enumerate(add + xor)}
    return j.select(*[(done[c] + old[c]).alias(c) if c in add else done[c].bitwiseXOR(old[c]).alias(c) if c in xor
                      else done[c] for c in names])


def turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, words): pos counts a conversation's turns from 1; t1, t2 hash role and text."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), said.alias("text")) \
        .filter("conv_id IS NOT NULL")
    tied = cut(rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    tied = small(tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("u")))
    rows = rows.join(tied, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("u")), "left")
    rows = rows.select(
        "conv_id", "turn", "role", F.when(F.col("c").isNotNull(), F.col("text")).alias("order_text"),
        F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit("second"), "role").alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("pos"))
    placed = _sorted(rows, "conv_id", "turn", "role", "order_text")
    return running(placed.select("conv_id", "t1", "t2", "words", "pos", "row_no"), "conv_id", ["pos"], [])


def shared_head(conv: Column) -> Column:
    """How many turns a conversation takes from its group's first conversation."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))


def rebuilt(ts: DataFrame, group: int = 20) -> DataFrame:
    """(conv_id, depth, t1, t2, words) of the rebuilt conversations, with a row of depth 0 for each.

    Conversation c takes the first h turns of conversation c - c % group, then its own turns after its first h.
    """
    convs = cut(ts.groupBy("conv_id").agg(F.max("pos").alias("n"))).select(
        "conv_id", "n", shared_head(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = ts.filter((F.col("conv_id") % group == 0) & (F.col("pos") <= 3)).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("head"))  # three turns at most
    whole = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = whole.select("conv_id", F.explode(F.filter("head", lambda x: x["pos"] <= F.col("h"))).alias("x"))
    taken = taken.select("conv_id", F.col("x.pos").alias("depth"), "x.t1", "x.t2", "x.words")
    short = whole.select("conv_id", "h", F.least(F.coalesce(F.size("head"), F.lit(0)), F.col("h").cast("int")).alias("k")) \
        .select("conv_id", (F.col("h") - F.when(F.col("k") < 0, 0).otherwise(F.col("k"))).cast("long").alias("lack")) \
        .filter("lack > 0")  # of a first conversation with fewer turns, or none
    own = ts.filter(F.col("pos") > shared_head(F.col("conv_id"))).join(small(cut(short)), "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("lack", F.lit(0))).alias("depth"), "t1", "t2", "words")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    return root.unionByName(taken).unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, row_no): each row's prefix and its parent's, as 128-bit names."""
    own = [F.when(F.col("depth") > 0, F.xxhash64("depth", "t1", "t2")).otherwise(F.lit(0).cast("long")),
           F.when(F.col("depth") > 0, F.xxhash64("t2", "t1", "depth", F.lit("second"))).otherwise(F.lit(0).cast("long"))]
    placed = _sorted(rows.select("conv_id", "depth", "words", own[0].alias("g1"), own[1].alias("g2")), "conv_id", "depth")
    out = running(placed.withColumns({"k1": F.col("g1"), "k2": F.col("g2")}), "conv_id", [], _KEY)
    return out.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"),
                      F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"), "words", "row_no")


class SpillingQueue:
    """Messages in ascending order of their key; beyond ``most`` the held ones go to disk as a sorted run."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.spills = most, [], [], 0

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        file.seek(0)
        try:
            while True:
                yield from pickle.load(file)
        except EOFError:
            file.close()  # an unnamed file: it is gone

    def push(self, key: tuple, values: tuple) -> None:
        heapq.heappush(self.heap, (key, values))
        if len(self.heap) > self.most:
            file = tempfile.TemporaryFile()
            self.heap.sort()
            for a in range(0, len(self.heap), 4096):
                pickle.dump(self.heap[a:a + 4096], file, pickle.HIGHEST_PROTOCOL)
            self.heap, self.spills = [], self.spills + 1
            run = self._read(file)
            first = next(run)
            heapq.heappush(self.runs, (first, self.spills, run))

    def pop_all(self, key: tuple) -> Iterator[tuple]:
        """The values sent to ``key``, which is not after any key that is still held."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1]
        while self.runs and self.runs[0][0][0] == key:
            (_, values), no, run = self.runs[0]
            yield values
            nxt = next(run, None)
            if nxt is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (nxt, no, run))


_TOTALS = ["n_children", "n_leaves", "saved"]


def time_forward(nodes: DataFrame, queue: int = QUEUE) -> DataFrame:
    """Totals of every node: one pass over each shard's nodes in reverse level order, totals sent on to the parent.

    ``nodes``: shard (s1, s2), depth, node (k1, k2), parent (p1, p2), own (what the node itself saves), and the sums
    ``n_children, n_leaves, saved`` of messages from outside the shard.  Adds the totals; ``is_root`` marks the shards'
    roots, whose parents are elsewhere.
    """
    shard = ["s1", "s2"]
    ordered = nodes.repartition(*shard).sortWithinPartitions(*shard, F.col("depth").desc(), *_KEY)
    names = nodes.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, now = SpillingQueue(queue), None
        for pdf in batches:
            cols = [pdf[c].tolist() for c in ("s1", "s2", "depth", "k1", "k2", "p1", "p2", "own", *_TOTALS)]
            out = []
            for s1, s2, d, k1, k2, p1, p2, own, children, leaves, saved in zip(*cols):
                if (s1, s2) != now:
                    now, waiting = (s1, s2), SpillingQueue(queue)
                for x, y in waiting.pop_all((-d, k1, k2)):
                    children, leaves, saved = children + 1, leaves + x, saved + y
                leaves, saved = leaves if children else 1, saved + own
                out.append((children, leaves, saved))
                if (k1, k2) != now:
                    waiting.push((1 - d, p1, p2), (leaves, saved))
            for c, v in zip(_TOTALS, zip(*out) if out else ((), (), ())):
                pdf[c] = np.array(v, np.int64)
            yield pdf[names]
    return ordered.mapInPandas(run, nodes.schema)


def _sent(nodes: DataFrame) -> DataFrame:
    """Messages summed per parent (combined before the shuffle, so a common parent is no hot key)."""
    return nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("m_children"), F.sum("n_leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))


def _receive(nodes: DataFrame, sent: DataFrame) -> DataFrame:
    got = nodes.join(sent, _KEY, "left")
    return got.select(*[c for c in nodes.columns if c not in _TOTALS],
                      *[(F.col(t) + F.coalesce(m, F.lit(0))).cast("long").alias(t)
                        for t, m in zip(_TOTALS, ("m_children", "m_leaves", "m_saved"))])


def ends_digest(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of nodes where conversations end; rows of ``prefixes`` that are their conversation's last."""
    ends = rows.withColumn("block", F.floor(F.col("row_no") / END_ROWS))  # rows are numbered by ascending conversation
    chunks = ends.groupBy(*_KEY, "block").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            out = []
            for k1, k2, ids in zip(pdf["k1"].tolist(), pdf["k2"].tolist(), pdf["ids"]):
                if (k1, k2) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if key:
            yield pd.DataFrame({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [sha.hexdigest()]})
    return chunks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block").mapInPandas(
        run, "k1 bigint, k2 bigint, ends_sha256 string")


def trie(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         group: int = 20, shard_convs: int = SHARD_CONVS, queue: int = QUEUE) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations, with its subtree's totals."""
    rows = cut(prefixes(rebuilt(turns(df, conv_id, turn, role, text), group)))
    length = rows.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("p1").alias("p1"),
                                    F.first("p2").alias("p2"), F.first("words").alias("words"),
                                    F.count(F.lit(1)).alias("n_convs"))
    nodes = cut(nodes)
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    most = max(shard_convs, -(-total // TOP_NODES))

    # tails of one member: final, and one message a tail
    alone = nodes.filter("n_convs = 1")
    tail = alone.groupBy("conv_id").agg(F.min_by(F.struct("p1", "p2"), "depth").alias("p"), F.max("depth").alias("bottom"))
    tail = cut(tail)
    one = F.lit(1).cast("long")
    from_tails = _sent(tail.select("p.*", one.alias("n_leaves"), zero.alias("saved")))
    alone = alone.join(tail.select("conv_id", "bottom"), "conv_id").select(
        *nodes.columns, F.when(F.col("depth") < F.col("bottom"), one).otherwise(zero).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved"))

    shared = nodes.filter("n_convs > 1").withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    shared = cut(_receive(shared.withColumns({t: zero for t in _TOTALS}), from_tails))
    # a subtree's root is its conversations' first node that is not of the top
    top = shared.filter(F.col("n_convs") > most)
    above = rows.join(small(top.select(*_KEY)), _KEY).groupBy("conv_id").agg(F.max("depth").alias("above"))
    below = shared.filter(F.col("n_convs") <= most)
    roots = rows.join(above, "conv_id", "left").filter(F.col("depth") == F.coalesce(F.col("above") + 1, F.lit(0))).select(
        "conv_id", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    below = below.join(roots, "conv_id").select(*below.columns, "s1", "s2")
    within = cut(time_forward(below, queue))
    is_root = (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))
    top = _receive(top, _sent(within.filter(is_root & (F.col("depth") > 0))))
    across = time_forward(top.withColumns({"s1": zero, "s2": zero}), queue)  # the trie's root is named 0, 0
    out = ["conv_id", "depth", *_KEY, "p1", "p2", "n_convs", *_TOTALS]
    every = alone.select(*out).unionByName(within.select(*out)).unionByName(across.select(*out))

    # a prefix's parent: the same conversation's, or its smallest member's where that is another
    names = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    every = cut(every)
    first = every.groupBy("conv_id").agg(F.min("depth").alias("first_depth"))
    crossing = every.join(first, "conv_id").filter((F.col("depth") == F.col("first_depth")) & (F.col("depth") > 0)) \
        .join(names, ["p1", "p2"]).select(*_KEY, "parent_conv_id")
    last = rows.join(length, ["conv_id", "depth"])
    out = every.join(crossing, _KEY, "left").join(ends_digest(last), _KEY, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
