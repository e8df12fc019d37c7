"""The trie of conversation prefixes, and totals of its subtrees by time-forward processing.

A node is a distinct sequence of first turns. Turns are known by 128 bits of hashes, a
sequence by the exclusive or of its turns' hashes with their places, so sequences are
running sums of rows: no conversation is ever one row or one task's work. Nodes are groups
of equal (depth, sequence); a node is named by its smallest member and its depth.

Totals of subtrees go from the leaves to the root:

1. Nodes are dealt to shards by ranges of (smallest member, depth), and each shard sorts its
   own in reverse level order. Going through them, a task takes what a node's children have
   sent out of a priority queue, adds the node's own part, and sends the sum to its parent. A
   queue that outgrows memory goes on in sorted runs on disk.
2. What is sent to parents in other shards are the totals of shard roots. Shard roots of one
   shard with one parent are a single vertex of a much smaller tree; its totals are passed up
   in rounds that double the reach, as many as the logarithm of its depth.
3. The totals that arrive at a node from other shards join its shard's rows, and the shard is
   gone through once more; now all sums are whole.

Edge cases: null role or text is empty; rows without a conv_id are no conversation's; turns
of the same number (or none) go in order of their hashes, repeated rows are turns of their
own; a turnless conversation is a member of the root alone; an empty table has no root and
gives no rows; other columns go.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import struct
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, rows_of

#: Turns shared with the group's first conversation are fewer than this; conversations a group.
HEAD, GROUP = 9, 5
#: Entries that a priority queue holds in memory.
QUEUE = 200_000
PART = "_part"
_ENTRY = struct.Struct("<qqqq")


class SpillingQueue:
    """Entries (key, key, value, value) out in ascending order of the keys, beyond `most` in sorted runs on disk.

    Runs are unnamed files of the task's own, gone with it; no one else reads them.
    """

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.spills = most, [], [], 0

    def put(self, entry: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            # half of them, the last ones, so that what is due soon stays in memory
            entries = sorted(self.heap)
            self.heap, late = entries[: self.most // 2], entries[self.most // 2 :]
            for at in range(0, len(late), 4096):
                run.write(b"".join(_ENTRY.pack(*x) for x in late[at : at + 4096]))
            run.seek(0)
            self.spills += 1
            entries = self._read(run)
            heapq.heappush(self.runs, (next(entries), self.spills, entries))

    @staticmethod
    def _read(run) -> Iterator[tuple[int, int, int, int]]:
        while data := run.read(_ENTRY.size * 4096):
            yield from _ENTRY.iter_unpack(data)
        run.close()

    def least(self) -> tuple[int, int, int, int] | None:
        heads = [h for h in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if h is not None]
        return min(heads, default=None)

    def pop(self) -> tuple[int, int, int, int]:
        if self.runs and (not self.heap or self.runs[0][0] <= self.heap[0]):
            entry, tie, run = self.runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, tie, run))
            return entry
        return heapq.heappop(self.heap)

    def upto(self, key: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
        """All entries of keys up to this one."""
        while (entry := self.least()) is not None and entry[:2] <= key:
            yield self.pop()


def _matched(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(small, on, "left")


def _placed(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows dealt by ranges of a key and an order within it, with their part; kept."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartitionByRange(parts, key, *order).withColumn(PART, F.spark_partition_id()))


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation shares: its id's crc32 modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, t1, t2, size, last) of rebuilt conversations, and (conv_id, length) of all of them."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(17), text, role, F.lit(1)).alias("t2"), F.octet_length(text).cast("long").alias("size"))
    order = (F.asc_nulls_first("turn"), F.asc("t1"), F.asc("t2"))
    rows = _placed(turns, "conv_id", *order)
    per = rows.groupBy("conv_id", PART).agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    own = per.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", base.alias("base"), shared_turns(F.col("conv_id")).alias("h"))
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = _matched(own, first, ["base"]).withColumn("used", F.least("h", F.coalesce("base_n", F.lit(0))))
    own = keep(own.select("conv_id", "base", "h", "used", (F.col("used") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    # those that begin with a conversation's turns: the group's few
    followers = own.groupBy("base").agg(F.collect_list(F.struct("conv_id", "h", "length")).alias("followers")).withColumnRenamed("base", "conv_id")
    per = _matched(_matched(per.drop("n"), own.select("conv_id", "h", "used", "length"), ["conv_id"]), followers, ["conv_id"])
    local = Window.partitionBy("conv_id", PART).orderBy(*order)
    rows = _matched(rows.withColumn("place", F.row_number().over(local)), per, ["conv_id", PART]).withColumn("place", F.col("place") + F.col("before"))
    depth = F.col("place") - F.col("h") + F.col("used")
    tail = F.array(F.struct("conv_id", depth.alias("depth"), (depth == F.col("length")).alias("last")))
    heads = F.transform(F.filter(F.coalesce("followers", F.array()), lambda f: f["h"] >= F.col("place")), lambda f: F.struct(f["conv_id"], F.col("place").alias("depth"), (F.col("place") == f["length"]).alias("last")))
    out = rows.select("t1", "t2", "size", F.explode(F.concat(F.when(F.col("place") > F.col("h"), tail).otherwise(F.array()), heads)).alias("r")).select("r.*", "t1", "t2", "size")
    return out, own.select("conv_id", "length")


def nodes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, saved, ends_sha256) of all nodes, each without its subtree."""
    turns, convs = rebuilt(conversations)
    rows = _placed(turns.withColumns({"x1": F.xxhash64("depth", "t1", "t2"), "x2": F.xxhash64("t2", "t1", "depth")}).drop("t1", "t2"), "conv_id", F.col("depth"))
    per = rows.groupBy("conv_id", PART).agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    before = Window.partitionBy("conv_id").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("conv_id", PART, *(F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(b) for b in ("b1", "b2")))
    local = Window.partitionBy("conv_id", PART).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = _matched(rows.withColumns({f"s{i}": F.bit_xor(f"x{i}").over(local) for i in (1, 2)}), per, ["conv_id", PART])
    rows = rows.withColumns({f"s{i}": F.col(f"s{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "s1", "s2", *(F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)), "size", "last")
    zero = F.lit(0).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("s1"), zero.alias("s2"), zero.alias("p1"), zero.alias("p2"), zero.alias("size"), (F.col("length") == 0).alias("last"))
    rows = keep(rows.unionByName(root))
    key = ["depth", "s1", "s2"]
    own = keep(rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("size").alias("size")))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")]
    kids = own.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    ends = digests(rows.where("last").select(*key, "conv_id"), key)
    named = own.withColumns({"n_children": F.lit(None).cast("long"), "ends_sha256": F.lit(None).cast("string")})
    blank = lambda df: df.select(*key, *(F.col(c) if c in df.columns else F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns if c not in key))
    one = lambda c: F.max(c).alias(c)
    own = blank(named).unionByName(blank(kids)).unionByName(blank(ends)).groupBy(*key).agg(*(one(c) for c in named.columns if c not in key))
    own = keep(own.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())), "saved": (F.col("n_convs") - 1) * F.col("size")}))
    # parents with more than a thousandth of all nodes below them are fewer than a thousand
    many = F.col("n_children") * 1000 > own.count()
    of = own.where("n_children > 0").select(*(F.col(k).alias(f"_{k}") for k in key), F.col("conv_id").alias("parent_conv_id"), many.alias("_many"))
    match = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_s1")) & (F.col("p2") == F.col("_s2"))
    known = own.join(F.broadcast(of.where("_many")), match, "left")
    rare = known.where("_many IS NULL AND depth > 0").select(*own.columns).join(of.where("NOT _many"), match, "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "saved", "ends_sha256"]
    return known.where("_many OR depth = 0").select(*columns).unionByName(rare.select(*columns))


def digests(rows: DataFrame, key: list[str], value: str = "conv_id") -> DataFrame:
    """(key, ends_sha256): the hash of each key's values in ascending order, comma-joined.

    Values are sorted by ranges of (key, value); tasks join them to pieces of text, and the
    pieces of a key are hashed one after the other as they arrive.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, n = [*key, value], len(key)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * (n + 1), pa.binary()]
        for batch in rows_of(batches, 8192):
            columns = [c.to_numpy() for c in batch.columns]
            fresh = np.append(True, np.any([c[1:] != c[:-1] for c in columns[:n]], axis=0))
            first = np.flatnonzero(fresh)
            values = columns[n].tolist()
            texts = [",".join(map(str, values[a:b])).encode() for a, b in zip(first, np.append(first[1:], len(values)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*(c[first] for c in columns), texts], kinds)], [*names, "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * (n + 1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < n else pa.string()) for i, c in enumerate(columns)], [*key, "ends_sha256"])

        for batch in rows_of(batches, 1024):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = row[:n], hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(row[n + 1])
            if len(done) > 4096:
                yield out()
                done.clear()
        if digest is not None:
            done.append((*now, digest.hexdigest()))
        yield out()

    longs = ", ".join(f"{k} long" for k in names)
    dealt = rows.select(*names).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    joined = dealt.mapInArrow(pieces, f"{longs}, piece binary")
    return joined.repartition(parts, *key).sortWithinPartitions(*names).mapInArrow(hashed, ", ".join(f"{k} long" for k in key) + ", ends_sha256 string")


def totals(tree: DataFrame, queue: int = QUEUE) -> DataFrame:
    """All columns of `tree` with n_leaves and saved_tokens, summed over each node's subtree.

    `tree` has (conv_id, depth, parent_conv_id, n_children, saved), a node named by the first
    two and its parent by (parent_conv_id, depth - 1).
    """
    spark = tree.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = keep(tree.repartitionByRange(shards, "conv_id", "depth").withColumn("shard", F.spark_partition_id()))
    # one row a shard
    ends = tree.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("a"), F.max(F.struct("conv_id", "depth")).alias("b")).orderBy("shard").collect()
    bounds = {r["shard"]: (tuple(r["a"]), tuple(r["b"])) for r in ends}
    tops = [tuple(r["b"]) for r in ends]
    ids = [r["shard"] for r in ends]

    def home(conv: int, depth: int) -> int:
        return ids[bisect.bisect_left(tops, (conv, depth))]

    own = ["shard", "depth", "conv_id", "parent_conv_id", "n_children", "saved"]
    up = _upward(queue, bounds, home)
    sent = keep(tree.select(*own).sortWithinPartitions(F.desc("depth"), "conv_id").mapInArrow(up, "shard int, to int, depth long, conv_id long, leaves long, saved long"))
    node = ["depth", "conv_id"]
    extra = None
    if sent.head(1):
        labels = tree.select("shard", "depth", "conv_id", "parent_conv_id").sortWithinPartitions("depth", "parent_conv_id").mapInArrow(_downward(queue, bounds), "depth long, conv_id long, up_depth long, up_conv long")
        anchors = sent.select("to", *node).distinct()
        # the vertex that each receiving node lies in
        above = labels.join(anchors, node).where("up_conv IS NOT NULL").select(*node, F.struct(F.col("to").alias("shard"), F.col("up_depth").alias("depth"), F.col("up_conv").alias("conv_id")).alias("jump"))
        vertices = sent.select(F.struct("shard", *node).alias("v"), *node, "leaves", "saved").join(above, node, "left").select("v", "jump", "leaves", "saved")
        done = doubled(vertices)
        extra = done.select(F.col("v.depth").alias("depth"), F.col("v.conv_id").alias("conv_id"), "leaves", "saved").groupBy(*node).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
        extra = extra.join(anchors, node).select(F.col("to").alias("shard"), *node, "leaves", "more")
    rows = tree.withColumns({"leaves": F.lit(None).cast("long"), "more": F.lit(None).cast("long")})
    if extra is not None:
        rows = rows.unionByName(extra, allowMissingColumns=True)
    rest = [c for c in tree.columns if c not in own]
    rows = rows.select(*own, "leaves", "more", *rest).repartition(shards, "shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id", F.asc_nulls_last("leaves"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tree.select(*(c for c in own if c not in ("shard", "saved")), *rest).schema) + ", n_leaves long, saved_tokens long"
    return rows.mapInArrow(_whole(queue, bounds, rest), schema)


def doubled(vertices: DataFrame) -> DataFrame:
    """(v, leaves, saved) summed over subtrees of a tree (v, jump, leaves, saved), in rounds that double the reach."""
    state = keep(vertices.groupBy("v").agg(F.first("jump", ignorenulls=True).alias("jump"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    while state.where("jump IS NOT NULL").head(1):
        gifts = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("v")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        far = state.select(F.col("v").alias("jump"), F.col("jump").alias("next"))
        state = state.join(gifts, "v", "left").join(far, "jump", "left")
        state = keep(state.select("v", F.col("next").alias("jump"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return state.select("v", "leaves", "saved")


def _inside(bounds: dict, shard: int, conv: int, depth: int) -> bool:
    a, b = bounds[shard]
    return a <= (conv, depth) <= b


def _upward(queue: int, bounds: dict, home: Callable[[int, int], int]):
    """Rows of one shard in reverse level order: what goes to parents in other shards, added up by parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, shard, out = SpillingQueue(queue), None, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i < 2 else pa.int64()) for i, c in enumerate(columns)], ["shard", "to", "depth", "conv_id", "leaves", "saved"])

        def leave(entry: tuple[int, int, int, int]) -> None:
            depth, conv = -entry[0], entry[1]
            if out and out[-1][2:4] == (depth, conv):
                last = out.pop()
                out.append((*last[:4], last[4] + entry[2], last[5] + entry[3]))
            else:
                out.append((shard, home(conv, depth), depth, conv, entry[2], entry[3]))

        for batch in rows_of(batches, 4096):
            for shard, depth, conv, parent, children, saved in zip(*(c.to_pylist() for c in batch.columns)):
                leaves = int(children == 0)
                for entry in waiting.upto((-depth, conv)):
                    if entry[:2] == (-depth, conv):
                        leaves, saved = leaves + entry[2], saved + entry[3]
                    else:
                        leave(entry)
                if parent is not None:
                    waiting.put((1 - depth, parent, leaves, saved))
            if len(out) > 4096:
                last = out.pop()  # more may come for its parent
                yield flush()
                out[:] = [last]
        while waiting.least() is not None:
            leave(waiting.pop())
            if len(out) > 4096:
                last = out.pop()
                yield flush()
                out[:] = [last]
        yield flush()

    return run


def _downward(queue: int, bounds: dict):
    """Rows of one shard in level order, by parent: for each node the parent, in another shard, of the shard root above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, at, label = SpillingQueue(queue), None, None
        for batch in rows_of(batches, 4096):
            out = []
            for shard, depth, conv, parent in zip(*(c.to_pylist() for c in batch.columns)):
                if parent is None:
                    mine = None
                elif _inside(bounds, shard, parent, depth - 1):
                    if at != (depth - 1, parent):
                        at, label = (depth - 1, parent), None
                        for entry in waiting.upto(at):
                            if entry[:2] == at and entry[2] >= 0:
                                label = entry[2:]
                    mine = label
                else:
                    mine = (depth - 1, parent)
                waiting.put((depth, conv, *(mine or (-1, 0))))
                out.append((depth, conv, *(mine or (None, None))))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["depth", "conv_id", "up_depth", "up_conv"])

    return run


def _whole(queue: int, bounds: dict, rest: list[str]):
    """Rows of shards, one shard after the other, in reverse level order, each node behind what came for it from other shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, now, extra = SpillingQueue(queue), None, None
        for batch in rows_of(batches, 4096):
            keepers, sums = [], []
            for i, (shard, depth, conv, parent, children, saved, leaves, more) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)))):
                if shard != now:
                    waiting, now, extra = SpillingQueue(queue), shard, None
                if leaves is not None:
                    extra = (leaves, more)
                    continue
                leaves = int(children == 0)
                if extra is not None:
                    leaves, saved, extra = leaves + extra[0], saved + extra[1], None
                for entry in waiting.upto((-depth, conv)):
                    if entry[:2] == (-depth, conv):
                        leaves, saved = leaves + entry[2], saved + entry[3]
                if parent is not None and _inside(bounds, shard, parent, depth - 1):
                    waiting.put((1 - depth, parent, leaves, saved))
                keepers.append(i)
                sums.append((leaves, saved))
            own = batch.take(pa.array(keepers, pa.int64()))
            names = ["depth", "conv_id", "parent_conv_id", "n_children", *rest]
            columns = [own.column(own.schema.get_field_index(c)) for c in names]
            l, s = zip(*sums) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(l, pa.int64()), pa.array(s, pa.int64())], [*names, "n_leaves", "saved_tokens"])

    return run


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: its smallest member, depth, parent, members, children, leaves, saved bytes and ends."""
    done = totals(nodes(conversations))
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
