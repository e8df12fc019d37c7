"""Best-fit packing: a plan over the length histogram, then a join on rank within length.

`token_pieces` turns documents into pieces of at most `size` tokens. `plan` runs
best-fit decreasing over counts of lengths, never over documents: all pieces of
one length that go to bins of one free space are placed by one step. `pack` gives
each piece its rank within its length and looks the rank up in the plan.

Edge cases: a null or empty text is the single closing token; a document longer
than `size` is cut, its first piece takes the remainder; an empty table gives an
empty result and an empty plan; ties between equal lengths go by (doc_id, piece)
inside hashed buckets; repeated rows are packed each; a very long text is tokenized whole
and cut afterwards; columns other than those named are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

#: Text whose white space and letters both libraries class alike.
_ODD = re.compile("[\x1c-\x1f]|<\\|endoftext\\|>")
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Chunks kept per worker; beyond it, chunks are encoded each time.
CACHE = 300_000
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE ids as little-endian bytes, with a cache by white-space chunk.

    Within these chunks the tokenizer never looks at their neighbours, so ids of a
    text are the joined ids of its chunks. Texts with rare separators or with the
    special token are encoded whole. The rank file holds the vocabulary of the JSON file
    of the same name, which the other library reads at 1.6 times the cost; that both give
    equal ids is tested over whole tables.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode(text, allowed_special="all"), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.whole(text)
        known, out = self.known, []
        for chunk in _CHUNKS.findall(text):
            ids = known.get(chunk)
            if ids is None:
                ids = self.whole(chunk)
                if len(known) < CACHE and len(chunk) < 64:
                    known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """The worker's encoder of a rank file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, closing: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.asarray([closing], "<u4").tobytes()
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                ends = range(n % size or size, n + 1, size) if n > size else (n,)
                start = 0
                for k, stop in enumerate(ends):
                    part = ids[4 * start : 4 * stop]
                    rows.append((doc, k, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start = stop
            columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Steps (length, first_rank, pieces, first_sequence, per_sequence, offset): the
    pieces of these ranks fill sequences from the first on, `per_sequence` to each,
    at the offset. Works on at most `size` lengths and one list of sequence runs per
    free space, whatever the number of pieces.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    steps, sequences = [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank, moved = counts[length], 0, []

        def place(room: int, first: int, bins: int) -> int:
            nonlocal left, rank
            each = room // length
            used = min(bins, -(-left // each))
            pieces = min(left, used * each)
            steps.append((length, rank, pieces, first, each, size - room))
            full, rest = divmod(pieces, each)
            if full:
                moved.append((room - each * length, first, full))
            if rest:
                moved.append((room - rest * length, first + full, 1))
            left -= pieces
            rank += pieces
            return used

        for room in sorted(x for x in free if x >= length):
            runs = free.pop(room)
            while runs and left:
                first, bins = runs.pop()
                used = place(room, first, bins)
                if used < bins:
                    runs.append((first + used, bins - used))
            if runs:
                free[room] = runs
            if not left:
                break
        if left:
            sequences += place(size, sequences, -(-left // (size // length)))
        for room, first, bins in moved:
            if room:
                free.setdefault(room, []).append((first, bins))
    return steps


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces that have a length of 1 to `size`.

    The histogram has at most `size` rows and the plan is made on the driver from it.
    Ranks are made in hashed buckets of each length, so that a length which a third
    of all pieces share is spread over the cluster; what is broadcast is the plan and
    one offset per length and bucket.
    """
    spark = pieces.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    grid = keyed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_b")
    offsets = grid.select("length", "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    histogram = {r["length"]: r["_n"] for r in grid.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    table = np.asarray(plan(histogram, size), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(offsets, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_b", "_in", "_before")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        keys = ((size - steps[:, 0]) << 40) + steps[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            step = steps[np.searchsorted(keys, ((size - length) << 40) + rank, "right") - 1]
            k = rank - step[:, 1]
            columns = [c for c, name in zip(batch.columns, batch.schema.names) if name != "_rank"]
            columns += [pa.array(step[:, 3] + k // step[:, 4]), pa.array(step[:, 5] + k % step[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*(n for n in batch.schema.names if n != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(slots, f"{schema}, sequence_id long, offset long")


def best_fit(docs: DataFrame, tokenizer: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packed pieces of all documents; the tokens are counted once and then kept.

    Pieces go through a checkpoint, since the histogram and the slots both need them
    and tokenizing is the dear part.
    """
    from .common import keep

    return pack(keep(token_pieces(docs, tokenizer, size, with_ids=with_ids)), size)
