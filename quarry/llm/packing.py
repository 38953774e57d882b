"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing: pieces go by falling length into the open sequence with the
least room that still holds them. A segment tree over remaining capacities finds
that sequence's capacity in logarithmic time. Pieces of one length are alike, so
the plan is made on the histogram of lengths (as many numbers as the capacity,
whatever the corpus) and says for each run of equal pieces where they go; the
tasks that hold the pieces then look their places up. No document passes
through the driver.

Defined cases: null and empty texts are one piece that holds only the end
token; repeated rows are packed as often as they occur; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, plain, prepare, runs

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class CapacityTree:
    """Counts of open sequences by remaining capacity, with the smallest capacity of at least x that has any."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += n
            node //= 2

    def tightest(self, least: int) -> int | None:
        node = least + self.size
        if self.count[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.count[2 * node])
                return node - self.size
            node //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Where equal pieces go: rows (length, first rank, sequence, offset, pieces per sequence), and the number of sequences.

    Of the pieces of one length, the one of rank t from a row's first rank on goes to
    sequence + t // per at offset + t % per * length.
    """
    tree = CapacityTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining: runs of (first sequence, how many)
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                need = -(-left // per)
                room, first, n = capacity, made, need
                made += need
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
                per = room // length
            take = min(left, n * per)
            rows.append((length, rank, first, capacity - room, per))
            full, rest = divmod(take, per)
            put(room - per * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            used = full + bool(rest)
            put(room, first + used, n - used)
            left, rank = left - take, rank + take
    return np.array(rows, np.int64).reshape(-1, 5), made


def _tokenizer(name: str, library: str):
    """Ids of a text by the vocabulary of `name`: the byte-level ranks when there are any (the same ids, faster), else the file itself."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public.path(f"{name}.json"))
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    if library == "tokenizers":
        return lambda text: np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(public.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):  # only the full tokenizer gives these an id of their own
            return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k", library: str = "tiktoken") -> DataFrame:
    """Each document's pieces, with the task (`part`) and the rank among the task's pieces of that length (`nth`).

    A document of more than `capacity` tokens is cut into pieces of that length, of which the first may be shorter.
    """
    prepare(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of = _tokenizer(tokenizer, library)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in runs(batches, "text"):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(ids_of(text or ""), np.uint32(end_id)).astype("<u4")
                start, end = 0, len(ids) % capacity or capacity
                k = 0
                while start < len(ids):
                    out.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes()), part, int(seen[end - start])))
                    seen[end - start] += 1
                    start, end, k = end, end + capacity, k + 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return plain(docs, "doc_id", "text").mapInArrow(cut_up, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k", library: str = "tiktoken") -> DataFrame:
    """Every piece with its sequence and the place in it: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = cut(pieces(docs, capacity, end_id, tokenizer, library))
    sizes = cut(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table, _ = plan(histogram, capacity)
    order = np.lexsort((table[:, 1], table[:, 0]))
    table = table[order]
    length_at = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    from pyspark.sql import Window

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = np.int64(1) << np.int64(40)
        keys = table[:, 0] * big + table[:, 1]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("base").to_numpy() + b.column("nth").to_numpy()
            row = table[np.maximum(np.searchsorted(keys, length * big + rank, side="right") - 1, length_at[length])] if len(length) else table[:0]
            t, per = rank - row[:, 1], row[:, 4]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 2] + t // per), pa.array(row[:, 3] + t % per * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return rows.join(bases, ["part", "length"]).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
