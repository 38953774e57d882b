"""Exact top-k search by columnar branch-and-bound over blocks of vectors.

Vectors are quantised to whole numbers and stored by dimension. A block of
queries meets a block of candidates: inner products grow dimension block by
dimension block, and after each one the candidates that can't reach the query's
k-th best any more (what they have, plus the product of the norms of the
remaining dimensions) are dropped and the rest compacted. Each pair of blocks
gives k rows a query, merged by a window.

Every row gets a number of its own when blocks are packed. Blocks of queries are
dealt to groups of about `group` queries. Blocks of queries and of candidates of
one dimension meet by an equi-join on the group's number and a salt, so that no
table is broadcast, candidates are sent once for a group and not for a block, and
tasks grow in number, not in size, with both sides: a salt has about
`SALT_BLOCKS` blocks of candidates. Blocks are stored in the narrowest whole
numbers that hold them. Sums are exact: 64-bit whole numbers, or doubles where
they are exact.

Defined cases: vectors that are null or hold null or non-finite components, and
rows of null vec_id, take no part; a query meets the candidates of its own
dimension; ties go to the smaller vec_id; each row of a repeated vec_id is a
candidate, and a query with answers of its own, from which only that very row is
left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, plain, prepare, shuffle_partitions

SCALE = 256
DIMENSIONS = 16  # to a block
CANDIDATES = 4096  # to a block
QUERIES = 1024
GROUP = 16384  # queries that a copy of the candidates is sent for
SALT_BLOCKS = 16  # blocks of candidates in a part of a group's work
BLOCK = "block long, dim int, n_asks long, rows binary, ids binary, asks binary, vectors binary"
FOUND = "query_row long, query_id long, vec_id long, score long"
WIDTHS = ("<i2", "<i4", "<i8")


class _Packer:
    """Gathers rows by dimension into blocks of `most` of them."""

    def __init__(self, most: int) -> None:
        from pyspark import TaskContext

        self.most, self.waiting, self.made = most, {}, TaskContext.get().partitionId() << 32

    def add(self, row: int, vec_id: int, asks: bool, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = self.waiting.setdefault(len(x), [])
        rows.append((row, vec_id, asks, x))
        if len(rows) == self.most:
            yield self._block(self.waiting.pop(len(x)))

    def rest(self) -> Iterator[pa.RecordBatch]:
        for rows in self.waiting.values():
            yield self._block(rows)

    def _block(self, rows: list) -> pa.RecordBatch:
        self.made += 1
        x = np.array([r[3] for r in rows], "<i8").T
        x = np.ascontiguousarray(x, next(k for k in WIDTHS if x.size == 0 or (np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)))
        n_asks = sum(r[2] for r in rows)
        columns = [*(np.array([r[c] for r in rows], kind).tobytes() for c, kind in ((0, "<i8"), (1, "<i8"), (2, bool))), x.tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([self.made]), pa.array([len(x)], pa.int32()), pa.array([n_asks], pa.int64()), *[pa.array([c], pa.binary()) for c in columns]],
            names=["block", "dim", "n_asks", "rows", "ids", "asks", "vectors"],
        )


def _packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of valid vectors."""
    blocks = _Packer(most)
    for batch in batches:
        for row, i, asks, v in zip(*[batch.column(c).to_pylist() for c in ("row", "vec_id", "asks", "embedding")], strict=True):
            if i is None or v is None or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                yield from blocks.add(row, i, asks, np.floor(SCALE * x).astype(np.int64))
    yield from blocks.rest()


def _asked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows that ask, from blocks of candidates, in blocks of their own."""
    blocks = _Packer(most)
    for batch in batches:
        for b in batch.to_pylist():
            rows, ids, x = _read(b["rows"], b["ids"], b["vectors"], b["dim"])
            for k in np.flatnonzero(np.frombuffer(b["asks"], bool)).tolist():
                yield from blocks.add(int(rows[k]), int(ids[k]), True, x[:, k].copy())
    yield from blocks.rest()


def _read(rows: bytes, ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids and vectors (by dimension) of a block; the width of its numbers follows from the sizes."""
    n = len(ids) // 8
    width = len(vectors) // max(1, n * dim)
    return np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(vectors, f"<i{width or 8}").reshape(dim, n).astype(np.int64)


def best(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query_rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Branch-and-bound over one block of candidates for each query: (query_row, query_id, vec_id, score) of its k best here."""
    dim = len(vectors)
    exact = max(1, dim) * float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**53
    kind = np.float64 if exact else np.int64
    v, q = vectors.astype(kind), queries.astype(kind)
    cuts = list(range(0, dim, DIMENSIONS)) or [0]
    # Norms of what is left from each cut on, rounded up: a bound on what the rest can still add.
    rest_v = [np.sqrt((v[c:].astype(np.float64) ** 2).sum(0)) * (1 + 1e-9) for c in [*cuts, dim]]
    rest_q = [np.sqrt((q[c:].astype(np.float64) ** 2).sum(0)) * (1 + 1e-9) for c in [*cuts, dim]]
    first = v[: cuts[1] if len(cuts) > 1 else dim].T @ q[: cuts[1] if len(cuts) > 1 else dim]
    out: list[tuple[np.ndarray, ...]] = []
    for j in range(q.shape[1]):
        alive = np.flatnonzero(rows != query_rows[j])
        have = first[alive, j]
        for b in range(1, len(cuts) + 1):
            more = rest_v[b][alive] * rest_q[b][j]
            if len(alive) > k:
                floor = np.partition(have - more, len(alive) - k)[len(alive) - k]  # the k-th best is this at least
                keep = have + more >= floor - 1e-6 * (1 + abs(floor)) if b < len(cuts) else have >= floor
                alive, have = alive[keep], have[keep]
            if b < len(cuts):
                end = cuts[b + 1] if b + 1 < len(cuts) else dim
                have = have + v[cuts[b] : end, alive].T @ q[cuts[b] : end, j]
        order = np.lexsort((ids[alive], -have))[:k]
        out.append((np.full(len(order), query_rows[j]), np.full(len(order), query_ids[j]), ids[alive][order], have[order].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def search(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERIES, candidate_block: int = CANDIDATES, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id and score of the k candidates of highest integer inner product for each row with `is_query`."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = plain(vectors, "vec_id", "embedding").select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"))
    candidates = cut(rows.mapInArrow(lambda b: _packed(b, candidate_block), BLOCK))  # from here on the rows' numbers are fixed
    asked = cut(candidates.where("n_asks > 0").mapInArrow(lambda b: _asked(b, query_block), BLOCK))
    blocks, asks = candidates.count(), asked.agg(F.sum("n_asks")).first()[0] or 0
    groups = max(1, -(-asks // group))
    salts = max(1, min(blocks, max(shuffle_partitions(spark), -(-blocks // SALT_BLOCKS))))

    def dealt(n: int, seed: int) -> Column:
        return F.pmod(F.hash("block", F.lit(seed)), F.lit(n))

    left = candidates.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("q"), dealt(salts, 1).alias("salt"), "dim", "rows", "ids", "vectors")
    right = asked.select(dealt(groups, 2).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "dim", *[F.col(c).alias(f"query_{c}") for c in ("rows", "ids", "vectors")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                found = best(*_read(b["rows"], b["ids"], b["vectors"], b["dim"]), *_read(b["query_rows"], b["query_ids"], b["query_vectors"], b["dim"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_row", "query_id", "vec_id", "score"])

    found = left.join(right, ["q", "salt", "dim"]).mapInArrow(scan, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
