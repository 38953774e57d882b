"""Importance resampling towards a target: hashed n-gram features, their log ratios as weights, and a draw by Gumbel scores.

Texts become word ids, shard by shard (a few megabytes inside a task). A shard's
suffix array holds its places in the order of the words that follow, as far as
the longest n-gram; the lengths of common prefixes of neighbours (LCP) then say
where runs of equal n-grams begin, for each n. An n-gram is hashed once for a
run, and its bucket is scattered back to all places of the run.

Buckets are counted over all documents and over the target, first in each task;
the counts are one row a bucket, so at most `buckets` numbers go to the driver. A
document's weight is the floored mean of its features' gains. The draw is exact:
scores are whole numbers, of which there are only so many, so their counts tell
the least score that can be drawn; rows from it on are sorted over ranges, and a
row's rank is its place in its range after all ranges before it.

Defined cases: null texts and texts without words have no features, weight 0, and
are not drawn; rows of null doc_id are hashed as the empty id and come last among
ties; rows that repeat an id are judged each by itself, in any order among
themselves; other columns are ignored by `digest` and kept by `draw`; an empty
target gives each bucket the gain of its smoothing alone; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Words, buffer, cut, plain, prepare, runs

#: Bytes of words: digits, letters, and every byte of characters beyond ASCII; A-Z are lower-cased.
INSIDE = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
LONGEST, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, 2024


def suffixes(ids: np.ndarray, left: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the next `longest` words, and how many words each has in common with the one before; `left` words remain in a place's text."""
    n = len(ids)
    columns = []
    for k in range(longest):
        column = np.full(n, -1, np.int64)
        column[: n - k] = np.where(left[: n - k] > k, ids[k:], -1)
        columns.append(column)
    order = np.lexsort(columns[::-1]) if longest > 1 else np.argsort(ids, kind="stable")
    common, equal = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for column in columns:
        there = column[order]
        equal &= (there[1:] == there[:-1]) & (there[1:] >= 0)
        common[1:] += equal
    return order, common


def features(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a shard's texts, and each feature's text and bucket."""
    data = FOLD[data]
    words = Words(data, offsets, INSIDE)
    n = len(words.hash)
    if not n:
        return words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.unique(words.hash, return_inverse=True)[1]
    left = words.last[words.text] - np.arange(n)
    order, common = suffixes(ids, left, longest)
    raw = data.tobytes()
    starts, ends = words.starts.tolist(), words.ends.tolist()
    owners, found = [], []
    for k in range(1, longest + 1):
        fits = left[order] >= k
        places = order[fits]
        # A run goes on while neighbours share k words; those left out are too short to be of any run of k.
        run = np.cumsum(common[fits] < k) - 1
        heads = places[np.flatnonzero(np.diff(run, prepend=-1))]
        hashed = np.fromiter((zlib.crc32(b" ".join([raw[starts[j] : ends[j]] for j in range(i, i + k)])) for i in heads.tolist()), np.int64, len(heads))
        bucket = np.empty(n, np.int64)
        bucket[places] = (hashed % buckets)[run]
        whole = left >= k
        owners.append(words.text[whole])
        found.append(bucket[whole])
    return words, np.concatenate(owners), np.concatenate(found)


def counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of each bucket over all texts."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in runs(batches, "text"):
            total += np.bincount(features(*buffer(b.column("text")), longest, buckets)[2], minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], schema=schema)

    out = np.zeros(buckets, np.int64)
    for r in plain(docs, "text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a nat each: how much more frequent each bucket is in the target, with one added to each bucket."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str) -> int:
    """The Gumbel number of a key, in thousandths."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])


def weighed(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            words, owner, bucket = features(*buffer(b.column("text")), longest, len(gain))
            n = np.bincount(owner, minlength=b.num_rows)
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, owner, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = b.column("doc_id").to_pylist()
            score = weight + np.array([noise(f"{seed}:{'' if d is None else d}") for d in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words.counts(), n, weight, score))], schema=_SCORED)

    rows = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int, least: int) -> DataFrame:
    """The scored rows with `rank`: 1, 2, ... for the drawn ones, null for others. Reads `scored` several times."""
    could = scored.where(F.col("n_words") >= least)
    by_score = could.groupBy("score").count()  # thousandths of logarithms of counts and of 32-bit hashes: under 150,000 different ones, however many rows
    above = by_score.select("score", "count", F.sum("count").over(Window.orderBy(F.desc("score"))).alias("so_far")).collect()
    wanted = sum(r["count"] for r in above) * percent // 100
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    lowest = max(r.score for r in above if r.so_far >= wanted)
    first = could.where(F.col("score") >= lowest).withColumn("salt", F.monotonically_increasing_id())
    keys = [F.desc("score"), F.asc_nulls_last("doc_id"), "salt"]
    placed = cut(first.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("p")).count().select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("before"))  # one row a range
    rank = F.col("before") + place + 1
    drawn = placed.join(F.broadcast(before), part == F.col("p")).select("doc_id", "n_words", "n_features", "weight", "score", F.when(rank <= wanted, rank).alias("rank"))
    rest = scored.where((F.col("n_words") < least) | (F.col("score") < lowest)).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score and rank; the drawn ones, `percent` of those of `least` words, have a rank."""
    prepare(docs.sparkSession)
    gain = gains(counts(docs, longest, buckets), counts(target, longest, buckets))
    return ranked(cut(weighed(docs, gain, longest, seed)), percent, least)


def draw(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, with all their columns; rows that repeat a doc_id are drawn together."""
    drawn = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(drawn, docs.doc_id.cast("long").eqNullSafe(drawn.drawn_id), "left_semi")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).drop("n_words")
