"""Shared helpers: text batches as byte buffers, checkpoints, and session settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Spark hands to Python at once; long texts are cut into smaller runs by `runs`.
ARROW_ROWS = 512
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches bound the memory of Python workers, unless the session has its own size; a checkpoint folder is set only where none is.

    Only a local master, as in tests, gets a folder of its own, which goes with the driver: executors elsewhere could not read it.
    """
    if spark.conf.get(BATCH) == "10000":  # Spark's default
        spark.conf.set(BATCH, str(ARROW_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if folder is None:
            folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, so that neither lost executors nor later reads compute them again.

    The shuffles that made them are not read again, so their files go with the job.
    """
    spark = df.sparkSession
    prepare(spark)
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # whether shuffles go is settled when a DataFrame is made
    finally:
        spark.conf.set(CLEAN, was)


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as a compressed table in the checkpoint folder, and its path; for large tables of short rows."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table that `kept` has written, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names can't matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type) else b"")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of about `most` bytes of the column; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants); works on a copy."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def powers(n: int, base: int = MULTIPLIER) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2^64; the largest so far is kept."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        p = np.full(1 << max(10, int(n - 1).bit_length()), base, np.uint64)
        p[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(p)
    return known[:n]


class Words:
    """The words of a run of texts: byte ranges, the text of each, and a 64-bit hash of each.

    A word is a maximal run of bytes marked in `inside`, a table of 256 booleans.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> None:
        on = np.zeros(len(data) + 2, np.int8)
        on[1:-1] = inside[data]
        step = np.diff(on)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        if len(inner):  # a word that would cross the end of a text is two words
            inner = np.unique(inner)
            across = inner[(on[inner] == 1) & (on[inner + 1] == 1)]
            starts, ends = np.sort(np.concatenate([starts, across])), np.sort(np.concatenate([ends, across]))
        self.starts, self.ends = starts, ends
        self.text = np.searchsorted(offsets, starts, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(offsets) - 1), side="left")
        self.last = np.searchsorted(self.text, np.arange(len(offsets) - 1), side="right")
        self.hash = span_hash(data, starts, ends)

    def counts(self) -> np.ndarray:
        return self.last - self.first


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, the same wherever it lies: differences of prefix sums of byte times power, brought to one place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    up = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n + 1, INVERSE)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of k consecutive words of one text; a text of fewer words, but not none, is one run."""
    h, text = words.hash, words.text
    counts = words.counts()
    if len(h) >= k:
        n = len(h) - k + 1
        value = np.zeros(n, np.uint64)
        for i in range(k):
            value = value * np.uint64(MULTIPLIER) + h[i : i + n]
        same = text[:n] == text[k - 1 :]
        value, owner = mix(value[same]), text[:n][same]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, t in enumerate(short.tolist()):
            v = int(counts[t])
            for x in h[words.first[t] : words.last[t]].tolist():
                v = (v * MULTIPLIER + x) & 0xFFFFFFFFFFFFFFFF
            extra[j] = v
        value, owner = np.concatenate([value, mix(extra)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, owner
