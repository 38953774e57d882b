"""Ranked retrieval over a persisted inverted index: no text is split when a question is asked.

An index has four tables. `rows` holds each row's id, tokens and features, in
zones of rows with like features. `postings` has a row for each token of each
row, by buckets of tokens and, within each file, by a hash of the token, so that a
question reads the buckets and pages of its own tokens; each task writes those of
the rows that it reads, so that none are sent elsewhere. `terms` counts each token's rows by zone, and
`zones` has the least and greatest of each feature.

A question first bounds the score of each zone from `zones` and `terms` (at most
`zones` rows). The zones of the greatest bounds are scored exactly, as far as
they hold k rows, and give the score that has to be reached; zones whose bound
doesn't reach it are not read. A bound is never under a score that a row of the
zone can have, so the result is that of scoring every row.

Defined cases: null tokens are none; a row without tokens still has its
features; null ids are rows like others; a question without tokens scores
features alone; an empty table gives no rows; repeated ids are rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.workspace import exists

BUCKETS, ZONES = 32, 64
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Rows that are all scored at once, without bounds.
FEW = 50_000


def _bucket(token: Column, buckets: int) -> Column:
    return (F.crc32(token.cast("binary")) % buckets).cast("int")


class Features:
    """Columns by feature name, as `f.name`; for bounds `f.low(name)` and `f.high(name)`, which are a row's own value when rows are scored."""

    def __init__(self, low: Callable[[str], Column], high: Callable[[str], Column]) -> None:
        self.low, self.high = low, high

    def __getattr__(self, name: str) -> Column:
        return self.high(name)

    def may_equal(self, name: str, value) -> Column:
        """Whether the feature is, or in a zone can be, the value."""
        return F.coalesce(F.lit(value).between(self.low(name), self.high(name)), F.lit(False))

    def nearest(self, name: str, value: float) -> Column:
        """The feature, or the nearest to the value that a zone can have."""
        return F.least(F.greatest(F.lit(value), self.low(name)), self.high(name))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    features: tuple[str, ...]
    types: str  # of id and features, as column definitions
    buckets: int
    few: int = FEW
    opened: dict = field(default_factory=dict, compare=False)

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self._read(name)  # its files are listed once
        return self.opened[name]

    def _read(self, name: str) -> DataFrame:
        schemas = {"rows": f"{self.types}, tokens array<string>, ref long, zone int", "postings": "ref long, zone int, token string, key long, bucket int", "terms": "token string, zone int, n long, bucket int"}
        read = self.spark.read.schema(schemas[name]) if name in schemas else self.spark.read
        return read.parquet(f"{self.path}/{name}")

    def _of(self, name: str, tokens: list[str]) -> DataFrame:
        """Rows of the postings or terms of some tokens; only their buckets are read."""
        wanted = sorted(set(tokens))
        own = sorted({zlib.crc32(w.encode()) % self.buckets for w in wanted})
        found = self.table(name).where(F.col("bucket").isin(own) & F.col("token").isin(wanted))
        return found.where(F.col("key").isin([F.xxhash64(F.lit(w)) for w in wanted])) if name == "postings" else found

    def hits(self, tokens: list[str], zones: list[int] | None = None) -> DataFrame:
        """ref, zone and how many of the tokens the row has, for rows that have any."""
        found = self._of("postings", tokens)
        if zones is not None:
            found = found.where(F.col("zone").isin(zones))
        return found.groupBy("ref", "zone").agg(F.count("*").alias("n"))

    def bounds(self, tokens: list[str], score: Callable[[Features, Column], Column]) -> DataFrame:
        """zone, rows, and the greatest score that a row of the zone can have."""
        zones = self.table("zones")
        there = self._of("terms", tokens).groupBy(F.col("zone").alias("z")).agg(F.count_distinct("token").alias("n"))
        both = zones.join(there, F.col("zone") == F.col("z"), "left")
        ratio = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(max(len(set(tokens)), 1)))
        f = Features(lambda c: F.col(f"low_{c}"), lambda c: F.col(f"high_{c}"))
        return both.select("zone", "rows", score(f, ratio).alias("bound"))

    def scored(self, tokens: list[str], score: Callable[[Features, Column], Column], zones: list[int] | None = None) -> DataFrame:
        """id, ref and score of all rows, or of those of some zones."""
        rows = self.table("rows")
        if zones is not None:
            rows = rows.where(F.col("zone").isin(zones))
        rows = rows.select("id", "ref", *self.features)
        hits = self.hits(tokens, zones).select(F.col("ref").alias("hit"), "n")
        ratio = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(max(len(set(tokens)), 1)))
        f = Features(F.col, F.col)
        return rows.join(hits, F.col("ref") == F.col("hit"), "left").select("id", "ref", score(f, ratio).alias("score"))

    def search(self, tokens: list[str], score: Callable[[Features, Column], Column], k: int, order: Callable[[], list[Column]] = lambda: [F.col("id")]) -> DataFrame:
        """The k rows of the greatest scores, ties by `order`: id and score. `score` must not fall when a feature or the share of tokens rises, but by `may_equal` and `nearest`."""
        by = [F.desc("score"), *order()]
        if "size" not in self.opened:
            self.opened["size"] = self.table("zones").agg(F.sum("rows")).first()[0] or 0
        if self.opened["size"] <= self.few:  # bounds would take longer than they save
            return self.scored(tokens, score).orderBy(*by).limit(k).select("id", "score")
        bounds = self.bounds(tokens, score).orderBy(F.desc("bound"), "zone").collect()  # at most the index's number of zones
        first, held = [], 0
        for b in bounds:
            if held >= k:
                break
            first.append(b.zone)
            held += b.rows
        if held < k or len(first) == len(bounds):
            return self.scored(tokens, score).orderBy(*by).limit(k).select("id", "score")
        reached = self.scored(tokens, score, first).orderBy(F.desc("score")).limit(k).agg(F.min("score")).first()[0]
        zones = [b.zone for b in bounds if b.zone in first or b.bound is None or b.bound >= reached]
        return self.scored(tokens, score, zones).orderBy(*by).limit(k).select("id", "score")


def build(rows: DataFrame, path: str, id: Column, tokens: Column, features: dict[str, Column], cluster: list[str], buckets: int = BUCKETS, zones: int = ZONES) -> Index:
    """Writes an index of the rows; `cluster` names the features by which rows are put in zones. The list of zones is written last, and marks the index as whole."""
    if clash := {"id", "ref", "zone", "tokens", "token", "key", "bucket", "n", "hit"} & features.keys():
        raise ValueError(f"a feature can't be called {sorted(clash)[0]!r}")
    spark, index = rows.sparkSession, _index(rows, path, id, features, buckets)
    # Rows are dealt first, as sampling for the ranges would split the texts once more.
    kept = rows.withColumns({f"index_{n}": c for n, c in features.items()} | {"index_id": id})
    kept = kept.repartitionByRange(zones, *[f"index_{c}" for c in cluster], F.xxhash64("index_id")) if cluster else kept.repartition(zones)
    base = kept.select(F.col("index_id").alias("id"), F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))).alias("tokens"), *[F.col(f"index_{n}").alias(n) for n in features])
    base.select("*", F.spark_partition_id().alias("zone"), F.monotonically_increasing_id().alias("ref")).write.partitionBy("zone").mode("overwrite").parquet(f"{path}/rows")
    written = index.table("rows")
    token = F.col("token")
    postings = written.select("ref", "zone", F.explode("tokens").alias("token")).withColumns({"key": F.xxhash64(token), "bucket": _bucket(token, buckets)})
    # A sort by one number needs no comparison of rows; with a writer for each bucket open, its order holds within each file.
    was = spark.conf.get(WRITERS, "0")
    spark.conf.set(WRITERS, str(buckets))
    try:
        postings.sortWithinPartitions("key").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    finally:
        spark.conf.set(WRITERS, was)
    terms = index.table("postings").groupBy("bucket", "token", "zone").agg(F.count("*").alias("n"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/terms")
    ends = [f(c).alias(f"{p}_{c}") for c in features for f, p in ((F.min, "low"), (F.max, "high"))]
    written.groupBy("zone").agg(F.count("*").alias("rows"), F.sum(F.size("tokens")).alias("tokens"), *ends).coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
    return index


def _index(rows: DataFrame, path: str, id: Column, features: dict[str, Column], buckets: int) -> Index:
    fields = rows.select(id.alias("id"), *[c.alias(n) for n, c in features.items()]).schema
    return Index(rows.sparkSession, path, tuple(features), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), buckets)


def opened(rows: DataFrame, path: str, id: Column, tokens: Column, features: dict[str, Column], cluster: list[str], buckets: int = BUCKETS, zones: int = ZONES) -> Index:
    """The index at a path, which is built where it isn't there whole."""
    if exists(rows.sparkSession, f"{path}/zones/_SUCCESS"):
        return _index(rows, path, id, features, buckets)
    return build(rows, path, id, tokens, features, cluster, buckets, zones)


def coverage(index: Index, rows: int) -> DataFrame:
    """One row on an index of a table of so many rows: how many are in it, the share, those without tokens, postings and distinct tokens."""
    z, t = index.table("zones"), index.table("terms")
    held = z.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("indexed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("postings"))
    empty = index.table("rows").agg(F.count_if(F.size("tokens") == 0).alias("without_tokens"))
    words = t.agg(F.count_distinct("token").alias("vocabulary"))
    share = F.when(F.lit(rows) == 0, F.lit(0.0)).otherwise(F.floor(F.col("indexed") / F.lit(float(max(rows, 1))) * 10000 + 0.5) / 10000)
    one = held.join(empty, F.lit(True)).join(words, F.lit(True))  # one row each
    return one.select("indexed", share.alias("coverage"), F.greatest(F.lit(rows) - F.col("indexed"), F.lit(0)).alias("missing"), "without_tokens", "postings", "vocabulary")
