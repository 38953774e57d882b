"""Similarity join on word shingles by chosen paths.

Documents are sets of five-word shingles; two documents are linked if their
Jaccard similarity is at least `similarity`. In each of several independent runs
every set chooses the tokens (shingles) that come first in the run's own random
order, 1 / similarity of them rounded up, and sets of one token are a bucket. A
bucket of over `small` sets is split by more tokens that its sets share, taken in
rising order from a sample that each set keeps (the shingles whose hash lies
under a threshold in inverse proportion to its size, so that similar sets sample
mostly the same ones); its parts are split in turn, as long as that pays, to any
depth. The tokens on the way are the bucket's path. Small buckets are compared by
brute force, large ones that can't be split in square tiles, each a task's work
of a bounded size.

A pair belongs to one path: the first token that both chose, by run, and then
their least shared sampled tokens. There it is compared in three steps: sizes and
samples first; then only sets with a likely partner send their shingles, to the
buckets of those partners; then exact similarities.

`recall` is the share of the pairs at exactly the similarity that is found at
least; closer ones are missed less. Half of what may be missed sets the number of
runs (a run misses a pair with a probability of at most (1 - similarity) to the
power of the tokens it chooses), a quarter how many tokens each split follows, and
a quarter how many tokens of the samples have to agree.

Documents of one shingle set are one set with a count, and classes are the
connected components of the links, by label propagation with pointer jumping.
One document of a class stays in `distinct`: of its least doc_id, and where
that has several texts in the class, the one of the least digest.

Words are runs of letters and digits with A-Z lower-cased; all characters beyond
ASCII count as letters. Defined cases: texts of one to four words are one
shingle; null texts and texts without words link to nothing and are classes of
their own; repeated rows are linked copies; an empty table gives no rows;
`digest` ignores other columns and `distinct` keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, mix, plain, prepare, runs, shingles, shuffle_partitions
from quarry.llm.decontamination import words_of

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
SMALL = 64
TILE = 1024
SKETCH = 32  # tokens that a sample has on average, at least
JUDGED = 64  # sets that tell whether a bucket's split pays
LEVELS = 4  # splits after which a pair's recall is still as wanted
SEED = np.uint64(0x5851F42D4C957F2D)


class Plan:
    """What the recall asks for at a similarity."""

    def __init__(self, similarity: float, recall: float) -> None:
        if not (0 < similarity <= 1 and 0 < recall < 1):
            raise ValueError("similarity has to be over 0 and at most 1, and recall between 0 and 1")
        self.similarity, missed = similarity, 1 - recall
        miss = max(1 - similarity, 1e-9)  # the probability that a token of one set is not in the other, at most
        self.chosen = math.ceil(1 / similarity)
        self.runs = max(1, math.ceil(math.log(missed / 2) / (self.chosen * math.log(miss))))
        self.follow = max(1, math.ceil(math.log(missed / 8 / LEVELS) / math.log(miss)))
        self.sample = max(SKETCH, 4 * self.follow)
        self.agree = np.array([self._agreeing(n, missed / 4) for n in range(2 * self.sample + 1)])

    def _agreeing(self, n: int, missed: float) -> int:
        """The most tokens that a pair at the similarity shares, of n of the larger set, with all but that probability."""
        total = 0.0
        for k in range(n + 1):
            total += math.comb(n, k) * self.similarity**k * (1 - self.similarity) ** (n - k)
            if total > missed:
                return k
        return n

    def enough(self, n: np.ndarray) -> np.ndarray:
        """Tokens that have to agree of n; beyond the table in proportion to its end."""
        last = len(self.agree) - 1
        return np.where(n <= last, self.agree[np.minimum(n, last)], n * (self.agree[last] / last))


def sets(docs: DataFrame, plan: Plan, k: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text), sig (of the shingle set), size, the tokens chosen (by run, then rising) and the sampled ones in rising order, of every row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            own = list(shingle_sets(b.column("text"), k))
            sig, tokens = [], []
            for x in own:
                r = mix(x ^ SEED) >> np.uint64(1)
                tokens.append(np.sort(r[r < np.uint64(min(2**63 - 1, int(plan.sample / max(1, len(x)) * 2**63)))] if len(x) > plan.sample else r).astype(np.int64))
                sig.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            size = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("digest"), pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(choose(own, plan), _LIST), pa.array(tokens, _LIST)],
                names=["doc_id", "digest", "sig", "size", "opens", "tokens"],
            )

    return docs.select("doc_id", "digest", "text").mapInArrow(look, "doc_id long, digest binary, sig binary, size int, opens array<bigint>, tokens array<bigint>")


def choose(own: list[np.ndarray], plan: Plan) -> list[np.ndarray]:
    """For each set the tokens that come first in each run's order, as numbers that rise with the run and the order in it."""
    size = np.array([len(x) for x in own])
    there = np.flatnonzero(size)
    out = np.full((len(own), plan.runs * plan.chosen), -1, np.int64)
    if len(there):
        whole = np.concatenate([own[i] for i in there])
        first = np.cumsum(size[there]) - size[there]
        bits = max(1, (plan.runs - 1).bit_length())
        for r in range(plan.runs):
            order = mix(whole ^ mix(SEED + np.arange(1, dtype=np.uint64) + np.uint64(r + 1))) >> np.uint64(1 + bits)
            for c in range(plan.chosen):
                least = np.minimum.reduceat(order, first)
                found = least < NONE
                out[there[found], r * plan.chosen + c] = (np.uint64(r) << np.uint64(63 - bits) | least[found]).astype(np.int64)
                order[order == np.repeat(least, size[there])] = NONE
    return [row[row >= 0] for row in out]


NONE = np.uint64(2**64 - 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    value, owner = shingles(words_of(column), k)
    at = np.searchsorted(owner, np.arange(len(column) + 1))
    for i in range(len(column)):
        yield np.unique(value[at[i] : at[i + 1]])


def shares(m: Column) -> Column:
    """How many shares a bucket of m sets is looked up in, so that no task gets a large bucket whole."""
    return F.ceil(m / F.lit(TILE)).cast("long")


def paying(large: DataFrame, judged: int = JUDGED) -> DataFrame:
    """path, share and pays (true) of each share of the buckets whose split pays: the squares of the parts are well under the square of the whole.

    About `judged` sets of a bucket, by hash, stand for all; a bucket of no more is judged by all of its sets. What
    doesn't pay stays whole, so this settles the work to be done and never what is found.
    """
    some = large.where(F.pmod(F.xxhash64("sig", F.lit("judged")), F.col("m")) < judged).select("path", "m", F.posexplode_outer("ahead").alias("at", "next"))
    part = some.groupBy("path", "next").agg(F.count("next").cast("double").alias("n"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("sets"), F.first("m").cast("double").alias("m"))
    sums = part.groupBy("path").agg(F.first("m").alias("m"), F.sum("sets").alias("s"), F.sum("n").alias("tokens"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    m, s = F.col("m"), F.col("s")
    squares = F.col("pairs") * m * (m - 1) / F.greatest(s * (s - 1), F.lit(1)) + F.col("tokens") * m / s
    pays = sums.where((s > 1) & (squares < 0.5 * m * m))
    return cut(pays.select("path", F.explode(F.sequence(F.lit(0).cast("long"), shares(m) - 1)).alias("share"), F.lit(True).alias("pays")))


def paths(kinds: DataFrame, small: int, plan: Plan) -> DataFrame:
    """The buckets: path, ended, m (sets in it), and for each of them sig, size, tokens chosen and sampled, and copies.

    A bucket that ended holds those sets of a split one that are too small to share more tokens than its path has.
    """
    rows = kinds.select("sig", F.explode("opens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    level = cut(rows.join(counts, "token").select(F.array("token").alias("path"), "m", "sig"))
    here = ("path", "ended", "m", "sig")
    found = level.where(F.col("m") <= small).withColumn("ended", F.lit(False)).select(*here)
    while not (large := level.where(F.col("m") > small)).isEmpty():
        depth = F.size("path") - 1
        sampled = F.when(depth == 0, F.col("tokens")).otherwise(F.filter("tokens", lambda t: t > F.element_at("path", -1)))
        ended = (depth > 0) & (plan.similarity * F.col("size") <= depth)
        share = F.pmod(F.xxhash64("sig"), shares(F.col("m")))
        large = cut(large.join(kinds.select("sig", "size", "tokens"), "sig").select("sig", "path", "m", share.alias("share"), ended.alias("ended"), F.slice(sampled, 1, plan.follow).alias("ahead")))
        judged = large.join(paying(large), ["path", "share"], "left").drop("share")
        split, whole_ones = judged.where("pays"), judged.where("pays IS NULL").withColumn("ended", F.lit(False)).select(*here)
        over = split.where("ended")
        several = over.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        ends = over.join(several, "path").select("path", "ended", F.col("n").alias("m"), "sig")
        level = cut(split.select("sig", "path", F.explode("ahead").alias("next")))
        parts = level.groupBy("path", "next").agg(F.count("*").alias("n")).where("n > 1")
        level = cut(level.join(parts, ["path", "next"]).select(F.concat("path", F.array("next")).alias("path"), F.col("n").alias("m"), "sig"))
        found = cut(found.unionByName(whole_ones).unionByName(ends).unionByName(level.where(F.col("m") <= small).withColumn("ended", F.lit(False)).select(*here)))
    # Of the tokens chosen, only those up to the path's own matter.
    return found.join(kinds.select("sig", "size", "opens", "tokens", "copies"), "sig").withColumn("opens", F.filter("opens", lambda o: o <= F.element_at("path", 1)))


def tiled(buckets: DataFrame, tile: int) -> DataFrame:
    """Rows of buckets with the pair of tiles (ti <= tj) they are compared in; buckets of up to `tile` sets are one tile."""
    n = F.ceil(F.col("m") / F.lit(tile))
    own = F.pmod(F.xxhash64("sig"), n).cast("int")
    with_tile = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return with_tile.select("*", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj")).drop("other")


def incidence(lists: list[np.ndarray], least: int = 2) -> Iterator[np.ndarray]:
    """Which list has which value, for the values in at least `least` lists: matrices of up to 4096 columns."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values, column, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    keep = n >= least
    to = np.cumsum(keep) - 1
    inside = keep[column]
    owner, column = owner[inside], to[column[inside]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(keep.sum())
    for a in range(0, total, 4096):
        i, j = np.searchsorted(column, a), np.searchsorted(column, a + 4096)
        m = np.zeros((len(lists), min(4096, total - a)), np.float32)
        m[owner[i:j], column[i:j] - a] = 1
        yield m


def common(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two lists share."""
    if len(lists) == 2:
        n = len(np.intersect1d(*lists, assume_unique=True))
        return np.array([[len(lists[0]), n], [n, len(lists[1])]], np.float32)
    out = np.zeros((len(lists), len(lists)), np.float32)
    for m in incidence(lists):
        out += m @ m.T
    return out


def likely(rows: list[tuple], plan: Plan) -> np.ndarray:
    """Pairs of a tile (rows as in BUCKET) that belong to its path, with sizes and samples that allow the similarity: a symmetric boolean matrix."""
    path, ended, ti, tj = rows[0][:4]
    sizes, own = np.array([r[6] for r in rows]), np.array([r[4] for r in rows])
    opens, tokens = ([np.array(r[c], np.int64) for r in rows] for c in (7, 8))
    ok = np.minimum.outer(sizes, sizes) >= plan.similarity * np.maximum.outer(sizes, sizes)
    if ti != tj:
        ok &= own[:, None] != own[None, :]
    np.fill_diagonal(ok, False)
    if ok.any():
        ok &= common([t[t <= path[0]] for t in opens]) == 1  # no run before this one has both, nor a token before this one
    if len(path) > 1 and ok.any():
        ok &= common(tokens if ended else [t[t <= path[-1]] for t in tokens]) == len(path) - 1
    if ok.any():
        # The larger set has the lower threshold: of its sample, enough must be in the other's.
        n = np.array([len(t) for t in tokens])
        ok &= common(tokens) >= plan.enough(np.minimum.outer(n, n))
    return ok


BUCKET = ("path", "ended", "ti", "tj", "own", "sig", "size", "opens", "tokens", "copies")


def grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], key: int) -> Iterator[list[tuple]]:
    """Rows of a sorted stream by their first `key` columns; a group has no more rows than a bucket's tiles."""
    last, rows = None, []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in columns], strict=True):
            k = (tuple(row[0]), *row[1:key])
            if k != last and rows:
                yield rows
                rows = []
            last = k
            rows.append(row)
    if rows:
        yield rows


def unique_rows(rows: list[tuple], at: int) -> list[tuple]:
    """One row for each signature, in a fixed order."""
    return [r for _, r in sorted({r[at]: r for r in rows}.items())]


def links(docs: DataFrame, kinds: DataFrame, plan: Plan, small: int, tile: int, k: int) -> DataFrame:
    """For each tile of a bucket and each set with links there: sig, n (documents linked) and root (a set of the same component)."""
    parts = shuffle_partitions(docs.sparkSession)

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *BUCKET[:4]).sortWithinPartitions(*BUCKET[:4])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches, BUCKET, 4):
            rows = unique_rows(rows, 5)
            if len(rows) > 1:
                out += [(rows[i][5], *rows[i][:5]) for i in np.flatnonzero(likely(rows, plan).any(1)).tolist()]
            if len(out) > 2000:
                yield pa.RecordBatch.from_pydict(dict(zip(ASSIGNED.names, map(list, zip(*out, strict=True)), strict=True)), schema=ASSIGNED)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(ASSIGNED.names, map(list, zip(*out, strict=True)), strict=True)), schema=ASSIGNED)

    buckets = tiled(paths(kinds, small, plan), tile).select(*BUCKET)
    assigned = cut(together(buckets).mapInArrow(candidates, "sig binary, path array<bigint>, ended boolean, ti int, tj int, own int"))
    sent = assigned.groupBy("sig").agg(F.collect_list(F.struct(*BUCKET[:5])).alias("to")).join(kinds.select("sig", "digest", "speaker", "size", "opens", "tokens", "copies"), "sig")
    texts = docs.withColumn("speaker", F.coalesce("doc_id", F.lit(-1))).select("digest", "speaker", "text").join(sent, ["digest", "speaker"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text", 1 << 20):
            rows = zip(*[b.column(c).to_pylist() for c in ("sig", "size", "opens", "tokens", "copies", "to")], strict=True)
            out = [(*[t[c] for c in BUCKET[:5]], *own, x.tobytes()) for (*own, to), x in zip(rows, shingle_sets(b.column("text"), k), strict=True) for t in to]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(SENT.names, map(list, zip(*out, strict=True)), strict=True)), schema=SENT)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in grouped(batches, tuple(SENT.names), 4):
            rows = unique_rows(rows, 5)
            if len(rows) < 2:
                continue
            sizes, copies = np.array([r[6] for r in rows]), np.array([r[9] for r in rows])
            ok = likely(rows, plan)
            if not ok.any():
                continue
            inter = common([np.frombuffer(r[10], np.uint64) for r in rows]).astype(np.float64)
            ok &= inter >= plan.similarity * (sizes[:, None] + sizes[None, :] - inter) - 1e-9
            n = ok @ copies
            root = components(ok)
            out += [(rows[i][5], int(n[i]), rows[root[i]][5]) for i in np.flatnonzero(n > 0).tolist()]
            if len(out) > 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(LINKED.names, map(list, zip(*out, strict=True)), strict=True)), schema=LINKED)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(LINKED.names, map(list, zip(*out, strict=True)), strict=True)), schema=LINKED)

    full = texts.mapInArrow(send, "path array<bigint>, ended boolean, ti int, tj int, own int, sig binary, size int, opens array<bigint>, tokens array<bigint>, copies long, shingles binary")
    return cut(together(full).mapInArrow(verify, "sig binary, n long, root binary"))


_LIST = pa.list_(pa.int64())
_WHERE = [("path", _LIST), ("ended", pa.bool_()), ("ti", pa.int32()), ("tj", pa.int32()), ("own", pa.int32())]
ASSIGNED = pa.schema([("sig", pa.binary()), *_WHERE])
SENT = pa.schema([*_WHERE, ("sig", pa.binary()), ("size", pa.int32()), ("opens", _LIST), ("tokens", _LIST), ("copies", pa.int64()), ("shingles", pa.binary())])
LINKED = pa.schema([("sig", pa.binary()), ("n", pa.int64()), ("root", pa.binary())])


def components(linked: np.ndarray) -> np.ndarray:
    """The least member of each one's component in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def labelled(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) from edges (a, b)."""
    both = cut(edges.where("a <> b").distinct())
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        better = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        after = cut(better.join(up, "new", "left").select("node", F.least("new", F.coalesce("up", "new")).alias("to"), "label"))
        changed = after.where(F.col("to") < F.col("label")).limit(1).count()
        labels = after.select("node", F.col("to").alias("label"))
        if not changed:
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY, k: int = WORDS, small: int = SMALL, tile: int = TILE, recall: float = RECALL) -> DataFrame:
    """doc_id, digest, class_id (the least doc_id of the class), n_links (other documents linked directly) and label (of the class; null without words) of every row (doc_id, text)."""
    prepare(docs.sparkSession)
    plan = Plan(similarity, recall)
    docs = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = cut(sets(docs, plan, k))
    speaker = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("speaker"), "digest"))
    kinds = found.where("size > 0").groupBy("sig").agg(F.count("*").alias("copies"), speaker.alias("s"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("size", "opens", "tokens")])
    kinds = cut(kinds.select("sig", "copies", "s.*", "least", "size", "opens", "tokens"))
    linked = links(docs, kinds, plan, small, tile, k)
    labels = labelled(linked.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    known = kinds.select("sig", "copies", "least").join(linked.groupBy("sig").agg(F.sum("n").alias("n")), "sig", "left")
    known = known.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    class_id = cut(known.groupBy("label").agg(F.min("least").alias("class_id")))
    known = known.join(class_id, "label").select("sig", "label", "class_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    rows = found.select("doc_id", "digest", "sig", "size")
    return rows.join(known, "sig", "left").select(
        "doc_id", "digest",
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("size") > 0, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"), "label",
    )


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id", "n_links")


def distinct(docs: DataFrame) -> DataFrame:
    """One document of each class, with its own columns. Documents without words all stay."""
    own = docs.columns
    decided = cut(classes(docs))
    least = decided.where(F.col("label").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label", "doc_id", "digest").agg(F.count("*").alias("times"))
    one = least.groupBy("label").agg(F.min(F.struct("digest", "doc_id", "times")).alias("o")).select("o.*")
    wordless = decided.where("label IS NULL").select("digest", "doc_id").distinct().withColumn("times", F.lit(1).cast("long"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), "doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    kept = one.unionByName(wordless)
    stay = packed.alias("p").join(kept.alias("k"), F.col("p.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("p.digest") == F.col("k.digest"))).select("row", "times", "p.digest", "p.doc_id")
    again = stay.where("times > 1").dropDuplicates(["doc_id", "digest"])  # rows repeated whole
    return stay.where("times = 1").select("row.*").unionByName(again.select("row.*"))
