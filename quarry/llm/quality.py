"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over pairs of words. All pairs of all documents labelled good are
counted, but for those of one document in `HELD`, whose perplexities give the
thresholds. Counts, counts of contexts and continuation counts are tables of one
row for each pair or word; the model is made by joins of these tables, and grows
with the trusted text.

A document's probability is a product over its pairs, and the logarithm of each
factor is a sum of what the words alone give and what the pair adds if the model
has it: with g = what is discounted of a context's counts, c = a pair's count, D
its discount and p = the continuation probability of a word,

    log P(w | v) = log(g(v) / c(v)) + log p(w) + log(1 + (c(v, w) - D) / (g(v) p(w)))

So each word and each pair has one value, unknown ones have none, and a document
needs the sum of the values of its words and pairs: a join of the documents'
pairs with the model by the pair. Both sides are sharded by a hash of the pair.
The texts stay where they are: a task sends to each shard the pairs that its
chunk of documents has, each once with the documents it occurs in, and gets
their sums back. Counting, the model's joins and this go on in `PASSES` passes,
each over the pairs of one remainder, which bounds what is shuffled at a time;
tables go as soon as nothing reads them any more. Pairs and words of over `HOT` of all in the documents
are at most 1 / HOT of either, and are looked up by the tasks themselves, so that
no shard is hot. Values are whole numbers, so sums don't depend on their order.

A document is kept if its perplexity is at most the `quantile` of the trusted
documents held out in its language (of all, where a language has none). That is
Spark's `percentile_approx` at an accuracy of 10,000: exact for up to so many
documents held out; beyond, a rank may be off by one in 10,000, and which value it
is can depend on the order in which partial results are merged.

Words are runs of letters, digits and characters beyond ASCII, with A-Z
lower-cased, single characters of East Asian scripts, and runs of other marks.
They are told apart by 48 bits of a hash, pairs by at least as many.

Defined cases: null texts and texts without words have no perplexity and are not
kept; a null language is one of its own; labels of unknown documents are
ignored, a document labelled twice is trusted if any label says so; without
trusted documents everything with words is kept; without held-out ones all
trusted documents give the thresholds; repeated rows are judged alike; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buffer, cut, drop, kept, plain, prepare, runs, shuffle_partitions, span_hash
from quarry.llm.decontamination import FOLD, find

QUANTILE = 0.998
HELD = 5
HOT = 1e-4
PASSES = 3
SHARD = 1 << 19  # values of a shard in a pass, about
CHUNK = 24 << 20  # bytes of text that ask together
MOST = 1 << 21  # pairs that a task gathers before it sends them on
UNIT = 1 << 16  # parts of a bit that values are counted in
START, END = 0, 1  # what stands before the first and after the last word
ANY = END  # no pair begins with END: such pairs stand for the word alone
BITS = 48
MASK = np.uint64((1 << BITS) - 1)
SMALLEST = 0.01  # a discount is never less, so that unknown pairs keep a probability


def _kinds() -> np.ndarray:
    kinds = np.full(256, 2, np.int8)
    kinds[:33] = kinds[127] = 0
    for b in range(128):
        if chr(b).isalnum():
            kinds[b] = 1
    kinds[128:] = 1
    return kinds


KINDS = _kinds()
EAST = range(0xE3, 0xEE)  # lead bytes of kana, ideographs and hangul


def sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts with START and END around them, and the text of each; texts without words have none."""
    data, offsets = buffer(column)
    data = FOLD[data]
    kind = KINDS[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = kind[1:] != kind[:-1]
    east = (data >= EAST.start) & (data < EAST.stop)
    if east.any():  # such a character is a word
        lead = (data & 0xC0) != 0x80
        after = east[np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))]
        fresh[:-1] |= lead & (east | np.concatenate([[False], after[:-1]]))
    fresh[offsets] = True
    starts = np.flatnonzero(fresh[:-1])
    ends = np.append(starts[1:], len(data))
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    h = np.maximum(span_hash(data, starts, ends) >> np.uint64(64 - BITS), np.uint64(END + 1))
    text = np.searchsorted(offsets, starts, side="right") - 1
    head = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    at = np.arange(len(h)) + 2 * np.cumsum(head) - 1
    out = np.full(len(h) + 2 * int(head.sum()), START, np.uint64)
    owner = np.zeros(len(out), np.int64)
    out[at], owner[at] = h, text
    first, last = at[head] - 1, np.append(at[head][1:] - 2, len(out) - 1) if len(h) else at
    out[last] = END
    owner[first], owner[last] = text[head], text[head]
    return out, owner


def codes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for a pair; a context has its upper 48 bits, a word the lower ones."""
    return (v << np.uint64(64 - BITS)) ^ w


def pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, word and text of each pair of neighbours."""
    words, text = sequences(column)
    inside = words[1:] != START
    return words[:-1][inside], words[1:][inside], text[1:][inside]


def count(docs: DataFrame, turn: int = 0, passes: int = 1) -> DataFrame:
    """v (the context, in the upper bits), w and c (how often they are neighbours) over all texts, for the pairs of one pass."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            v, w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, inverse = np.unique(codes(v, w), return_index=True, return_inverse=True)
            return v[at], w[at], np.bincount(inverse, c, len(at)).astype(np.int64)

        def rows(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((v << np.uint64(64 - BITS)).view(np.int64)), pa.array(w.view(np.int64)), pa.array(c)], names=["v", "w", "c"])

        more = 0
        for b in runs(batches, "text"):
            v, w, _ = pairs(b.column("text"))
            mine = codes(v, w) % np.uint64(passes) == turn
            held.append((v[mine], w[mine], np.ones(int(mine.sum()), np.int64)))
            more += len(held[-1][0])
            if more > MOST // 2:
                held, more = [merged()], 0
                if len(held[0][0]) > MOST:
                    yield rows(*held.pop())
        if held:
            yield rows(*merged())

    return docs.select("text").mapInArrow(look, "v long, w long, c long").groupBy("v", "w").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame, c: str = "c") -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many rows have a count of one to four."""
    row = counts.agg(*[F.count_if(F.col(c) == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{i}"] for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(i - (i + 1) * y * b / a, SMALLEST), float(i)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def taken(c: str, d: tuple[float, float, float]):
    """The discount of a count."""
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def model(counts: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame, tuple[float, float, float], float]:
    """From the counts of pairs: for words w, p (continuation probability; null for START), off (discounted of it as a context) and all (its count as one);
    for contexts v, off; the discounts of pairs; and the probability of an unknown word. made gets the paths of tables."""
    contexts = counts.groupBy("v").agg(F.sum("c").alias("all"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3"))
    before, path = kept(counts.groupBy("w").agg(F.count("*").alias("n")))
    made.append(path)
    d, e = discounts(counts), discounts(before, "n")
    contexts, path = kept(contexts.select("v", "all", (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")).alias("off")))
    made.append(path)
    total = before.agg(F.sum("n").alias("n"), F.count("*").alias("words"), F.sum(taken("n", e)).alias("off")).first()
    unknown = total["off"] / total["n"] / (total["words"] + 1)
    p = ((F.col("n") - taken("n", e)) / F.lit(total["n"]) + F.lit(unknown)).alias("p")
    own = contexts.select(F.shiftrightunsigned("v", 64 - BITS).alias("w"), "off", "all")
    words, path = kept(before.select("w", p).join(own, "w", "full"))
    made.append(path)
    return words, contexts.select("v", "off"), d, unknown


class Shards:
    """Where the values of pairs lie: by code a pass, a shard in it, and what tells codes in it apart."""

    def __init__(self, n: int, passes: int) -> None:
        self.passes, self.shards = passes, min(max(n, 1), (1 << (64 - BITS)) - 1)

    def place(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pass of each, and a number that holds its shard above 48 bits of what is left."""
        slots = np.uint64(self.passes * self.shards)
        slot = code % slots
        return slot % np.uint64(self.passes), ((slot // np.uint64(self.passes)) << np.uint64(BITS)) | ((code // slots) & MASK)

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """code and value to a row for each pass and shard."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            code, value = (np.concatenate(x) for x in zip(*held, strict=True))
            turn, key = self.place(code)
            for p in range(self.passes):
                mine = np.flatnonzero(turn == p)
                mine = mine[np.argsort(key[mine])]
                k, v = key[mine], value[mine]
                for s, i, j in slices(k):
                    blob = (k[i:j] & MASK).astype("<u8").tobytes() + v[i:j].astype("<i4").tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([s], pa.int32()), pa.array([blob], pa.binary())], names=["pass", "shard", "blob"])

        for b in batches:
            held.append((b.column("code").to_numpy().view(np.uint64), b.column("value").to_numpy()))
            if sum(len(c) for c, _ in held) > MOST:
                yield from rows()
                held = []
        if held:
            yield from rows()


PACKED = "pass int, shard int, blob binary"


def slices(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard and range of each shard's part of sorted keys."""
    shard = (key >> np.uint64(BITS)).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(key)]
    for i, j in zip(at[:-1], at[1:], strict=True):
        if j > i:
            yield int(shard[i]), i, j


def values(tables: list[tuple[DataFrame, str]], made: list[str]) -> tuple[DataFrame, Shards, float]:
    """The model packed by passes and shards (pass, shard, blob), and the probability of an unknown word.

    tables: the counts of each pass and where they lie; they go on the way. made gets the paths of tables that stay.
    """
    spark, passes = tables[0][0].sparkSession, len(tables)
    counts = reduce(DataFrame.unionByName, [t for t, _ in tables])
    words, contexts, d, unknown = model(counts, made)
    shards = Shards(max(shuffle_partitions(spark), -(-counts.count() // (passes * SHARD))), passes)
    alone = F.coalesce(F.log2(F.col("p") / F.lit(unknown)), F.lit(0.0)) + F.coalesce(F.log2(F.col("off") / F.col("all")), F.lit(0.0))
    single = words.select(F.col("w").bitwiseXOR(F.lit(ANY << (64 - BITS))).alias("code"), F.round(F.lit(float(UNIT)) * alone).cast("int").alias("value"))
    packed = [kept(single.mapInArrow(shards.pack, PACKED))]
    for table, path in tables:
        # What is left of a count over the context's discounted mass; then over the word's probability.
        rest, rest_path = kept(table.join(contexts, "v").select("v", "w", ((F.col("c") - taken("c", d)) / F.col("off")).cast("float").alias("r")))
        drop(spark, path)
        value = F.round(F.lit(float(UNIT)) * F.log2(1 + F.col("r") / F.col("p")))
        both = rest.join(words.select("w", "p"), "w").select(F.col("v").bitwiseXOR(F.col("w")).alias("code"), value.cast("int").alias("value"))
        packed.append(kept(both.mapInArrow(shards.pack, PACKED)))
        drop(spark, rest_path)
    made += [path for _, path in packed]
    return reduce(DataFrame.unionByName, [t for t, _ in packed]), shards, unknown


def all_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words and pairs of the texts, and the text of each."""
    words, text = sequences(column)
    v, w = words[:-1], words[1:]
    inside = w != START
    return np.concatenate([codes(np.uint64(ANY), words), codes(v, w)[inside]]), np.concatenate([text, text[1:][inside]])


def hot(docs: DataFrame, share: float = HOT) -> np.ndarray:
    """The codes that are at least the share of all in the documents, sorted: at most 1 / share.

    A task names those that are half of it in its own part; what is hot in all is hot in parts that hold half of it, which decides up to a factor of two.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in together(runs(batches, "text"), CHUNK, 1 << 20):
            code, n = np.unique(np.concatenate([all_codes(part.column("text"))[0] for part in runs([b], "text")]), return_counts=True)
            much = n >= max(1, share / 2 * n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([None, *code[much].view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n[much].tolist()], pa.int64())], names=["code", "n"])

    counts = cut(docs.select("text").mapInArrow(look, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    total = counts.where("code IS NULL").agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r.code for r in counts.where(F.col("code").isNotNull() & (F.col("n") >= share * total)).select("code").collect()], np.int64).view(np.uint64))


def values_of(packed: DataFrame, shards: Shards, sought: np.ndarray) -> np.ndarray:
    """The values of a few sorted codes; 0 where the model has none."""
    turn, key = shards.place(sought)
    table = {p: (np.flatnonzero(turn == p)[np.argsort(key[turn == p])], np.sort(key[turn == p])) for p in range(shards.passes)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, s, blob in zip(*(b.column(c).to_pylist() for c in ("pass", "shard", "blob")), strict=True):
                own, value = opened([blob])
                places, keys = table[p]
                at = find(keys, own | np.uint64(s << BITS))
                yield pa.RecordBatch.from_arrays([pa.array(places[at[at >= 0]]), pa.array(value[at >= 0].astype(np.int64))], names=["place", "value"])

    out = np.zeros(len(sought), np.int64)
    if len(sought):
        for place, value in packed.mapInArrow(look, "place long, value long").collect():
            out[place] = value
    return out


def opened(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and values of a shard's rows, sorted by code."""
    n = [len(b) // 12 for b in blobs]
    code = np.concatenate([np.frombuffer(b, "<u8", k) for b, k in zip(blobs, n, strict=True)] or [np.zeros(0, np.uint64)])
    value = np.concatenate([np.frombuffer(b, "<i4", k, 8 * k) for b, k in zip(blobs, n, strict=True)] or [np.zeros(0, np.int32)])
    order = np.argsort(code) if len(blobs) > 1 else slice(None)
    return code[order], value[order]


def asked(code: np.ndarray, text: np.ndarray) -> bytes:
    """Sorted codes of 48 bits and the text of each as bytes: how many are different, the ways from one to the next, how often each occurs, and the texts."""
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    step = np.diff(code[head], prepend=np.uint64(0))
    times = np.diff(np.append(head, len(code)))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    wide = next(k for k in ("<u1", "<u2", "<u4") if times.max() <= np.iinfo(k).max)
    front = np.array([len(head), width, np.dtype(wide).itemsize], "<i4").tobytes()
    return front + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + times.astype(wide).tobytes() + text.astype("<u2").tobytes()


def answer(blob: bytes, code: np.ndarray, value: np.ndarray) -> bytes:
    """The sums of the values by text for what a chunk asks a shard."""
    n, width, wide = np.frombuffer(blob, "<i4", 3).tolist()
    step = np.zeros((n, 8), np.uint8)
    step[:, :width] = np.frombuffer(blob, np.uint8, n * width, 12).reshape(n, width)
    times = np.frombuffer(blob, f"<u{wide}", n, 12 + n * width)
    text = np.frombuffer(blob, "<u2", -1, 12 + n * (width + wide))
    at = find(code, np.cumsum(step.view("<u8").ravel()))
    found = np.where(at >= 0, value[at] if len(value) else 0, 0)
    return np.bincount(text, np.repeat(found, times)).astype("<i8").tobytes()


REQUEST = "shard int, kind int, chunk long, blob binary, ids array<bigint>, hashes array<bigint>, base array<bigint>, n_words array<bigint>"
ANSWER = "chunk long, kind int, blob binary, ids array<bigint>, hashes array<bigint>, base array<bigint>, n_words array<bigint>"
_LISTS = ("ids", "hashes", "base", "n_words")


def score(docs: DataFrame, packed: DataFrame, shards: Shards, unknown: float, share: float = HOT) -> DataFrame:
    """doc_id, hash (of the text), n_words and bits (log2 of the probability) of every different row of docs (doc_id, hash, text)."""
    parts = shuffle_partitions(docs.sparkSession)
    often = hot(docs, share)
    worth = values_of(packed, shards, often)
    nothing = round(UNIT * math.log2(unknown))
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary()), *[(c, pa.list_(pa.int64())) for c in _LISTS]])

    def ask(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in together(runs(batches, "text"), CHUNK, 1 << 16):
            chunk += 1
            keys, texts = [], []
            base, n_words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            at = 0
            for part in runs([b], "text"):
                code, text = all_codes(part.column("text"))
                text = text + at
                at += part.num_rows
                pass_, key = shards.place(code)
                if turn == 0:  # what needs no shard
                    pairs_ = np.bincount(text, minlength=b.num_rows)  # 2 n + 3 codes for n words
                    n_words += np.maximum(0, (pairs_ - 3) // 2)
                    base += np.where(pairs_ > 0, ((pairs_ - 3) // 2 + 1) * nothing, 0)
                    place = find(often, code)
                    base += np.bincount(text, np.where(place >= 0, worth[place] if len(worth) else 0, 0), b.num_rows).astype(np.int64)
                    mine = (place < 0) & (pass_ == 0)
                else:
                    mine = pass_ == turn
                    mine[mine] = find(often, code[mine]) < 0
                keys.append(key[mine])
                texts.append(text[mine].astype(np.uint16))
            key, text = np.concatenate(keys), np.concatenate(texts)
            order = np.argsort(key, kind="stable")
            key, text = key[order], text[order]
            for s, i, j in slices(key):
                yield pa.RecordBatch.from_pylist([{"shard": s, "kind": 1, "chunk": chunk, "blob": asked(key[i:j] & MASK, text[i:j])}], schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk % shards.shards], pa.int32()), pa.array([2], pa.int32()), pa.array([chunk]), pa.array([None], pa.binary())]
                + [pa.array([x], pa.list_(pa.int64())) for x in (b.column("doc_id").to_pylist(), b.column("hash").to_pylist(), base, n_words)],
                schema=schema,
            )

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blobs, table = None, [], None
        for b in batches:
            for row in range(b.num_rows):
                s, kind, chunk, blob = (b.column(c)[row].as_py() for c in ("shard", "kind", "chunk", "blob"))
                if s != shard:
                    shard, blobs, table = s, [], None
                if kind == 0:
                    blobs.append(blob)
                    continue
                if kind == 1:
                    if table is None:
                        table, blobs = opened(blobs), []
                    blob = answer(blob, *table)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), *[b.column(c).slice(row, 1) for c in _LISTS]], names=["chunk", "kind", "blob", *_LISTS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sums = None, np.zeros(0, np.int64)
        for b in batches:
            for row in range(b.num_rows):
                c, kind, blob = (b.column(x)[row].as_py() for x in ("chunk", "kind", "blob"))
                if c != chunk:
                    chunk, sums = c, np.zeros(0, np.int64)
                if kind == 1:
                    more = np.frombuffer(blob, "<i8")
                    sums = np.pad(sums, (0, max(0, len(more) - len(sums))))
                    sums[: len(more)] += more
                else:
                    ids, hashes, base, n_words = (b.column(x)[row].values for x in _LISTS)
                    total = base.to_numpy() + np.pad(sums, (0, len(base) - len(sums)))
                    yield pa.RecordBatch.from_arrays([ids, hashes, n_words, pa.array(total)], names=["doc_id", "hash", "n_words", "sum"])

    found = None
    for turn in range(shards.passes):
        left = packed.where(F.col("pass") == turn).select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "blob", *[F.lit(None).cast("array<bigint>").alias(c) for c in _LISTS])
        right = docs.select("doc_id", "hash", "text").mapInArrow(lambda b, turn=turn: ask(b, turn), REQUEST)
        replies = left.unionByName(right).repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(reply, ANSWER)
        sums = replies.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(add, "doc_id long, hash long, n_words long, sum long")
        rows = cut(sums.groupBy("doc_id", "hash").agg(F.max("n_words").alias("n_words"), F.max("sum").alias("sum")))  # rows that repeat whole have the same sum
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("doc_id", "hash").agg(F.sum("n_words").alias("n_words"), (F.sum("sum") / UNIT).alias("bits"))


def together(batches: Iterator[pa.RecordBatch], most: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to about `most` bytes, and at most so many rows."""
    held, size, n = [], 0, 0
    for b in batches:
        if held and (size + b.nbytes > most or n + b.num_rows > rows):
            yield _one(held)
            held, size, n = [], 0, 0
        held.append(b)
        size, n = size + b.nbytes, n + b.num_rows
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def trusted(docs: DataFrame, labels: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The documents with `trusted`: some label says quality 1. The labels are broadcast only where there are few."""
    good = plain(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    good = cut(good)
    if good.count() <= most:
        good = F.broadcast(good)
    return docs.join(good, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, held: int = HELD, passes: int = PASSES, share: float = HOT) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep and held_out (trusted, but not learned from) of every document."""
    prepare(docs.sparkSession)
    docs = trusted(plain(docs, "doc_id", "lang", "text"), labels).withColumn("hash", F.xxhash64("text"))
    docs = docs.withColumn("held_out", F.col("trusted") & (F.pmod(F.hash("doc_id"), F.lit(held)) == 0))
    learned = docs.where("trusted AND NOT held_out AND text IS NOT NULL")
    tables, made = [kept(count(learned, turn, passes)) for turn in range(passes)], []
    if all(t.isEmpty() for t, _ in tables):  # nothing to learn from: every word is as good as another
        packed, shards, unknown = docs.sparkSession.createDataFrame([], PACKED), Shards(1, passes), 1.0
        made += [path for _, path in tables]
    else:
        packed, shards, unknown = values(tables, made)
    scored = score(docs, packed, shards, unknown, share)
    rows = docs.select("doc_id", "lang", "hash", "trusted", "held_out").join(scored.withColumnRenamed("doc_id", "id").withColumnRenamed("hash", "own"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")), "left")
    rows = cut(rows.select("doc_id", "lang", "trusted", "held_out", "n_words", F.when(F.col("n_words") > 0, F.pow(F.lit(2.0), -F.col("bits") / (F.col("n_words") + 1))).alias("perplexity")))
    for path in made:
        drop(docs.sparkSession, path)
    good = rows.where("trusted AND perplexity IS NOT NULL")
    if not (apart := good.where("held_out")).isEmpty():
        good = apart
    limit = good.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("own"))
    overall = good.agg(F.percentile_approx("perplexity", quantile, 10000)).first()[0]
    rows = rows.alias("s").join(limit.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    threshold = F.coalesce("own", F.lit(math.inf if overall is None else float(overall)))
    return rows.select("doc_id", "s.lang", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"), "held_out")
