"""Benchmark decontamination with suffix arrays over shards of the training text.

Each shard (a few megabytes of documents inside a task) gets a suffix array over
its words: positions in the order of the words that follow. Every test suffix
(from each word of each item on) is binary-searched in every shard, by its first
13 words, which gives all places where it goes on for a window or more; from
there verbatim matches are followed word by word in both directions to their
full length, and reported with their places in the document and in the item.

Words that no item holds match nothing, so they cut the texts into stretches, and
only stretches of a window's length enter the array; that changes no result. Runs
of 1, 2, 4 and 8 words have numbers in the order of their words, by which the
windows are compared.

The benchmark is dealt to blocks of about `block_words` by a hash of its items,
and one block at a time is read and sent to the tasks; of documents only the
matches are kept from one block to the next, so neither the driver nor a task
holds more than a block. A benchmark of one block takes no shuffle.

Defined cases: null or empty texts, and texts of punctuation only, have no words
and are clean; items without words have no windows; items of fewer than 13 words
are one window; repeated items, documents and ids are judged row by row; items of
null id count for hits, but are not listed; empty tables give no rows, or no
hits; other columns are ignored by `digest` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, buffer, cut, plain, prepare, runs

WINDOW = 13
#: Bytes of words: digits, letters, and every byte of characters beyond ASCII.
INSIDE = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
NO_ID = -(1 << 63)  # of items of null id: they count for hits, but are not listed
HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,place:bigint>>"
_HITS = pa.list_(pa.struct([(c, pa.int64()) for c in ("item_id", "start", "end", "place")]))


def words_of(column: pa.Array) -> Words:
    data, offsets = buffer(column)
    return Words(FOLD[data], offsets, INSIDE)


def find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of the keys in a sorted table; -1 where they aren't in it."""
    if not len(table):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return np.where(table[at] == key, at, -1)


def numbered(a: np.ndarray, b: np.ndarray, table: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of pairs, in their order, by a table of pairs that is made here if there is none; -1 for pairs that aren't in it."""
    key = (a.astype(np.int64) << 32) | b
    whole = (a >= 0) & (b >= 0)
    if table is None:
        table = np.unique(key[whole])
    return np.where(whole, find(table, key), -1), table


class Numbers:
    """Numbers of the windows that begin at words: -1 where a window is in no test, or does not lie within one stretch.

    words: the number of each word; end: where its stretch ends. The tables of pairs are made by the first text, the tests, and used for the others.
    """

    def __init__(self, words: np.ndarray, end: np.ndarray, tables: dict) -> None:
        self.words, self.end, self.tables = words, end, tables
        self.runs = {1: words}

    def pairs(self, at: np.ndarray, first: np.ndarray, size: int, more: np.ndarray, key: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """What is left of the places `at` if `first` (of `size` words) is followed by a run in `more`, and the numbers of both together."""
        fits = at + size < self.end[at]
        at, first = at[fits], first[fits]
        number, table = numbered(first, more[at + size], self.tables.get(key))
        self.tables.setdefault(key, table)
        return at[number >= 0], number[number >= 0]

    def run(self, size: int) -> np.ndarray:
        """For each place the number of the run of `size` words, a power of two."""
        if size not in self.runs:
            half = self.run(size // 2)
            at = np.flatnonzero(half >= 0)
            at, number = self.pairs(at, half[at], size // 2, half, (0, size))
            self.runs[size] = np.full(len(half), -1, np.int32)
            self.runs[size][at] = number
        return self.runs[size]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a window of `size` words in the tests begins, and its number."""
        done = 1 << (size.bit_length() - 1)
        at = np.flatnonzero(self.run(done) >= 0)
        number = self.run(done)[at]
        for bit in range(size.bit_length() - 2, -1, -1):
            if size >> bit & 1:
                at, number = self.pairs(at, number, done, self.run(1 << bit), (size, bit))
                done += 1 << bit
        return at, number


class Tests:
    """The suffixes of a block of items; items of the same words are one."""

    def __init__(self, items: list[tuple[int, str]], window: int) -> None:
        w = words_of(pa.array([t for _, t in items], pa.string()))
        self.ids: list[list[int]] = []
        place: dict[bytes, int] = {}
        parts: list[np.ndarray] = []
        for i, (item, _) in enumerate(items):
            own = w.hash[w.first[i] : w.last[i]]
            if len(own):
                c = place.setdefault(own.tobytes(), len(parts))
                if c == len(parts):
                    parts.append(own)
                    self.ids.append([])
                self.ids[c].append(item)
        size = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(size) - size
        self.item = np.repeat(np.arange(len(parts)), size)
        self.vocabulary, words = np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_inverse=True)
        self.tables: dict = {}
        numbers = Numbers(words, (self.first + size)[self.item], self.tables)
        self.words, self.end = words, numbers.end
        self.least = int(size.min(initial=window))
        #: By size of windows: the suffixes' places in order of their windows and items, and those windows and items.
        self.suffixes = {}
        for n in sorted({min(int(s), window) for s in size}):
            at, number = numbers.windows(n)
            mine = np.minimum(size[self.item[at]], window) == n
            at, number = at[mine], number[mine]
            order = np.lexsort((at, self.item[at], number))
            self.suffixes[n] = (at[order], number[order], self.item[at[order]])

    def matches(self, w: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Verbatim matches of full length in a shard: text, item, first word and end word (counted over the shard), and the first word's place in the item.

        Together they cover every occurrence of each item's windows.
        """
        words = find(self.vocabulary, w.hash)
        inside = words >= 0
        fresh = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | (w.text[1:] != w.text[:-1])])) if len(words) else np.zeros(0, np.int64)
        # A stretch ends before the next word that no item holds, or the next stretch.
        stop = np.concatenate([np.flatnonzero(~inside), [len(words)]])
        ends = np.minimum(stop[np.searchsorted(stop, fresh)], np.concatenate([fresh[1:], [len(words)]])) if len(fresh) else fresh
        long = ends - fresh >= self.least
        fresh, ends = fresh[long], ends[long]
        size = ends - fresh
        own = np.arange(size.sum()) + np.repeat(fresh - np.cumsum(size) + size, size)
        begin, end, kept = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32), np.full(len(words), -1, np.int32)
        kept[own], begin[own], end[own] = words[own], np.repeat(fresh, size), np.repeat(ends, size)
        numbers = Numbers(kept, end, self.tables)
        for size, (places, tests, items) in self.suffixes.items():
            at, number = numbers.windows(size)
            if not len(at):
                continue
            # The suffix array, and the range of it that begins with each test suffix's window.
            array = np.argsort(number, kind="stable")
            at, number = at[array], number[array]
            low, high = np.searchsorted(number, tests, "left"), np.searchsorted(number, tests, "right")
            head = np.concatenate([[True], (tests[1:] != tests[:-1]) | (items[1:] != items[:-1])])  # one search for each window and item
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(tests))
            count = (high - low)[first]
            group = np.repeat(np.arange(len(first)), count)
            start = at[np.arange(count.sum()) + np.repeat(low[first] - np.cumsum(count) + count, count)]
            order = np.lexsort((start, items[first[group]], w.text[start]))
            before, done = None, 0
            for s, g in zip(start[order].tolist(), group[order].tolist(), strict=True):
                key = (int(w.text[s]), int(items[first[g]]))
                if key != before:
                    before, done = key, 0
                if s + size > done:  # not within the match before it
                    a, b, place = max((self._whole(kept, begin, end, s, p, size) for p in places[first[g] : last[g]].tolist()), key=lambda m: (m[1] - m[0], -m[2]))
                    done = b
                    yield (*key, a, b, place)

    def _whole(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, s: int, p: int, size: int) -> tuple[int, int, int]:
        """The match of word s with the test word p, of `size` words, as far as it goes: first word, end word, and place in the item."""
        head = int(self.first[self.item[p]])
        left, right = min(s - int(begin[s]), p - head), min(int(end[s]) - s, int(self.end[p]) - p)
        other = np.flatnonzero(words[s + size : s + right] != self.words[p + size : p + right])
        b = s + size + int(other[0]) if len(other) else s + right
        other = np.flatnonzero(words[s - left : s] != self.words[p - left : p])
        back = left - 1 - int(other[-1]) if len(other) else left
        return s - back, b, p - back - head


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `block_words` words, at eight bytes a word (an item is never cut), one at a time in the driver."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (8 * block_words)) or 1
    for k in range(n):
        own = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(NO_ID if item is None else item, text or "") for item, text in own.select("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = 1_000_000) -> DataFrame:
    """The documents with n_words and `matches`: item, first word, end word and place in the item of each longest verbatim match."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.withColumns({"n_words": F.lit(0).cast("long"), "matches": F.array().cast(HITS)})

    def looked(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Tests(sent.value, window)
            for b in runs(batches, "text", 4 << 20):
                w = words_of(b.column("text"))
                found = b.column("matches").to_pylist()
                for t, item, s, e, place in tests.matches(w):
                    own = [{"item_id": i, "start": s - int(w.first[t]), "end": e - int(w.first[t]), "place": place} for i in tests.ids[item]]
                    found[t] = [*(found[t] or []), *own]
                b = b.set_column(b.schema.get_field_index("n_words"), "n_words", pa.array(w.counts().astype(np.int64)))
                yield b.set_column(b.schema.get_field_index("matches"), "matches", pa.array(found, _HITS))

        return rows.mapInArrow(look, rows.schema)

    earlier, last = None, None
    for items in blocks(plain(benchmark, "item_id", "text"), block_words):
        if last is not None:  # of all blocks but the last only the matches are kept, by text
            hits = looked(docs.select("text", "n_words", "matches"), last).where(F.size("matches") > 0)
            hits = cut(hits.select(_digest().alias("digest"), "matches").dropDuplicates(["digest"]))
            earlier = hits if earlier is None else earlier.unionByName(hits)
        last = items
    if earlier is not None:
        own = docs.columns
        earlier = earlier.groupBy("digest").agg(F.flatten(F.collect_list("matches")).alias("earlier"))
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), _digest().alias("digest")).join(earlier, "digest", "left")
        docs = rows.select(*[F.col(f"row.`{c}`") for c in own if c != "matches"], F.coalesce("earlier", "row.matches").alias("matches"))
    return looked(docs, last)


def _digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _union_length(m):
    """Words that a row's matches cover together: what each one, by start, adds beyond the furthest end so far."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    total = F.aggregate(
        F.array_sort(F.transform(m, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e")))),
        start,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
            F.greatest(a["to"], x["e"]).alias("to"),
        ),
    )
    return total["n"]


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block_words: int = 1_000_000) -> DataFrame:
    """`matches` with n_hit (words in any match), items, and contaminated: a hit, and n_hit at least 1 / share of the words."""
    found = matches(docs, benchmark, window, block_words)
    items = F.array_sort(F.transform(F.array_distinct(F.filter(F.transform("matches", lambda x: x["item_id"]), lambda i: i != NO_ID)), lambda i: i.cast("string")))
    found = found.withColumns({"n_hit": _union_length(F.col("matches")), "items": items})
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = judged(plain(docs, "doc_id", "text"), benchmark)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text"))
    return judged(packed, benchmark).where(~F.col("contaminated")).select("row.*")
