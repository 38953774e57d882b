"""Removal of repeated passages by sliding spans of sentences.

A sentence ends at `.`, `!` or `?` before white space, or at a line's end; it
counts if it has a word. What repeats is a run of consecutive sentences with at
least `least` words and two sentences; a sentence of `alone` words or more is a
run by itself. Runs are compared by their words (A-Z lower-cased) through a
64-bit hash, over the whole corpus. The first occurrence of a run, by doc_id and
place, stays; sentences that any other occurrence covers go.

Two runs a sentence stand for all: the shortest from it on, and the shortest that
ends at it. Each sentence of a longer run lies in the first of these, or, where
too little follows, in the one that ends where the run does, and both repeat
wherever the run does, at the same place in it. A run that ends at a sentence can
only repeat if the shortest run from its start does, so those are counted
afterwards, for such starts alone.

Hashes are counted with partial sums, so a passage in a third of all documents
is one row from each task. Rows meet the hashes that repeat, and their first
places, by a join. Of hashes that are over 1 / `HOT` of all spans there are
fewer than `HOT`, whatever the corpus, so those are broadcast, and their rows
stay where they are.

Defined cases: null and empty texts have no sentences; runs of the same words
that are split into other sentences are equal only as far as their shortest runs
are; rows repeated whole (same
doc_id and text) count as one document; null ids come first; an empty table
gives no rows; `digest` ignores other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import INVERSE, Words, buffer, cut, mix, plain, powers, prepare, runs
from quarry.llm.decontamination import FOLD, INSIDE

LEAST = 20
ALONE = 20
HOT = 2000  # hashes of more than this share of all spans are joined without a shuffle
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[ord(c) for c in " \t\r\n\f\v"]] = True
END = pa.struct([("h", pa.int64()), ("j", pa.int32())])
SPANS = pa.struct([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("ends", pa.list_(END))])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, and of each sentence with a word: its text, its first word and its end word."""
    words = Words(FOLD[data], offsets, INSIDE)
    after = np.concatenate([data[1:], [ord(" ")]]) if len(data) else data
    ends = np.flatnonzero((_END[data] & _WHITE[after]) | (data == ord("\n"))) + 1
    ends = np.union1d(ends, offsets[1:])  # a text's end ends its sentence
    word_end = np.searchsorted(words.starts, ends)  # words that begin before each end
    word_start = np.concatenate([[0], word_end[:-1]]) if len(word_end) else word_end
    some = word_end > word_start
    first, last = word_start[some], word_end[some]
    return words, words.text[first] if len(first) else first, first, last


def values(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of the words from first to before last, of each pair."""
    h = words.hash
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h) + 1)[: len(h)], out=total[1:])
    return mix((total[last] - total[first]) * powers(len(h) + 1, INVERSE)[first] + (last - first).astype(np.uint64))


def spans(words: Words, text: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs from each sentence on: hash, first sentence and last sentence (indices over all sentences of the run)."""
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64), first, first
    i = np.arange(n)
    j = np.maximum(np.searchsorted(last, first + least), np.where(last - first >= alone, i, i + 1))
    ok = j < n
    i, j = i[ok], j[ok]
    ok = text[i] == text[j]
    i, j = i[ok], j[ok]
    return values(words, first[i], last[j]), i, j


def ending(words: Words, text: np.ndarray, first: np.ndarray, last: np.ndarray, least: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs that end at each sentence, like `spans`, without those that are also the shortest from their start."""
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64), first, first
    j = np.arange(n)
    i = np.minimum(np.searchsorted(first, last - least, side="right") - 1, np.where(last - first >= alone, j, j - 1))
    ok = i >= 0
    i, j = i[ok], j[ok]
    ok = text[i] == text[j]
    i, j = i[ok], j[ok]
    shortest = np.maximum(np.searchsorted(last, first[i] + least), np.where(last[i] - first[i] >= alone, i, i + 1))
    i, j = i[j > shortest], j[j > shortest]
    return values(words, first[i], last[j]), i, j


def scan(docs: DataFrame, least: int, alone: int) -> DataFrame:
    """doc_id, digest and the spans (hash, first and last sentence of the text, and from the same sentence on the `ending` ones) of every row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            words, text, first, last = sentences(*buffer(b.column("text")))
            h, i, j = spans(words, text, first, last, least, alone)
            begin = np.searchsorted(text, np.arange(b.num_rows))
            owner = text[i]
            at = np.searchsorted(owner, np.arange(b.num_rows + 1)).astype(np.int32)
            eh, ei, ej = ending(words, text, first, last, least, alone)  # i rises with j
            ends_at = np.append(np.searchsorted(ei, i), len(ei)).astype(np.int32)
            ends = pa.StructArray.from_arrays([pa.array(eh.astype(np.int64)), pa.array((ej - begin[text[ej]]).astype(np.int32))], fields=list(END))
            fields = [pa.array(h.astype(np.int64)), pa.array((i - begin[owner]).astype(np.int32)), pa.array((j - begin[owner]).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends_at), ends)]
            found = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, fields=list(SPANS)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), found], names=["doc_id", "digest", "spans"])

    return docs.mapInArrow(look, "doc_id long, digest binary, spans array<struct<h:bigint,i:int,j:int,ends:array<struct<h:bigint,j:int>>>>")


def repeating(each: DataFrame, total: int) -> DataFrame:
    """The spans (doc_id, digest, h, i, j, ...) whose hash occurs twice, with `hot`: it is over 1 / HOT of the total."""
    twice = cut(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(twice.where(F.col("n") > total / HOT).select("h"))  # fewer than HOT rows
    cold = twice.where(F.col("n") <= total / HOT).select("h")
    return cut(each.join(hot, "h").withColumn("hot", F.lit(True)).unionByName(each.join(hot, "h", "left_anti").join(cold, "h").withColumn("hot", F.lit(False))))


def after_first(repeated: DataFrame) -> DataFrame:
    """doc_id, digest, i and j of the spans of `repeating` but for the first of each hash."""
    place = F.struct("doc_id", "digest", "i")
    parts = []
    for is_hot in (True, False):
        rows_ = repeated.where(F.col("hot") == is_hot)
        firsts = rows_.groupBy("h").agg(F.min(place).alias("first"))
        later = rows_.join(F.broadcast(cut(firsts)) if is_hot else firsts, "h")
        parts.append(later.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "digest", "i", "j"))
    return parts[0].unionByName(parts[1])


def covered(docs: DataFrame, least: int = LEAST, alone: int = ALONE, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, digest, text), and for those that lose sentences `gone`: runs (i, j) of them. Only if `whole`, the shortest runs that end at a sentence are looked at too."""
    prepare(docs.sparkSession)
    rows = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    found = cut(scan(rows.select("doc_id", "digest", "text"), least, alone))
    total = found.agg(F.sum(F.size("spans"))).first()[0] or 0
    starts = repeating(found.select("doc_id", "digest", F.explode("spans").alias("s")).select("doc_id", "digest", "s.*"), total)
    later = after_first(starts.drop("ends"))
    if whole:
        ends = starts.select("doc_id", "digest", "i", F.explode("ends").alias("e")).select("doc_id", "digest", "i", "e.*")
        later = later.unionByName(after_first(repeating(ends, total)))
    return rows, later.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("i", "j")).alias("gone"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("n_words_removed", pa.int64()), ("text", pa.string()), ("kept_sha256", pa.string())])


def dedup(docs: DataFrame, least: int = LEAST, alone: int = ALONE, whole: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_words_removed, the text that is kept and its SHA-256, of every row."""
    rows, gone = covered(docs, least, alone, whole)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            data, offsets = buffer(b.column("text"))
            words, text, first, last = sentences(data, offsets)
            begin = np.searchsorted(text, np.arange(b.num_rows + 1))
            raw = data.tobytes()
            out: list[tuple] = []
            for t, (doc, runs_) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("gone").to_pylist(), strict=True)):
                n = int(begin[t + 1] - begin[t])
                drop = np.zeros(n, bool)
                for r in runs_ or []:
                    drop[r["i"] : r["j"] + 1] = True
                kept, at = [], int(offsets[t])
                for s in np.flatnonzero(drop).tolist():
                    k = begin[t] + s
                    # A sentence reaches from its first word to the next sentence's, or to the text's end.
                    a = int(words.starts[first[k]])
                    e = int(words.starts[first[k + 1]]) if s + 1 < n else int(offsets[t + 1])
                    kept.append(raw[at:a])
                    at = e
                whole = b"".join([*kept, raw[at : int(offsets[t + 1])]])
                lost = int((last[begin[t] : begin[t + 1]] - first[begin[t] : begin[t + 1]])[drop].sum())
                out.append((doc, n, int(drop.sum()), lost, whole.decode("utf-8", "replace"), hashlib.sha256(whole).hexdigest()))
            yield pa.RecordBatch.from_pydict(dict(zip(RESULT.names, map(list, zip(*out, strict=True)), strict=True)), schema=RESULT)

    null_safe = (F.col("r.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("r.digest") == F.col("g.digest"))
    joined = rows.alias("r").join(gone.alias("g"), null_safe, "left").select("r.doc_id", "text", "gone")
    return joined.mapInArrow(finish, "doc_id long, n_sentences long, n_removed long, n_words_removed long, text string, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """What `dedup` says of every run that repeats, without the text."""
    return dedup(docs, whole=True).drop("text")
