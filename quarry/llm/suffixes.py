"""Removal of long byte strings that occur more than once, by blockwise suffix sorting with difference covers.

Every byte that a string of `length` bytes covers is removed if that string also
starts anywhere else in the corpus. The work goes from coarse to fine, and each
step keeps all that later steps could need:

1. Equal texts are told by their digest; one of them stands for all.
2. Each window of `length` bytes has an anchor: the least hash among its runs of
   `gram` bytes (the leftmost on ties). Equal windows have equal anchors, so only
   windows whose anchor's hash occurs twice can repeat. Windows that repeat within
   a text are found there; of each, one goes on.
3. The bytes around the anchors that occur twice go to buckets by the anchor's
   hash. A task sorts one block of buckets at a time, a few megabytes: the
   suffixes at the positions of a difference cover get ranks by doubling, and each
   window is put in order by what comes before its first cover position, the
   rank there, and its last bytes. Long ties cost no comparison of bytes, and
   memory is that of a block, whatever the input.
4. A bucket with more than `most` places is cut by window starts into pieces. All
   windows of a piece share a core of bytes, so places with different cores part,
   and places whose whole piece is alike are found by counting; only one of each
   kind goes on. What is left is sorted, or, where a core still has more than
   `most` kinds, cut into smaller pieces, down to single windows. No hot bucket
   comes into one task, and no start is given up.

Defined cases: null texts are empty; texts shorter than `length` lose nothing;
repeated rows are copies of each other; an empty table gives no rows; `digest`
and `passages` ignore other columns and `trim` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import INVERSE, buffer, cut, mix, plain, powers, prepare, runs, shuffle_partitions

#: Of the query: its contract.
QUERY_LENGTH, QUERY_GRAM = 400, 200
#: Of a corpus: bytes that a passage of 51 words of prose reaches (252 at the least at sf0.01); lengths are multiples of PERIOD.
LENGTH, GRAM = 240, 120
MOST = 512
SEGMENT = 1 << 22  # window starts looked at together
#: A difference cover modulo 16: each difference is one of two of its members.
PERIOD, COVER = 16, (0, 1, 2, 5, 8)
#: From each residue, the way to the next cover position.
NEXT = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
BLOCK = 3 << 20

SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of the next, and so on."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Of the texts in the data: runs of window starts with one anchor (text, h, a, lo, hi), and starts that repeat within a text (again_text, again)."""
    out: dict[str, list] = {k: [] for k in ("text", "h", "a", "lo", "hi", "again_text", "again")}
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= length)
    if len(long):
        first, count = offsets[long], sizes[long] - length + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[: len(data)], out=total[1:])
        back = powers(len(data) + 1, INVERSE)
        width = length - gram + 1
        found_a, found_g = np.empty(int(count.sum()), np.int64), np.empty(int(count.sum()), np.uint64)
        xs = ranges(first, count)
        low = np.uint64((1 << 24) - 1)
        for at in range(0, len(data) - length + 1, SEGMENT):
            end = min(at + SEGMENT, len(data) - length + 1)  # starts at..end
            n = end - at + width - 1
            g = mix((total[at + gram : at + gram + n] - total[at : at + n]) * back[at : at + n])
            key = (g & ~low) | np.arange(n, dtype=np.uint64)
            span = 1
            while span * 2 <= width:
                key = np.minimum(key[: len(key) - span], key[span:])
                span *= 2
            key = np.minimum(key[: end - at], key[width - span : width - span + end - at])
            i, j = np.searchsorted(xs, at), np.searchsorted(xs, end)
            a = (key[xs[i:j] - at] & low).astype(np.int64)
            found_a[i:j], found_g[i:j] = a + at, g[a]
        text = np.repeat(long, count)
        live = np.ones(len(xs), bool)
        fresh = np.concatenate([[True], (found_a[1:] != found_a[:-1]) | (text[1:] != text[:-1])])
        head = np.flatnonzero(fresh)
        order = np.lexsort((found_g[head], text[head]))
        ht, hg = text[head][order], found_g[head][order]
        for t in np.unique(ht[1:][(ht[1:] == ht[:-1]) & (hg[1:] == hg[:-1])]).tolist():
            i, j = np.searchsorted(text, t), np.searchsorted(text, t, side="right")
            x = xs[i:j]
            w = mix((total[x + length] - total[x]) * back[x])
            _, index, inverse, n = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
            once = np.zeros(j - i, bool)
            once[index] = True
            live[i:j] = once
            again = np.flatnonzero(n[inverse] > 1)
            out["again_text"].append(np.full(len(again), t))
            out["again"].append(x[again] - offsets[t])
        keep = np.flatnonzero(live)
        x, a, t, g = xs[keep], found_a[keep], text[keep], found_g[keep]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (x[1:] != x[:-1] + 1) | (t[1:] != t[:-1])])
        head = np.flatnonzero(fresh)
        last = np.concatenate([head[1:], [len(x)]]) - 1
        base = offsets[t[head]]
        out["text"].append(t[head])
        out["h"].append(g[head].astype(np.int64))
        out["a"].append(a[head] - base)
        out["lo"].append(x[head] - base)
        out["hi"].append(x[last] - base)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def joined(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in a sorted array."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], breaks + 1])], starts[np.concatenate([breaks, [len(starts) - 1]])]


def _lists(text: np.ndarray, n: int, fields: list[np.ndarray], kind: pa.StructType) -> pa.Array:
    """A list of structs for each of n texts, from rows sorted by text."""
    at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(f, kind.field(i).type) for i, f in enumerate(fields)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(at), values)


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """digest, doc_id, hashes of anchors, and spans of starts that repeat within the text, of every row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            data, offsets = buffer(b.column("text"))
            r = anchors(data, offsets, length, gram)
            n = b.num_rows
            order = np.argsort(r["again_text"] * (1 << 32) + r["again"], kind="stable")
            s, e = joined((r["again_text"] * (1 << 32) + r["again"])[order])
            at = np.searchsorted(r["text"], np.arange(n + 1)).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(at), pa.array(r["h"]))
            again = _lists(s >> 32, n, [s & 0xFFFFFFFF, e & 0xFFFFFFFF], SPAN)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("doc_id"), hashes, again], names=["digest", "doc_id", "hashes", "again"])

    return docs.select("digest", "doc_id", "text").mapInArrow(look, "digest binary, doc_id long, hashes array<bigint>, again array<struct<s:int,e:int>>")


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, most significant first."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for i in range(min(8, n)):
        size = len(out[i::8])
        out[i::8] = np.frombuffer(padded[i : i + 8 * size].tobytes(), ">u8")
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 by the keys, most significant first; equal keys have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    step = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        step[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(step)
    return rank


def window_classes(data: np.ndarray, first: np.ndarray, size: np.ndarray, anchor: np.ndarray, bucket: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts in the data (first, size, place of the anchor, bucket): for each window start, its class among equal windows of its bucket, and the class sizes.

    Cover positions count from the anchor, so equal windows of a bucket have equal residues.
    """
    w = words(data)
    start, owner = ranges(first, size), np.repeat(np.arange(len(first)), size)
    left = (first + size)[owner] - start  # bytes to the context's end
    rank = np.full(len(data) + length, -1, np.int64)
    sample = np.isin((start - anchor[owner]) % PERIOD, COVER) & (left >= PERIOD)
    p, room = start[sample], left[sample]
    rank[p] = dense(w[p], w[np.minimum(p + 8, len(w) - 1)])
    depth, deep = PERIOD, length - PERIOD
    while depth < deep:
        step = min(depth, (deep - depth) // PERIOD * PERIOD)
        keep = room >= depth + step
        short = p[~keep]
        p, room = p[keep], room[keep]
        value = dense((rank[p].astype(np.uint64) << np.uint64(32)) | rank[p + step].astype(np.uint64))
        rank[short] = -1
        rank[p] = value
        depth += step
    count = size - length + 1
    x, own = ranges(first, count), np.repeat(np.arange(len(first)), count)
    place = (bucket[own] << 9) + (anchor[own] - x)
    tie = rank[x + NEXT[(x - anchor[own]) % PERIOD]]
    key = (place.astype(np.uint64) << np.uint64(31)) | tie.astype(np.uint64)
    ends = [w[x], w[x + 8], w[x + length - 16], w[x + length - 8]]
    order = np.argsort(key, kind="stable")
    same_key = key[order][1:] == key[order][:-1]
    differs = np.zeros(len(same_key), bool)
    for e in ends:
        s = e[order]
        differs |= s[1:] != s[:-1]
    if (same_key & differs).any():  # ends tell some windows of equal rank apart
        order = np.lexsort((*ends[::-1], key))
        same_key = key[order][1:] == key[order][:-1]
        differs = np.zeros(len(same_key), bool)
        for e in ends:
            s = e[order]
            differs |= s[1:] != s[:-1]
    kind = np.empty(len(x), np.int64)
    kind[order] = np.cumsum(np.concatenate([[0], ~same_key | differs])) if len(x) else 0
    return kind, np.bincount(kind)


def resolve(rows: dict[str, list], length: int) -> dict[str, list]:
    """What repeats among the contexts of whole buckets: digest with runs of window starts s to e."""
    out: dict[str, list] = {c: [] for c in ("digest", "s", "e")}
    buckets: dict[int, dict[tuple[int, bytes], set]] = {}
    for h, digest, a, lo, context in zip(*(rows[c] for c in ("h", "digest", "a", "lo", "context")), strict=True):
        buckets.setdefault(h, {}).setdefault((a - lo, context), set()).add((digest, lo))
    open_: list[list] = []
    for contexts in buckets.values():
        if len(contexts) > 1:
            open_.append(list(contexts.items()))
            continue
        ((_, context), sources) = next(iter(contexts.items()))
        if len(sources) > 1:
            for digest, lo in sources:
                out["digest"].append(digest)
                out["s"].append(lo)
                out["e"].append(lo + len(context) - length)
    if not open_:
        return out
    flat = [(i, shift, context, sources) for i, contexts in enumerate(open_) for (shift, context), sources in contexts]
    data = np.frombuffer(b"".join(c for _, _, c, _ in flat), np.uint8)
    size = np.array([len(c) for _, _, c, _ in flat])
    first = np.cumsum(size) - size
    anchor = first + np.array([s for _, s, _, _ in flat])
    kind, sizes = window_classes(data, first, size, anchor, np.array([i for i, *_ in flat]), length)
    count = size - length + 1
    owner, at = np.repeat(np.arange(len(flat)), count), np.cumsum(count) - count
    repeats = (sizes[kind] > 1) | (np.array([len(s) for *_, s in flat])[owner] > 1)
    for c, (*_, from_) in enumerate(flat):
        s, e = joined(np.flatnonzero(repeats[at[c] : at[c] + count[c]]))
        for digest, lo in from_:
            out["digest"] += [digest] * len(s)
            out["s"] += (s + lo).tolist()
            out["e"] += (e + lo).tolist()
    return out


def sort_blocks(rows: DataFrame, length: int) -> DataFrame:
    """The repeated starts of buckets (digest, s, e), sorted a block of buckets at a time; rows of hot buckets (salt not null) pass as they are."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {c: [] for c in ("h", "digest", "a", "lo", "context")}
        held, last = 0, None
        passed: dict[str, list] = {c: [] for c in FOUND.names}

        def flush() -> pa.RecordBatch:
            found = resolve(waiting, length)
            nothing = [None] * len(found["digest"])
            out = {c: [*found.get(c, nothing), *passed[c]] for c in FOUND.names}
            for v in (*waiting.values(), *passed.values()):
                v.clear()
            return pa.RecordBatch.from_pydict(out, schema=FOUND)

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in CONTEXT.names], strict=True):
                h, salt, digest, a, lo, context = row
                if held >= BLOCK and h != last:
                    yield flush()
                    held = 0
                last, held = h, held + len(context)
                if salt is None:
                    for v, x in zip(waiting.values(), (h, digest, a, lo, context), strict=True):
                        v.append(x)
                else:
                    for v, x in zip(passed.values(), (digest, None, None, h, a, lo, context), strict=True):
                        v.append(x)
        if held:
            yield flush()

    parts = shuffle_partitions(rows.sparkSession)
    dealt = rows.select(*CONTEXT.names).repartition(parts, "h", "salt").sortWithinPartitions("h", "salt")
    return dealt.mapInArrow(sort, "digest binary, s int, e int, h long, a int, lo int, context binary")


def cut_hot(hot: DataFrame, length: int, gram: int, most: int) -> list[DataFrame]:
    """The repeated starts of hot buckets (h, digest, a, lo, context), by cutting them into smaller and smaller pieces."""
    found: list[DataFrame] = []
    step = max(1, (length - gram + 1) // 4)
    hot = cut(hot.dropDuplicates(["h", "digest", "a", "lo"]))
    while not hot.isEmpty():

        def pieces(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: dict[str, list] = {c: [] for c in PIECE.names}
                for h, digest, a, lo, context in zip(*[b.column(c).to_pylist() for c in ("h", "digest", "a", "lo", "context")], strict=True):
                    hi = lo + len(context) - length
                    for p in range((a - hi) // step, (a - lo) // step + 1):  # starts lie p * step to p * step + step - 1 before the anchor
                        x1, x2 = max(lo, a - p * step - step + 1), min(hi, a - p * step)
                        core = context[a - p * step - lo : a - p * step - step + 1 + length - lo]
                        own = context[x1 - lo : x2 + length - lo]
                        kind = hashlib.blake2b(own, digest_size=16, key=(a - x1).to_bytes(4, "big")).digest()
                        for c, v in zip(PIECE.names, (h, p, hashlib.blake2b(core, digest_size=16).digest(), kind, digest, a, x1, x2, own), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=PIECE)

        rows = cut(hot.mapInArrow(pieces, "h long, p int, core binary, kind binary, digest binary, a int, lo int, hi int, context binary"))
        key = ["h", "p", "core"]
        kinds = cut(rows.groupBy(*key, "kind").agg(F.count("*").alias("n"), F.min("digest").alias("one")))
        several = kinds.groupBy(*key).agg(F.count("*").alias("kinds")).where("kinds > 1")
        found.append(rows.join(kinds.where("n > 1"), [*key, "kind"]).select("digest", F.col("lo").alias("s"), F.col("hi").alias("e")))
        left = rows.join(kinds, [*key, "kind"]).where(F.col("digest") == F.col("one")).join(several, key)
        left = cut(left.select(F.xxhash64(*key, F.lit(step)).alias("h"), "kinds", "digest", "a", "lo", "context"))
        found.append(sort_blocks(left.where(F.col("kinds") <= most).withColumn("salt", F.lit(None).cast("int")), length).select("digest", "s", "e"))
        if step == 1:  # single windows of one core are of one kind
            break
        hot, step = left.where(F.col("kinds") > most).drop("kinds"), step // 2
    return found


def spans(docs: DataFrame, length: int = QUERY_LENGTH, gram: int = QUERY_GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The rows with a digest of their text (`digest`), and for each digest what to remove: rows (of that text), speaker (their least doc_id), again and found (runs of window starts)."""
    if length % PERIOD or not PERIOD <= gram <= length:
        raise ValueError(f"length is a multiple of {PERIOD}, and gram at most as long")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("").cast(docs.schema["text"].dataType))).withColumn("digest", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    scanned = scan(docs, length, gram)
    texts = cut(scanned.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.first("hashes").alias("hashes"), F.first("again").alias("again")))
    each = texts.select("digest", F.explode("hashes").alias("h"))
    twice = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # A text asks for its anchors by their hashes; where they lie is found again in the text, which is cheaper than to send it.
    wanted = each.join(twice, "h").groupBy("digest").agg(F.collect_set(F.struct("h", "n")).alias("wanted"))
    wanted = wanted.join(texts.select("digest", F.coalesce("doc_id", F.lit(-1)).alias("speaker")), "digest")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            data, offsets = buffer(b.column("text"))
            r = anchors(data, offsets, length, gram)
            begin = np.searchsorted(r["text"], np.arange(b.num_rows + 1))
            raw, out = data.tobytes(), {c: [] for c in CONTEXT.names}
            for t, (digest, wanted_) in enumerate(zip(b.column("digest").to_pylist(), b.column("wanted").to_pylist(), strict=True)):
                seed, base, times = int.from_bytes(digest[:3], "big"), int(offsets[t]), {w["h"]: w["n"] for w in wanted_}
                mine = slice(begin[t], begin[t + 1])
                for h, a, lo, hi in zip(*(r[c][mine].tolist() for c in ("h", "a", "lo", "hi")), strict=True):
                    n = times.get(h)
                    if n:
                        for c, v in zip(CONTEXT.names, (h, seed if n > most else None, digest, a, lo, raw[base + lo : base + hi + length]), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=CONTEXT)

    # Of equal texts the one of the least doc_id speaks; rows that repeat it whole give equal contexts, which a bucket counts once.
    one_each = docs.withColumn("speaker", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["digest", "speaker"]).select("digest", "text", "wanted")
    rows = one_each.mapInArrow(contexts, "h long, salt int, digest binary, a int, lo int, context binary")
    found = cut(sort_blocks(rows, length))
    parts = [found.where("context IS NULL").select("digest", "s", "e"), *cut_hot(found.where("context IS NOT NULL").select("h", "digest", "a", "lo", "context"), length, gram, most)]
    by_text = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    return docs, texts.select("digest", F.col("n").alias("rows"), F.coalesce("doc_id", F.lit(-1)).alias("speaker"), "again").join(by_text, "digest", "left")


CONTEXT = pa.schema([("h", pa.int64()), ("salt", pa.int32()), ("digest", pa.binary()), ("a", pa.int32()), ("lo", pa.int32()), ("context", pa.binary())])
FOUND = pa.schema([("digest", pa.binary()), ("s", pa.int32()), ("e", pa.int32()), ("h", pa.int64()), ("a", pa.int32()), ("lo", pa.int32()), ("context", pa.binary())])
PIECE = pa.schema([("h", pa.int64()), ("p", pa.int32()), ("core", pa.binary()), ("kind", pa.binary()), ("digest", pa.binary()), ("a", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("context", pa.binary())])


def removed(n_bytes: int, rows: int, again: list | None, found: list | None, length: int) -> list[tuple[int, int]]:
    """The maximal byte ranges to remove from a text."""
    if n_bytes < length:
        return []
    if rows > 1:
        return [(0, n_bytes)]
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["s"], r["e"] + length) for r in [*(again or []), *(found or [])]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def counted(doc: int, text: bytes, gone: list[tuple[int, int]]) -> tuple:
    """A row of `digest`."""
    kept, at = hashlib.sha256(), 0
    for s, e in gone:
        kept.update(text[at:s])
        at = e
    kept.update(text[at:])
    return doc, len(text), sum(e - s for s, e in gone), len(gone), kept.hexdigest()


def digest(docs: DataFrame, length: int = QUERY_LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, info = spans(plain(docs, "doc_id", "text"), length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            out: list[tuple] = []
            for doc, text, n, again, found in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), *(b.column(c).to_pylist() for c in ("rows", "again", "found")), strict=True):
                out.append(counted(doc, text, removed(len(text), n, again, found, length)))
            yield pa.RecordBatch.from_pydict(dict(zip(OUT.names, map(list, zip(*out, strict=True)), strict=True)), schema=OUT)

    return rows.join(info, "digest").select("doc_id", "text", "rows", "again", "found").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def passages(docs: DataFrame, length: int = QUERY_LENGTH, gram: int = QUERY_GRAM, shorter: int = LENGTH, shorter_gram: int = GRAM) -> DataFrame:
    """`digest`, and n_passage: the bytes of repeated strings of `shorter` bytes.

    Strings of `length` bytes are sought only within those, as all shorter ones in a string that repeats do so too.
    """
    rows, info = spans(plain(docs, "doc_id", "text"), shorter, shorter_gram)
    info = cut(info)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            out: dict[str, list] = {"owner": [], "at": [], "text": []}
            for owner, text, *found in zip(b.column("digest").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), *(b.column(c).to_pylist() for c in ("rows", "again", "found")), strict=True):
                for s, e in removed(len(text), *found, shorter):
                    if e - s >= length:
                        for c, v in zip(out, (owner, s, text[s:e]), strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["owner"], pa.binary()), pa.array(out["at"], pa.int32()), pa.array(out["text"], pa.binary())], names=list(out))

    one_each = rows.withColumn("speaker", F.coalesce("doc_id", F.lit(-1))).join(info, ["digest", "speaker"])
    pieces = one_each.select("digest", "text", "rows", "again", "found").mapInArrow(take, "owner binary, at int, text binary")
    inner, inside = spans(cut(pieces.withColumn("doc_id", F.monotonically_increasing_id())), length, gram)
    parts = inner.select("owner", "at", F.octet_length("text").alias("size"), "digest").join(inside, "digest")
    parts = parts.groupBy("owner").agg(F.collect_list(F.struct("at", "size", "rows", "again", "found")).alias("parts"))
    info = info.drop("speaker").join(parts, F.col("digest") == F.col("owner"), "left").drop("owner")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            out: list[tuple] = []
            for doc, text, n, again, found, own in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), *(b.column(c).to_pylist() for c in ("rows", "again", "found", "parts")), strict=True):
                if n > 1:
                    gone = removed(len(text), n, None, None, length)
                else:
                    gone = sorted((s + x["at"], e + x["at"]) for x in own or [] for s, e in removed(x["size"], x["rows"], x["again"], x["found"], length))
                wider = sum(e - s for s, e in removed(len(text), n, again, found, shorter))
                out.append((*counted(doc, text, gone), wider))
            yield pa.RecordBatch.from_pydict(dict(zip(WIDER.names, map(list, zip(*out, strict=True)), strict=True)), schema=WIDER)

    columns = ("doc_id", "text", "rows", "again", "found", "parts")
    return rows.join(info, "digest").select(*columns).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")


WIDER = OUT.append(pa.field("n_passage", pa.int64()))


def trim(docs: DataFrame, length: int = QUERY_LENGTH, gram: int = QUERY_GRAM) -> DataFrame:
    """The documents with repeated strings removed from `text`; a character is removed only if all its bytes are."""
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id"), F.col("text"), F.col("text").isNull().alias("none"))
    rows, info = spans(packed, length, gram)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            texts = []
            for text, n, again, found in zip(b.column("text").cast(pa.binary()).to_pylist(), *(b.column(c).to_pylist() for c in ("rows", "again", "found")), strict=True):
                at, kept = 0, []
                for s, e in removed(len(text), n, again, found, length):
                    while s < e and text[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(text[at:s])
                    at = e
                texts.append(b"".join([*kept, text[at:]]).decode())
            yield b.select(["row", "none"]).append_column("cut", pa.array(texts, pa.string()))

    joined_ = rows.join(info, "digest").select("row", "none", "text", "rows", "again", "found")
    schema = joined_.select("row", "none").withColumn("cut", F.lit("").cast("string")).schema
    done = joined_.mapInArrow(finish, schema)
    return done.select(*[F.when(~F.col("none"), F.col("cut")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own])
