"""Language identification in two levels: the family first, then pairs of languages within it.

Features are hashed runs of one to four bytes of the lower-cased text, as shares
of all runs. A linear model for each family (one against the rest) picks the
family; within it, one-versus-one linear support vector machines vote, and the
sum of their margins breaks ties. All models are trained here by averaged
stochastic sub-gradient steps on the hinge loss.

They are fitted on at most `per_language` documents of each language, those of
the smallest hash of doc_id and text, from the documents with a label, and on at
`most` in all; this bounds what reaches the driver, and it is the only
place where a sample is taken. Every text
is read whole when it is judged, in batches whose runs are gathered by
vectorised lookups.

Defined cases: null texts and texts without a letter are `und` with score 0;
labels that are null are never learned; without labelled documents everything
is `und`; languages of no listed family are families of their own; repeated rows
are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import buffer, cut, plain, prepare, runs

#: Families of common languages by their ISO 639-1 codes.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
BITS = 13
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"


def family_of(language: str) -> str:
    return next((f for f, names in FAMILIES.items() if language in names), f"only {language}")


def hashed(data: np.ndarray) -> list[np.ndarray]:
    """For each order n, the feature of the n bytes from each position on; the last n - 1 positions of the data run on into zeros."""
    padded = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    value = np.zeros(len(data), np.uint32)
    found = []
    for n in range(1, max(ORDERS) + 1):
        value = value * np.uint32(0x01000193) + padded[n - 1 : n - 1 + len(data)] + np.uint32(n)
        if n in ORDERS:
            found.append(((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
    return found


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts, each followed by a space that ends its last word."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return buffer(pc.binary_join_element_wise(pc.utf8_lower(column), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())))


class Rows:
    """Feature shares of texts, of which few are not zero: the features of text i and their values lie at at[i] to at[i + 1]."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.at = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        self.index = np.concatenate([i for i, _ in rows] or [np.zeros(0, np.uint16)])
        self.value = np.concatenate([v for _, v in rows] or [np.zeros(0, np.float16)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among `rows`, feature and value of all that is not zero there."""
        n = self.at[rows + 1] - self.at[rows]
        place = np.arange(n.sum()) + np.repeat(self.at[rows] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(rows)), n), self.index[place], self.value[place].astype(np.float64)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the features that it has and their shares: square roots of counts, of length 1."""
    data, offsets = lowered(column)
    found = hashed(data)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        counts = sum(np.bincount(h[a:b], minlength=1 << BITS) for h in found)
        index = np.flatnonzero(counts)
        out.append((index.astype(np.uint16), np.sqrt(counts[index] / max(1, counts.sum())).astype(np.float16)))
    return out


def svm(x: Rows, own: np.ndarray, y: np.ndarray, rounds: int = 12, penalty: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine for y in -1, 1 of the rows `own`: weights and bias, averaged over the steps after the first round."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    w, b, sums, sum_b, steps, t = np.zeros(size), 0.0, np.zeros(size), 0.0, 0, 0
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    for r in range(rounds):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            t += 1
            rate = 1 / (penalty * (t + 1000))
            place, index, value = x.take(own[rows])
            bad = y[rows] * (np.bincount(place, value * w[index], len(rows)) + b) < 1
            w *= 1 - rate * penalty
            if bad.any():
                pull = np.where(bad, np.where(y[rows] > 0, share[1], -share[-1]), 0) * (rate / len(rows))
                w += np.bincount(index, pull[place] * value, size)
                b += 0.01 * pull.sum()
            if r:
                sums += w
                sum_b += b
                steps += 1
    return (sums / steps, sum_b / steps) if steps else (w, b)


class Model:
    """Families, their one-against-the-rest weights, and the one-versus-one weights of the pairs in each."""

    def __init__(self, x: Rows, languages: list[str]) -> None:
        names = np.array(languages)
        self.languages = sorted(set(languages))
        self.families = sorted({family_of(v) for v in self.languages})
        of = np.array([family_of(v) for v in languages])
        weights, biases = [], []

        def add(rows: np.ndarray, y: np.ndarray) -> int:
            w, b = svm(x, rows, y)
            weights.append(w)
            biases.append(b)
            return len(weights) - 1

        every = np.arange(len(names))
        self.family_row = {f: add(every, np.where(of == f, 1, -1)) for f in self.families} if len(self.families) > 1 else {}
        self.pair_row = {}
        for f in self.families:
            own = [v for v in self.languages if family_of(v) == f]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    rows = np.flatnonzero((names == a) | (names == b))
                    self.pair_row[a, b] = add(rows, np.where(names[rows] == a, 1, -1))
        self.weights = np.array(weights, np.float32).reshape(len(weights), 1 << BITS)
        self.biases = np.array(biases)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and score in 0 to 1 from a row of margins for each text."""
        n = len(margins)
        at = {v: i for i, v in enumerate(self.languages)}
        by_family = np.stack([margins[:, self.family_row[f]] for f in self.families], 1) if self.family_row else np.ones((n, 1))
        family = by_family.argmax(1)
        votes, sums = np.full((n, len(at)), -1.0), np.zeros((n, len(at)))
        for v in self.languages:
            votes[family == self.families.index(family_of(v)), at[v]] = 0
        least = np.full(n, np.inf)
        for (a, b), row in self.pair_row.items():
            here = family == self.families.index(family_of(a))
            m = np.where(here, margins[:, row], 0)
            votes[:, at[a]] += here & (m >= 0)
            votes[:, at[b]] += here & (m < 0)
            sums[:, at[a]] += m
            sums[:, at[b]] -= m
            least = np.where(here, np.minimum(least, np.abs(m)), least)
        best = (votes + sums / (1 + np.abs(sums).max(1, keepdims=True, initial=0)) * 0.5).argmax(1)
        sure = np.minimum(by_family.max(1), np.where(np.isinf(least), by_family.max(1), least))
        return best, 1 / (1 + np.exp(-np.clip(3 * sure, -30, 30)))


def margins(column: pa.Array, weights: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Weights times the features of each whole text.

    Features are square roots of counts, so each text's counts are gathered first.
    """
    data, offsets = lowered(column)
    n = len(column)
    out, norm = np.zeros((n, len(weights))), np.zeros(n)
    counts = np.zeros(1 << BITS, np.int64)
    found = hashed(data)
    for i in range(n):
        counts[:] = 0
        a, b = offsets[i], offsets[i + 1]
        for h in found:
            counts += np.bincount(h[a:b], minlength=1 << BITS)
        at = np.flatnonzero(counts)
        root = np.sqrt(counts[at])
        out[i] = weights[:, at] @ root
        norm[i] = np.sqrt(counts[at].sum())
    return out / np.where(norm > 0, norm, 1)[:, None] + biases


def sample(docs: DataFrame, per_language: int, most: int) -> DataFrame:
    """At most `per_language` labelled documents of each label, and `most` in all: those of the least hash.

    A label's counts say below which hash about half as many again as wanted lie, so that the ranks are over few rows, however many tasks there are.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    common = cut(docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most))
    low = F.col("hash") / F.lit(float(2**63)) <= 3.0 * per_language / F.col("n") - 1  # hashes are even over -1 to 1
    few = labelled.select("lang", "hash").join(F.broadcast(common), "lang").where(low)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    places = few.select("lang", "hash").withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = cut(places.orderBy("rank", "lang", "hash").limit(most).select("lang", "hash").distinct())
    # Rows that repeat whole have one hash; one of them is enough to learn from.
    found = labelled.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"])
    return found.select("lang", "text")


def fit(docs: DataFrame, per_language: int = 600, most: int = 20_000) -> Model | None:
    """A model from labelled documents (doc_id, text, lang), or None if there are none."""
    prepare(docs.sparkSession)

    def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("lang"), *[pa.array([r[k].tobytes() for r in x], pa.binary()) for k in (0, 1)]], names=["lang", "features", "shares"])

    rows = sample(docs, per_language, most).mapInArrow(as_features, "lang string, features binary, shares binary").toLocalIterator()
    names, x = [], []
    for lang, i, v in rows:
        names.append(lang)
        x.append((np.frombuffer(i, np.uint16), np.frombuffer(v, np.float16)))
    if not names:
        return None
    order = sorted(range(len(names)), key=lambda i: (names[i], x[i][0].tobytes(), x[i][1].tobytes()))  # whatever order the rows came in
    return Model(Rows([x[i] for i in order]), [names[i] for i in order])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with lang_pred and score; only the column `text` is looked at."""
    prepare(docs.sparkSession)
    names = np.array(["" if model is None else v for v in (model.languages if model else [""])], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in runs(batches, "text"):
            text = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.zeros(len(text), np.int64), np.zeros(len(text))
            if model is not None and len(model.weights):
                best, score = model.decide(margins(text, model.weights, model.biases))
            elif model is not None:
                score[:] = 1.0
            known = letters & (model is not None)
            yield b.append_column("lang_pred", pa.array(np.where(known, names[best], UNDETERMINED), pa.string())).append_column("score", pa.array(np.where(known, score, 0.0)))

    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema
    return docs.mapInArrow(judge, schema)


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    docs = plain(docs, "doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    judged = predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The documents whose language can be told, with their own columns."""
    own = docs.columns
    model = fit(plain(labelled, "doc_id", "text", "lang"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("text"))
    return predict(packed, model).where(F.col("lang_pred") != UNDETERMINED).select("row.*")
