"""Each stage of the pipeline on the rows that the stage before it kept."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontamination, nearjoin, suffixes
from quarry.sources.tables import table


def trimmed_by_force(texts, length=suffixes.LENGTH):
    """What is left of each text without the characters that lie in repeated strings of `length` bytes; blank ones go."""
    raw = {d: t.encode() for d, t in texts.items()}
    count = collections.Counter(t[i : i + length] for t in raw.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in raw.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left, at = [], 0
        for c in texts[d]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if "".join(left).strip(" "):
            out[d] = "".join(left)
    return out


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = docs
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    kept = seen["ngram_jaccard_join"]
    assert nearjoin.classes(kept).where("n_links > 0").count() == 0
    want = nearjoin.classes(seen["language_id"]).select("class_id").distinct().count()
    assert kept.count() == want
    got = {r.doc_id: r.text for r in seen["suffix_dedup"].collect()}
    assert got == trimmed_by_force({r.doc_id: r.text for r in kept.collect()})
    judged = decontamination.digest(seen["suffix_dedup"], table(spark, sf_dir, "benchmark"))
    clean = {r.doc_id for r in judged.where("NOT contaminated").collect()}
    assert {r.doc_id for r in seen["decontamination"].select("doc_id").collect()} == clean and len(clean) < len(got)
    packed = seen["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == seen["decontamination"].count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_run_gives_what_the_stages_give(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    *_, clean, last = chain(spark, table(spark, sf_dir, "documents"), sf_dir, tmp_path)
    rows = sorted(map(tuple, got.select(*pieces).collect()))
    assert rows == sorted(map(tuple, last.select(*pieces).collect()))
    # Each document that the stages kept is there whole, and each sequence has no gap and no more than 1024 ids.
    lengths = collections.Counter()
    for d, _, _, n, _ in rows:
        lengths[d] += n
    assert set(lengths) == {r.doc_id for r in clean.collect()}
    places = collections.defaultdict(list)
    for r in got.collect():
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024


def test_suffix_stage_sees_passages_of_51_words(spark, sf_dir):
    passage = " ".join(f"w{k:03}" for k in range(51))
    assert 252 <= len(passage) < 400
    texts = {1: f"Own start {passage} own end.", 2: f"Another one {passage} and more.", 3: "Nothing that repeats."}
    df = spark.createDataFrame([(d, t, len(t)) for d, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, df, sf_dir).collect()}
    assert got == trimmed_by_force(texts, 240) and passage not in got[1] and passage not in got[2]


def chain(spark, docs, sf_dir, folder):
    """The rows after each stage, each written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_hard_rows_go_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, and columns of names that stages use themselves."""
    some = table(spark, sf_dir, "documents").where("doc_id < 60")
    odd = [(1000, None, "en", None, None), (1001, "", None, "s", 0), (1002, " \n ", "de", "s", 3), (None, None, None, None, None), (1003, "...", "en", "s", 3), (1004, "漢字 текст", "en", "s", 8), (1005, "word " * 30000 + "end", "en", "s", 150003)]
    odd += [(1006, "This row is here three times, and one of them stays.", "en", "s", 52)] * 3 + [(1007, "One id with two texts that differ in all.", "en", "s", 1), (1007, "Der zweite Text hat nichts davon und bleibt.", "de", "s", 1)]
    docs = some.unionByName(spark.createDataFrame(odd, some.schema))
    for name in ("row", "digest", "matches", "hash", "n_words", "label", "speaker", "cut", "class_id", "rank"):
        docs = docs.withColumn(name, F.lit("clash"))
    *stages, last = chain(spark, docs, sf_dir, tmp_path)
    assert all(d.columns == docs.columns for d in stages) and all(d.where("digest <> 'clash' OR `row` <> 'clash' OR matches <> 'clash'").count() == 0 for d in stages)
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in stages]
    assert not {1000, 1001, 1002, 1003, None} & set(ids[0]) and {1004, 1005, 1006, 1007} <= set(ids[0])
    assert ids[0][1006] == 3 and ids[1][1006] == 1 and ids[1][1007] == 2 and ids[3][1007] == 2
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(ids[3])


def test_nothing_goes_through_all_stages(spark, sf_dir, tmp_path):
    assert [d.count() for d in chain(spark, table(spark, sf_dir, "documents").limit(0), sf_dir, tmp_path)] == [0] * 5
