"""Records, ledgers, candidates, query texts and evaluation by cases."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import sqltext
from quarry.operators import evaluation, records, states
from quarry.operators import relational as op

FIELDS = "doc long, item int, kind string, seq int, name string, value string"


def fields(spark, rows):
    return spark.createDataFrame([(1, item, kind, seq, name, value) for seq, (item, kind, name, value) in enumerate(rows)], FIELDS)


def test_redirect_goes_to_the_first_item_of_the_kind(spark):
    rows = [(1, "pump", "Die width", "9"), (2, "flat_die", "width", "8"), (3, "flat_die", "die lip", "1"), (1, "pump", "oil pressure", "3")]
    got = sorted((r.seq, r.item, r.kind, r.moved_from) for r in records.redirected(fields(spark, rows), [("^die", "flat_die"), ("oil", "station")]).collect())
    assert got == [(0, 2, "flat_die", 1), (1, 2, "flat_die", None), (2, 3, "flat_die", None), (3, 1, "pump", None)]


def test_instances_are_split_by_what_tells_them_apart(spark):
    rows = [(1, "a", "Model 1", "m1"), (1, "a", "Model2", "m2"), (1, "a", "speed 2", "s2"), (1, "a", "colour", "red"), (2, "b", "speed 1", "x"), (2, "b", "speed 2", "y"), (3, "c", "speed 1", "x"), (3, "c", "型号", "p"), (3, "c", "speed 4", "y"), (3, "c", "型号", "q")]
    got = sorted((r.item, r.name, r.value, r.split_from) for r in records.split_instances(fields(spark, rows)).collect())
    assert got == sorted([
        (1, "Model", "m1", 1), (1, "colour", "red", 1), (4, "Model", "m2", 1), (4, "speed", "s2", 1), (4, "colour", "red", 1),
        (2, "speed 1", "x", None), (2, "speed 2", "y", None),
        (3, "speed", "x", 3), (3, "型号", "p", 3), (5, "speed", "y", 3), (5, "型号", "q", 3),
    ], key=lambda r: r[:3])


def test_merge_shapes(spark):
    rows = [(1, "a", "width", "1"), (1, "a", "hole", "x"), (1, "a", "hole", "y"), (1, "a", "zone 3", "c"), (1, "a", "zone 1", "a"), (1, "a", "zone 3", "d"), (1, "a", "year 2024", "z"), (1, "a", "empty", None)]
    got = {r.name: (r.shape, r["values"]) for r in records.merged(fields(spark, rows)).collect()}
    assert got["width"] == ("scalar", ["1"]) and got["hole"] == ("list", ["x", "y"]) and got["zone"] == ("indexed", ["a", None, "d"])
    assert got["empty"] == ("scalar", [None]) and sum(len(v) for _, v in got.values()) < 40
    assert records.merged(fields(spark, [(1, "a", "x", "1")]).limit(0)).count() == 0


def test_terminal_states_in_order(spark):
    base = dict(duplicates=0, canonical_id=None, has_blocks=True, extraction_id=5, extraction_status="done", has_plan=None, normalized_id=7, stale=False, items=2, insert_mode="insert", dictionary_dirty=False, archive_linked=False, archive_status=None, archive_dirty=None, pending=0, review=0)
    schema = "duplicates int, canonical_id long, has_blocks boolean, extraction_id long, extraction_status string, has_plan boolean, normalized_id long, stale boolean, items int, insert_mode string, dictionary_dirty boolean, archive_linked boolean, archive_status string, archive_dirty string, pending int, review int"
    cases = [
        ({}, "normalized_full", "normalized"), ({"duplicates": 2, "canonical_id": 1, "has_blocks": False}, "duplicate_reference", "duplicate"), ({"duplicates": 2}, "normalized_full", "normalized"), ({"has_blocks": None}, "pending_blocks", "uploaded"),
        ({"extraction_id": None}, "pending_extraction", "blocks_ready"), ({"extraction_status": "x needs_reextract y"}, "needs_reextract", "raw_extracted"), ({"normalized_id": None, "has_plan": True}, "planned", "planned"),
        ({"normalized_id": None, "extraction_status": "planned"}, "planned", "planned"), ({"normalized_id": None, "extraction_status": None}, "needs_reextract", "raw_extracted"), ({"stale": True}, "needs_reextract", "raw_extracted"), ({"items": 0}, "normalized_empty", "normalized"),
        ({"insert_mode": "blocked", "dictionary_dirty": True}, "normalized_blocked", "normalized"), ({"dictionary_dirty": True, "archive_linked": True, "archive_status": "archived"}, "normalized_partial", "normalized"), ({"archive_linked": True, "archive_status": "archived", "pending": 3}, "archived", "archived"),
        ({"archive_linked": True, "archive_status": "archived", "archive_dirty": "changed"}, "normalized_full", "normalized"), ({"insert_mode": "partial_insert"}, "normalized_partial", "normalized"), ({"pending": 1}, "normalized_partial", "normalized"), ({"review": 1}, "normalized_partial", "normalized"),
    ]
    df = spark.createDataFrame([tuple((base | c)[k] for k in base) for c, *_ in cases], schema).select(states.terminal_state().alias("s"), states.stage(states.terminal_state()).alias("g")).collect()
    assert [tuple(r) for r in df] == [(s, g) for _, s, g in cases]


def test_issues_sorted_by_confidence(spark):
    row = spark.createDataFrame([("value", "订单", "左侧 a/b", "width", None, False, ["height"])], "kind string, field string, value string, term string, scope string, split boolean, known array<string>")
    got = row.select(states.issues(*[F.col(c) for c in row.columns]).alias("i")).first().i
    assert [i.detector for i in got] == ["cross_term_type", "scope_contamination", "non_config_noise", "qualifier_variant", "composite_value"]
    for value, source, composite in (("钢和铝", None, True), ("钢+铝", None, True), ("10mm;20mm", None, False), ("10mm、20mm", None, True), ("kg/h", None, False), ("12 kg/h", None, True), ("steel", "steel, iron", True), ("", "a,b", False)):
        one = spark.createDataFrame([("value", "field", value, "f", "item", False, None, source)], "kind string, field string, value string, term string, scope string, split boolean, known array<string>, source string")
        assert ("composite_value" in [i.detector for i in one.select(states.issues(*[F.col(c) for c in one.columns]).alias("i")).first().i]) is composite, value
    nothing = spark.createDataFrame([("value", "flow", "3", "flow", "item", None, None)], row.schema)
    assert nothing.select(states.issues(*[F.col(c) for c in row.columns]).alias("i")).first().i == []


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT a.x, b.y AS z FROM dbo.[A] a INNER JOIN B AS b ON a.k = b.k AND a.Id = b.ID WHERE a.x IN (1) AND y LIKE 'q' GROUP BY a.x, b.y HAVING count(*) > 1 ORDER BY 1", {"tables": ["dbo.a", "b"], "joins": [("dbo.a", "b", ["id", "k"])], "selected": ["a.x", "b.y"], "filtered": ["a.x", "y"], "grouped": ["a.x", "b.y"], "ordered": ["1"], "groups": True, "writes": False}),
        ("select * from t -- join hidden\nwhere d = 'from u' and e >= @p and f < ${q}", {"tables": ["t"], "joins": [], "params": ["q", "p"], "macro": True, "statements": 1}),
        ("UPDATE t SET a = 1; DROP TABLE t", {"kind": "unknown", "writes": True, "statements": 2, "selected": []}),
        ("", {"tables": [], "joins": [], "selected": [], "params": [], "statements": 0}),
    ],
)
def test_query_texts(spark, sql, want):
    f = spark.createDataFrame([(sql,)], "s string").select(sqltext.features(F.col("s")).alias("f")).first().f.asDict()
    f["joins"] = [(j.left, j.right, j["keys"]) for j in f["joins"]]
    assert {k: f[k] for k in want} == want


def test_retrieval_figures(spark):
    answers = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (2, 2, "y"), (2, 3, "b"), (3, 1, "z"), (5, 4, "e"), (5, 1, "q")], "query long, rank int, item string")
    gold = spark.createDataFrame([(1, "a", "g"), (2, "b", "g"), (3, None, "g"), (4, None, "g"), (5, "e", "g"), (6, "f", "h")], "query long, item string, lang string")
    got = {r.lang: r for r in evaluation.retrieval(answers, gold, ["lang"]).collect()}
    g = got["g"]
    assert (g.n, g.answered, g.top1_precision, g.top3_recall, g.coverage, g.false_match_rate, g.abstention_correctness) == (5, 4, 0.25, round(2 / 3, 6), 0.8, 0.75, 0.5)
    assert g.mrr == round((1 + 1 / 3 + 1 / 4) / 3, 6) and got["h"].top1_precision is None and got["h"].top3_recall == 0
    delta = evaluation.effect(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), spark.createDataFrame([("a", 1.5), ("c", 1.0)], "k string, v double"), ["k"], ["v"])
    assert sorted(map(tuple, delta.collect())) == [("a", 1.0, 1.5, 0.5), ("b", 2.0, None, None), ("c", None, 1.0, None)]


@pytest.mark.parametrize("parts", [1, 3, 1024])
def test_nearest_rank_of_groups(spark, parts):
    rnd = random.Random(parts)
    rows = [(g, rnd.choice([None, rnd.gauss(0, 10), float(rnd.randrange(4)), 1e9])) for g in ("a", "b", None) for _ in range(rnd.randrange(1, 90))] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    for q in (0.0, 0.5, 0.9, 1.0):
        got = {r.g: r.quantile for r in op.nearest_rank(df, ["g"], "x", q, parts).collect()}
        for g in {g for g, _ in rows}:
            own = sorted((x for h, x in rows if h == g), key=lambda x: (x is not None, x or 0))
            assert got[g] == own[int((len(own) - 1) * q)]
