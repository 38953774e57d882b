"""Decision tables, the ladders made of them rung by rung, and the longest alias."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions.aliases import longest_alias, resolve
from quarry.functions.decisions import DecisionTable, Of
from quarry.operators import rules


def test_the_first_rule_that_holds_and_all_that_hold(spark):
    t = DecisionTable(("a", "b"), ("x",), (("one", (("a", "above", 1), ("b", "known", True)), {"x": "1"}), ("two", ([("a", "is", 0), ("a", "at_least", Of("b"))],), {"x": "2"})), {"x": None})
    rows = spark.createDataFrame([(5, 1), (5, None), (0, 9), (None, None), (1, 3), (1, 1)], "a int, b int")
    assert [(r.f.rule, r.f.x, [e.rule for e in r.e]) for r in rows.select(t.first().alias("f"), t.every().alias("e")).collect()] == [
        ("one", "1", ["one", "two"]), ("default", None, []), ("two", "2", ["two"]), ("default", None, []), ("default", None, []), ("two", "2", ["two"]),
    ]


@pytest.mark.parametrize(
    "rules_",
    [
        (("one", (("c", "is", 1),), {"x": 1}),), (("one", (("a", "resembles", 1),), {"x": 1}),), (("one", (("a", "is", Of("c")),), {"x": 1}),), (("one", (("a", "is", 1),), {"y": 1}),),
        (("one", (("a", "is", 1),), {"x": 1}), ("one", (("a", "is", 2),), {"x": 2})), (("all", (), {"x": 1}), ("never", (("a", "is", 1),), {"x": 2})), (("default", (), {"x": 1}),),
    ],
)
def test_tables_that_make_no_sense_are_refused(rules_):
    with pytest.raises(ValueError):
        DecisionTable(("a",), ("x",), rules_, {"x": None})


ISSUE = "array<struct<relation:string,action:string,confidence:double,risk:string>>"
BASE = {"kind": "value", "term_type": "width", "occurrences": 5, "alias_exact": False, "value_kind": None, "blocked": False, "llm": False, "issues": [], "target": None, "target_score": None, "conflict": False, "unified": 0.5}


@pytest.mark.parametrize(
    ("changes", "rule", "route", "action"),
    [
        ({"issues": [("non_config_noise", "mark_non_config", 0.88, "low")]}, "noise", "auto_reject_pending", "mark_non_config"),
        ({"term_type": "application"}, "low_risk_value", "auto_pass", "send_to_review"),
        ({"term_type": "application", "conflict": True, "value_kind": "enum"}, "default", "human_review", "create_new_enum_value_candidate"),
        ({"occurrences": 1}, "rare", "defer_until_more_occurrences", "defer_until_more_occurrences"),
        ({"target": "split_component"}, "part_of_a_value", "human_review", "split_value"),
        ({"target": "exact_alias"}, "exact_value", "auto_accept_pending", "add_alias"),
        ({"target": "exact_alias", "blocked": True, "unified": 0.95}, "sure_but_blocked", "human_review", "add_alias"),
        ({"kind": "term_type", "target": "exact_alias", "unified": 0.95}, "exact_type", "auto_pass", "map_to_existing_termtype"),
        ({"kind": "term_type", "target": "synonym_alias", "unified": 0.95}, "sure_type", "human_review", "map_to_existing_termtype"),
        ({"kind": "term_type", "unified": 0.6}, "middle", "human_review", "create_new_termtype_candidate"),
        ({"target": "synonym_alias", "unified": 0.92}, "sure_value", "auto_accept_pending", "add_alias"),
        ({"unified": 0.55, "llm": True}, "middle_with_model", "llm_review", "send_to_review"),
        ({"unified": 0.54, "llm": True}, "default", "human_review", "send_to_review"),
        ({"issues": [("qualifier_variant", "map", 0.78, "medium")], "unified": 0.6}, "default", "human_review", "map"),
    ],
)
def test_routing(spark, changes, rule, route, action):
    row = BASE | changes
    types = {"kind": "string", "term_type": "string", "occurrences": "int", "alias_exact": "boolean", "value_kind": "string", "blocked": "boolean", "llm": "boolean", "issues": ISSUE, "target": "string", "target_score": "double", "conflict": "boolean", "unified": "double"}
    df = spark.createDataFrame([tuple(row[c] for c in types)], ", ".join(f"{c} {t}" for c, t in types.items()))
    given = {c: F.col(c) for c in ("kind", "term_type", "occurrences", "alias_exact", "value_kind", "blocked", "llm")}
    got = df.select(rules.routed(F.col("issues"), F.col("target"), F.col("target_score"), F.col("conflict"), F.col("unified"), given).alias("o")).first().o
    assert (got.rule, got.route, got.action) == (rule, route, action)
    assert got.score == (row["issues"][0][2] if row["issues"] else row["unified"])


def test_triage(spark):
    rows = [
        ("material", " ", None, None), ("material", "未填写", None, None), ("x", "2024/1/2", None, None), ("x", "HT-12 轴", None, None), ("x", "注意事项", None, None), ("x", "a" * 81, None, None), ("x", "kg/ h", None, None),
        ("product_material", "软PE管", None, None), ("material", "PEX", None, None), ("application", "薄膜 / 板材", None, None), ("usage_x", "管道", "left", True), ("x", "red", "left", False), ("x", None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, v string, q string, r boolean")
    got = [r.o for r in df.select(rules.triaged(F.col("t"), F.col("v"), F.col("q"), F.col("r")).alias("o")).collect()]
    assert [o.note for o in got] == ["placeholder", "placeholder", "document_info", "document_info", "non_config_note", "long_note", *[None] * 6, "placeholder"]
    assert [(o.family, o.domain) for o in got[7:11]] == [("pe", None), (None, None), (None, "film"), (None, "pipe")]
    assert got[6].labels == "" and got[9].parts == ["薄膜", "板材"] and got[9].action == "review_composite"
    assert (got[10].action, got[10].confidence) == ("review_as_existing_value_variant", 0.86) and (got[11].rule, got[11].confidence) == ("unmatched_variant", 0.68)


@pytest.mark.parametrize(
    ("text", "name", "kind", "want"),
    [
        ("吸塑\nRow 2: 制品厚度 0.3-2.5mm", "片材模头", "", ("thermoforming", "flat_die", "sheet", 0.3, 2.5, False, "thermoforming_sheet_standard", "")),
        ("吸塑\nRow 2: 产品有效厚度[B1]: 1～3 毫米\nRow 3: 阻流棒 ☑ 有", "片材模头", "", ("thermoforming", "flat_die", "sheet", 1.0, 3.0, True, "thermoforming_board_with_restrictor", "name_sheet_structure_board")),
        ("热成型 成品厚度 4mm", "板材模头", "flat_die", ("thermoforming", "flat_die", "board", 4.0, 4.0, False, "thermoforming_board_structure_expected", "board_thickness_missing_restrictor_evidence")),
        ("吸塑 制品厚度 2mm", "板材模头", "", ("thermoforming", "flat_die", "board", 2.0, 2.0, False, "thermoforming_sheet_standard", "name_board_structure_sheet")),
        ("吸塑\nRow 3: 阻流棒 [SEL] 无", "模头", "", ("thermoforming", "flat_die", "board_sheet", None, None, False, "thermoforming_unresolved", "")),
        ("阻流棒: 无", "吹膜机头", "", ("", "round_die", "film", None, None, False, "", "")),
        (None, None, None, ("", "unknown", "unknown", None, None, False, "", "")),
    ],
)
def test_die_configuration(spark, text, name, kind, want):
    df = spark.createDataFrame([(text, name, kind)], "t string, n string, k string")
    o = df.select(rules.die_configuration(F.col("t"), F.col("n"), F.col("k")).alias("o")).first().o
    assert (o.application, o.die, o.form, o.thin, o.thick, o.restrictor, o.family, o.conflict) == want


def test_the_longest_alias_wins(spark):
    rnd = random.Random(8)
    aliases = list(dict.fromkeys("".join(rnd.choices("abcd", k=rnd.randint(1, 6))) for _ in range(3000)))
    texts = ["".join(rnd.choices("abcde", k=rnd.randint(0, 30))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(longest_alias(spark, aliases)(F.col("t"))).collect()]
    for t, at in zip(texts, got, strict=True):
        inside = [(-len(a), i) for i, a in enumerate(aliases) if t and a in t]
        assert at == (min(inside)[1] if inside else None)
    assert df.select(longest_alias(spark, [])(F.col("t")).alias("x")).where("x IS NOT NULL").count() == 0


def test_each_rung_of_the_resolver(spark):
    catalogue = [("flat_die", "Flat die", "平模头"), ("flat_die", "Flat die", "模头"), ("filter", "Filter", "换网器"), ("filter", "Filter", "网"), ("long", "Long", "双柱换网"), ("dup", "Dup", "平模头")]
    cat = spark.createDataFrame([(*c, i) for i, c in enumerate(catalogue)], "canonical string, display string, alias string, place int").withColumn("normalised", tx.alias(F.col("alias")))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["平 模头", "快速换网器", "GD-E12", "双柱换网架", "新模头", "模头", "网", None, " ", "nothing"])], "id int, said string").withColumn("x_text", F.lit("own"))
    got = resolve(rows, F.col("said"), tx.alias(F.col("said")), cat, (("GD-E[0-9]+", "pump"), ("快速", "filter")), frozenset({"模头"}), ("模头", "flat_die", "模头"))
    assert [(r.canonical, r.matched, r.method) for r in got.orderBy("id").collect()] == [
        ("flat_die", "平模头", "exact"), ("filter", "快速", "specific_rule"), (None, None, None), ("long", "双柱换网", "contained_alias"), ("flat_die", "模头", "generic_fallback"), ("flat_die", "模头", "exact"),
        (None, None, None), (None, None, None), (None, None, None), (None, None, None),
    ]
