import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import documents as dj
from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.operators import relational as op
from quarry.operators.matching import assign


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "raw", "want"),
    [
        (tx.alias, " Lip-Gap：A/B ", "lipgapab"),
        (tx.unit_text, "m³ / hour", "m3/h"),
        (tx.boolean, " YES ", True),
        (tx.boolean, "maybe", None),
        (tx.multi_value, "a, b;a ", ["a", "b"]),
        (tx.multi_value, "10 m/h", ["10 m/h"]),
        (tx.selections, "[SEL] red, [SEL] blue, green", ["red", "blue"]),
        (tx.fingerprint, "SELECT TOP 5 * FROM t WHERE d = '2020-01-01' AND n = 'x'", "select top <n> * from t where d = <date> and n = <text>"),
        (tx.redacted, "mail a@b.co token=abc", "mail [email] token=[secret]"),
        (tx.width, "die of 1200 MM", 1200.0),
        (tx.width, "no size", None),
        (tx.summary, "a  b\nc", "a b c"),
        (tx.tokens, "Die 120mm a", ["die", "120mm", "120"]),
        (tx.nfkc, "Ａ①", "A1"),
        (tx.quantity, "二十三", 23),
        (tx.quantity, "none", None),
        (tx.quantity, "３ 台", 3),
        (tx.quantity, "一千零五套", 1005),
        (tx.quantity, "叁佰肆拾柒", 347),
        (tx.quantity, "十 pcs", 10),
        (tx.boolean, "选中", True),
        (tx.boolean, "未选", False),
        (tx.boolean, " 不需要 ", False),
        (tx.unit_text, " μm / hour ", "um/h"),
        (tx.unit_text, "°C", "℃"),
        (tx.unit_text, "米", "m"),
        (tx.unit_text, "kg/每小时左右", "kg/h"),
        (tx.question_tokens, "2024年订单金额 top10", ["2024", "年订单金额", "年订", "订单", "单金", "金额", "top10"]),
        (tx.without_literals, "a 'x''y' /* n\no */ b -- c\nd", "a" + " " * 18 + "b" + " " * 5 + "\nd"),
        (dj.canonical, '{"b": 1, "a": [2]}', '{"a":[2],"b":1}'),
        (dj.canonical, "no json", None),
        (dj.flattened, '{"b": {"c": 1}, "a": ["x"]}', "a[0]: x\nb.c: 1"),
    ],
)
def test_text(spark, f, raw, want):
    assert one(spark, f, raw) == want
    assert one(spark, f, None) in (None, [])


@pytest.mark.parametrize(
    ("raw", "kind", "value", "low", "high", "unit"),
    [("12 mm", "number", 12.0, None, None, "mm"), ("１０～２０ kg", "range", None, 10.0, 20.0, "kg"), ("20-10", "range", None, 10.0, 20.0, ""), ("1.2.3 m", "none", None, None, None, None), ("about 5", "none", None, None, None, None), ("1,200 kW max", "number", 1200.0, None, None, "kw")],
)
def test_number_unit(spark, raw, kind, value, low, high, unit):
    r = one(spark, tx.number_unit, raw)
    assert (r.kind, r.value, r.low, r.high, r.unit) == (kind, value, low, high, unit)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" 3～5 毫米 ", {"kind": "range", "low": 3.0, "high": 5.0, "unit_raw": "毫米", "unit": None, "warnings": ["unit_alias_no_match"], "text": "3-5 毫米"}),
        ("12mm宽度30", {"kind": "number", "value": 12.0, "unit": "mm", "field": "宽度", "field_value": "30", "warnings": ["number_unit_trailing_text"]}),
        ("30的模头正常产量20kg/h左右", {"kind": "none", "warnings": ["number_unit_parse_failed"], "text": "30的模头正常产量20kg/h左右"}),
        ("10－100)转可调/每分钟", {"kind": "range", "low": 10.0, "high": 100.0, "unit_raw": None, "warnings": ["unit_missing", "number_unit_trailing_text"]}),
        ("1.2.3 m", {"kind": "none"}),
        ("no number", {"kind": "none"}),
        ("-5 m3/h", {"kind": "number", "value": -5.0, "unit_raw": "m3/h", "unit": "m3/h", "text": "-5 m³/h", "warnings": []}),
        ("20-10 KG／Hour", {"kind": "range", "low": 10.0, "high": 20.0, "unit": "kg/h", "text": "20-10 kg/h"}),
        ("7 mmx", {"kind": "number", "unit_raw": "mmx", "unit": None}),
        ("", {"kind": "none"}),
    ],
)
def test_measures_with_known_units(spark, raw, want):
    units = F.from_json(F.lit('{"mm": {"canonical": "mm"}, "kg/h": {"canonical": "kg/h"}, "m3/h": {"canonical": "m3/h", "display": "m³/h"}}'), "map<string, struct<canonical: string, display: string>>")
    got = one(spark, lambda c: tx.measure(c, units), raw).asDict()
    assert {k: got[k] for k in want} == want
    assert one(spark, lambda c: tx.measure(c, units), None) is None


def test_patch_and_protect(spark):
    assert one(spark, dj.patched(("a", "b"), 1, frozenset("ab")), '{"a": 3}') == '{"a":{"b":1}}'
    for path in ((), ("x",), ("__proto__",)):
        with pytest.raises(ValueError):
            dj.patched(path, 1, frozenset({"a", "__proto__"}))
    assert one(spark, dj.protected(), '{"api_token": "x", "l": ' + str(list(range(60))) + "}").count(",") == 50


@given(st.text(max_size=12), st.text(max_size=12))
@settings(max_examples=15, deadline=None)
def test_similarity_is_a_share(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(tx.similarity(F.col("a"), F.col("b")).alias("s")).first().s
    assert 0 <= r <= 1 and (r == 1) >= (a == b)


def test_scores(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    got = r.select(sc.cosine(F.col("a"), F.col("b")).alias("x"), sc.cosine(F.col("a"), F.col("z")).alias("y"), sc.cosine(F.col("a"), F.col("s")).alias("w"), sc.mapped_cosine(F.col("a"), F.col("a")).alias("v")).first()
    assert tuple(got) == (0.0, None, None, 1.0)
    assert one(spark, lambda c: sc.rounded(c, 2), 0.125, "double") == 0.13


def test_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([(1, "a", "x", 0.9), (1, "a", "y", 0.8), (1, "b", "x", 0.85), (1, "b", "y", 0.5), (1, "c", "z", 0.4), (2, "a", "x", 0.6)], "g int, l string, r string, s double")
    assert sorted((r.g, r.l, r.r) for r in assign(pairs, "g", "l", "r", "s").collect()) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "x")]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 2, 9)] + [("b", 5)], "g string, v int")
    assert {r.g: r.quantile for r in op.nearest_rank(df, ["g"], "v", 0.5).collect()} == {"a": 2, "b": 5}
    assert {r.g: r.quantile for r in op.nearest_rank(df, ["g"], "v", 1.0).collect()} == {"a": 9, "b": 5}


def test_interval_join_matches_brute_force(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.randrange(3), rnd.randrange(7200)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, s int").withColumn("t", F.timestamp_seconds("s"))
    left, right = df.select("id", "k", "t"), df.select(F.col("id").alias("id2"), F.col("k"), F.col("t").alias("t2"))
    got = {(r.id, r.id2) for r in op.interval_join(left, right, "k", "t", "t2", 900).select("id", "id2").collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] <= a[2] + 900}


def test_names_of_document_fields(spark):
    names = [" 合同编号：", "客户ID", "客户iD ", "客户Id", "a  b :", "：", None, "日期", "订单 号", "X:Y"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(tx.document_field(F.col("n"))).collect()] == ["contract_number", "customer_id", "customer_id", "customer_id", "a_b_", "", "", "order_date", "订单_号", "X:Y"]
