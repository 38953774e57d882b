"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import collections
import math
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import queries
from quarry.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "null" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([value(r[i]) for i in order] for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nfkc_is_of_the_whole_text(spark, tmp_path):
    rows = [(1, "Ｆｕｌｌ ｗｉｄｔｈ １２", None), (2, "ﬁne oﬃce ①", "src0"), (3, None, "src0"), (4, "plain", "ｓ")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.normal for r in queries.QUERIES["nfkc_normalise"](spark, str(tmp_path)).collect()}
    assert got == {d: t and unicodedata.normalize("NFKC", t) for d, t, _ in rows}


def test_greedy_assignment_keeps_every_line(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'A'")
    lines = lines.join(spark.read.parquet(f"{sf_dir}/part.parquet"), lines.l_partkey == F.col("p_partkey"), "left_semi")
    want = collections.Counter(map(tuple, lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()))
    got = queries.QUERIES["greedy_assignment"](spark, sf_dir).collect()
    # A line is at its best with one of its own kind and quantity, so each is taken, once.
    assert collections.Counter((r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey) for r in got) == want
    assert len({(r.l_orderkey, r.clue) for r in got}) == len({(r.l_orderkey, r.line) for r in got}) == len(got)
    assert len({k[:2] for k in want}) < len(got)


def test_the_core_stands_alone():
    """Nothing outside the subpackage `llm` imports it."""
    from pathlib import Path

    root = Path(queries.__file__).parents[1]
    for f in [*root.rglob("*.py")]:
        if f.relative_to(root).parts[0] != "llm":
            assert "quarry.llm" not in f.read_text(), f
