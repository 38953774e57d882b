"""The workbook source and the report sink: round trips, and no output of a job that fails."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import datasource, files
from quarry.sources.workbooks import read_workbooks


@pytest.fixture(autouse=True)
def registered(spark):
    datasource.register(spark)


def workbook(path, *values):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="One"/></sheets></workbook>')
        rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{v}</v></c></row>' for i, v in enumerate(values, 1))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="m"><sheetData>{rows}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    workbook(tmp_path / "b.xlsx", 1, 2)
    workbook(tmp_path / "in" / "a.xlsx", 3)
    (tmp_path / "c.XLSX").write_bytes(b"no zip")
    (tmp_path / "d.txt").write_text("no")
    df = spark.read.format("quarry_workbooks").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    got = sorted((r.path.rsplit("/", 1)[-1], r.ref or r.kind, r.value) for r in df.collect())
    assert got == [("a.xlsx", "A1", "3"), ("b.xlsx", "A1", "1"), ("b.xlsx", "A2", "2"), ("c.XLSX", "error", None)]
    same = read_workbooks(spark, str(tmp_path)).where("kind = 'cell'")
    assert sorted((r.ref, r.value) for r in same.collect()) == sorted((r.ref, r.value) for r in df.where("kind = 'cell'").collect())
    (tmp_path / "none").mkdir()
    assert spark.read.format("quarry_workbooks").load(str(tmp_path / "none")).count() == 0


def rows(spark):
    return spark.range(0, 20, 1, 4).select("id", F.concat(F.lit("a|b\n"), "id").alias("text"), F.struct(F.col("id").alias("n"), F.lit("é").alias("s")).alias("more"), F.when(F.col("id") > 1, F.to_date(F.lit("2024-01-02"))).alias("day"))


def test_lines_of_json(spark, tmp_path):
    target = tmp_path / "out"
    rows(spark).write.format("quarry_report").mode("append").option("form", "jsonl").save(str(target))
    assert len(list(target.iterdir())) == 4 and [p.name for p in tmp_path.iterdir()] == ["out"]
    back = spark.read.json(str(target))
    assert sorted((r.id, r.text, r.more.s, r.day) for r in back.collect()) == sorted((r.id, r.text, "é", None if r.day is None else "2024-01-02") for r in rows(spark).collect())
    rows(spark).limit(3).write.format("quarry_report").mode("overwrite").option("single", "true").save(str(target))
    assert target.is_file() and [json.loads(x)["id"] for x in target.read_text().splitlines()] == [0, 1, 2] and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_markdown(spark, tmp_path):
    target = tmp_path / "report.md"
    rows(spark).orderBy("id").limit(2).write.format("quarry_report").mode("append").option("form", "markdown").option("single", "true").option("title", "All").save(str(target))
    assert target.read_text().splitlines() == ["# All", "", "| id | text | more | day |", "| --- | --- | --- | --- |", '| 0 | a\\|b 0 | {"n": 0, "s": "é"} |  |', '| 1 | a\\|b 1 | {"n": 1, "s": "é"} |  |']


@pytest.mark.parametrize("single", ["true", "false"])
def test_a_job_that_fails_leaves_nothing_and_what_was_there_stays(spark, tmp_path, single):
    target = tmp_path / "out"
    bad = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise("x").cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("quarry_report").mode("append").option("single", single).save(str(target))
    assert list(tmp_path.iterdir()) == []
    spark.range(2).write.format("quarry_report").mode("append").option("single", "true").save(str(target))
    before = target.read_text()
    with pytest.raises(Exception, match="no"):
        bad.write.format("quarry_report").mode("overwrite").option("single", single).save(str(target))
    assert target.read_text() == before and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="out"):
        spark.range(2).write.format("quarry_report").mode("append").save(str(target))
    assert target.read_text() == before and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_unknown_forms_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="pdf"):
        spark.range(1).write.format("quarry_report").mode("append").option("form", "pdf").save(str(tmp_path / "x"))


def test_formula_queries_of_reports(spark, tmp_path):
    (tmp_path / "r.cpt").write_text(
        '<R><TableData name="q1" class="x"><DatabaseName><![CDATA[erp]]></DatabaseName><Query><![CDATA[select ${a} from t where b = ${a}]]></Query></TableData><TableData name="none"><Query></Query></TableData>'
        "<Formula a='1'> <![CDATA[ select x from y where k='\" + k + \"']]></Formula><Formula><![CDATA[=drop table z]]></Formula></R>"
    )
    got = {(r.kind, r.name): r for r in files.reports(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    q = got["query", "q1"]
    assert (q.query, q.connection, q.parameters, q.flags) == ("select ${a} from t where b = ${a}", "erp", ["a"], ["dynamic_param"])
    f = got["formula_sql", None]
    assert f.query.startswith("select x from y") and f.flags == ["string_concat_like"] and len(got) == 2
