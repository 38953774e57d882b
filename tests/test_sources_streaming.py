from pyspark.sql import functions as F

from quarry.sources import files
from quarry.streaming import state


def test_csv_tsv_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, y"\nbad,z\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string").cache()
    assert [(r.id, r.name, r._corrupt is None) for r in rows.collect()] == [(1, "x, y", True), (None, "z", False)]
    df = spark.createDataFrame([(1, "a\tb\nc")], "id int, name string")
    files.write_tsv(df, str(tmp_path / "t"))
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "t"), "id int, name string").select("id", "name").collect()] == [(1, "a b c")]
    files.write_report(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_listing_and_seal(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "r.cpt").write_text('<R><TableData name="q1"><Query><![CDATA[select ${a} from t where b = ${a}]]></Query></TableData></R>')
    (tmp_path / "x.txt").write_text("no")
    found = files.listing(spark, str(tmp_path), "cpt")
    row = found.first()
    sealed = spark.createDataFrame([("r.cpt", row.length, row.sha256), ("gone.cpt", 1, "x"), ], "name string, length long, sha256 string")
    assert {r.name: r.status for r in files.verify(found, sealed).collect()} == {"r.cpt": "ok", "gone.cpt": "missing"}
    xml = spark.read.format("binaryFile").load(str(tmp_path / "d"))
    got = files.reports(xml).first()
    assert (got.name, got.query, got.parameters) == ("q1", "select ${a} from t where b = ${a}", ["a"])


def _events(spark, folder, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, status string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_upsert_stream(spark, tmp_path):
    folder = _events(spark, str(tmp_path / "e"), [[(1, "2024-01-01 00:00:00", 1, "new", 5.0), (2, "2024-01-01 00:01:00", 2, "new", None)], [(3, "2023-12-31 00:00:00", 1, "late", None), (4, "2024-01-01 00:02:00", 2, "done", 7.0)]])
    versions = {}

    def write(df, number):
        path = str(tmp_path / f"s{number}")
        df.write.mode("overwrite").parquet(path)
        versions[number] = path

    read = lambda: spark.read.parquet(versions[max(versions)]) if versions else None
    stream = state.read_events(spark, folder)
    q = stream.writeStream.foreachBatch(state.upserts(read, write, "user_id", "event_id", ["value"], ["status"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in read().select("user_id", "status", "value").collect()) == [(1, "late", 5.0), (2, "done", 7.0)]


def test_idempotent_and_followup_streams(spark, tmp_path):
    folder = _events(spark, str(tmp_path / "e"), [[(1, "2024-01-01 00:00:00", 1, "a", 1.0), (1, "2024-01-01 00:00:30", 1, "a", 1.0), (2, "2024-01-01 00:20:00", 1, "b", 1.0), (3, "2024-01-01 02:00:00", 1, "c", 1.0)]])
    q = state.idempotent(state.read_events(spark, folder), ["event_id"]).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 3
    first, second = state.read_events(spark, folder), state.read_events(spark, folder)
    q = state.followups(first, second, "user_id").writeStream.format("memory").queryName("follow").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.first_event, r.next_event) for r in spark.table("follow").collect()} >= {(1, 2)}


def test_sessions(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:10:00", 1), (3, "2024-01-01 02:00:00", 1)], "event_id int, ts string, user_id int").withColumn("ts", F.to_timestamp("ts"))
    assert [r.session for r in state.sessions(df, "user_id", 30).orderBy("event_id").collect()] == [1, 1, 2]


def test_workbooks(spark, tmp_path):
    import zipfile

    from quarry.sources.workbooks import read_workbooks, row_blocks

    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="m"><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Name</t></si><si><r><t>Two </t></r><r><t>parts</t></r></si></sst>')
        z.writestr(
            "xl/worksheets/sheet1.xml",
            '<worksheet xmlns="m"><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c><c r="A1" t="s"><v>0</v></c></row><row r="2" hidden="1"><c r="AA2"><v>3.5</v></c><c r="AB2" t="inlineStr"><is><t> </t></is></c></row></sheetData>'
            '<mergeCells><mergeCell ref="A1:A3"/></mergeCells></worksheet>',
        )
        z.writestr("xl/drawings/drawing1.xml", '<d xmlns="x"><txBody><t>Note</t></txBody></d>')
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    got = read_workbooks(spark, str(tmp_path)).cache()
    assert [(r.kind, r.ref, r.col, r.value, r.merged, r.hidden) for r in got.where("error IS NULL").orderBy("kind", "row", "col").collect()] == [
        ("cell", "A1", 1, "Name", "A1:A3", False), ("cell", "B1", 2, "Two parts", None, False), ("cell", "AA2", 27, "3.5", None, True), ("textbox", None, None, "Note", None, False),
    ]
    assert got.where("kind = 'error'").count() == 1
    assert [r.line for r in row_blocks(got).orderBy("row").collect()] == ["A1: Name | B1: Two parts", "AA2: 3.5"]
