"""Spreadsheets (.xlsx) as rows of cells: a zip of XML parts, read file by file in tasks over `binaryFile` rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet string, kind string, row int, col int, ref string, value string, merged string, hidden boolean, error string"
#: Share and number of cells that sanitising may empty before a file is set aside.
MOST_SHARE, LEAST_CELLS = 0.5, 10
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _place(ref: str) -> tuple[int, int]:
    letters, digits = re.match(r"([A-Z]+)(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits), col


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def cells(path: str, content: bytes) -> list[dict]:
    """The file's cells that aren't empty, by sheet, row and column, then its text boxes; one row with `error` if it can't be read."""
    rows: list[dict] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            shared = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in names else []
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            titles = [(s.get("name"), s.get("state") in ("hidden", "veryHidden")) for s in book.iter() if _local(s.tag) == "sheet"]
            dropped = 0
            for k, (title, sheet_hidden) in enumerate(titles, 1):
                if f"xl/worksheets/sheet{k}.xml" not in names:
                    continue
                sheet = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml"))
                merges = {m.get("ref").split(":")[0]: m.get("ref") for m in sheet.iter() if _local(m.tag) == "mergeCell"}
                found = []
                for r in (x for x in sheet.iter() if _local(x.tag) == "row"):
                    for c in (x for x in r if _local(x.tag) == "c" and x.get("r")):
                        parts = {_local(x.tag): x for x in c}
                        raw = _text(parts["is"]) if "is" in parts else (parts["v"].text or "") if "v" in parts else ""
                        if c.get("t") == "s" and raw:
                            raw = shared[int(raw)]
                        value = _CONTROL.sub("", raw).strip()
                        if not value:
                            dropped += bool(raw.strip())
                            continue
                        row, col = _place(c.get("r"))
                        found.append({"path": path, "sheet": title, "kind": "cell", "row": row, "col": col, "ref": c.get("r"), "value": value, "merged": merges.get(c.get("r")), "hidden": sheet_hidden or r.get("hidden") == "1", "error": None})
                rows += sorted(found, key=lambda x: (x["row"], x["col"]))
            if dropped >= LEAST_CELLS and dropped >= MOST_SHARE * (dropped + len(rows)):
                raise ValueError(f"{dropped} cells are unreadable")
            for name in sorted(n for n in names if re.fullmatch(r"xl/drawings/drawing\d+\.xml", n)):
                for box in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "txBody"):
                    if value := _CONTROL.sub("", _text(box)).strip():
                        rows.append({"path": path, "sheet": name, "kind": "textbox", "row": None, "col": None, "ref": None, "value": value, "merged": None, "hidden": False, "error": None})
    except Exception as e:  # a broken file is a row, not a failed job
        return [{"path": path, "sheet": None, "kind": "error", "row": None, "col": None, "ref": None, "value": None, "merged": None, "hidden": None, "error": f"{type(e).__name__}: {e}"[:300]}]
    return rows


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cell and text box of all .xlsx files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                found = pd.DataFrame(cells(p, bytes(content)), columns=[c.split()[0] for c in CELLS.split(", ")])
                yield found.astype({"row": "Int32", "col": "Int32"})

    return files.mapInPandas(read, CELLS)


def row_blocks(workbook_cells: DataFrame) -> DataFrame:
    """The cells of each row as one line of text: `ref: value` parts in order of columns."""
    parts = F.array_sort(F.collect_list(F.struct("col", F.concat_ws(": ", "ref", "value").alias("part"))))
    rows = workbook_cells.where("kind = 'cell'").groupBy("path", "sheet", "row").agg(parts.alias("parts"))
    return rows.select("path", "sheet", "row", F.array_join(F.transform("parts", lambda p: p["part"]), " | ").alias("line"))
