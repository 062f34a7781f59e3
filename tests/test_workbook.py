"""Workbooks read back by a plain reader of their XML."""

import glob
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from evidentia.sources import workbook

N = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read(path):
    """name -> rows of values."""
    out = {}
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        for member in z.namelist():
            ElementTree.fromstring(z.read(member))
        for i, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).findall(".//s:sheet", N), 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).findall(".//s:row", N):
                cells = []
                for c in row.findall("s:c", N):
                    v, t = c.find("s:v", N), c.find("s:is/s:t", N)
                    spelled = None if t is None else re.sub("_x([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), t.text or "")
                    cells.append(spelled if t is not None else None if v is None else bool(int(v.text)) if c.get("t") == "b" else float(v.text))
                rows.append(cells)
            out[s.get("name")] = rows
    return out


def test_read_back(spark, tmp_path):
    odd = 'a <b> & "c" \u0001 _x0041_  ü\n\t水 '
    rows = [(1, 0.25, True, odd, ["x", None]), (2, float("nan"), None, "", None), (None, -1e300, False, None, [])]
    df = spark.createDataFrame(rows, "n long, total_weight double, ok boolean, text string, held array<string>").coalesce(1)
    path = str(tmp_path / "book.xlsx")
    counts = workbook.write({"Products": df, "Empty": df.where("n > 5")}, path, "Title", {"Company": "A & B", "Coverage": 0.5}, ("Note",))
    assert counts == {"Products": 3, "Empty": 0}
    found = read(path)
    assert list(found) == ["Products", "Empty", "Dashboard"]
    assert found["Products"] == [["n", "total_weight", "ok", "text", "held"], [1, 0.25, True, odd, '["x",null]'], [2, "nan", None, "", None], [None, -1e300, False, None, "[]"]]
    assert found["Empty"] == [["message"], ["No records"]]
    assert [r[1:] for r in found["Dashboard"] if r] == [["Title"], ["Company", "A & B"], ["Coverage", 0.5], ["Note"]]
    assert glob.glob(f"{path}.parts-*") == []
    sheet = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert f'<col min="2" max="2" width="14" customWidth="1" style="{workbook.DECIMAL}"/>' in sheet and "frozen" in sheet


@pytest.mark.parametrize("parts", [1, 5])
def test_frames_above_a_sheet(spark, tmp_path, parts):
    df = spark.range(0, 95, 1, parts).select("id", F.concat(F.lit("row "), "id").alias("text"))
    path = str(tmp_path / "book.xlsx")
    workbook.write({"Review Queue": df}, path, "T", {}, most=30)
    found = read(path)
    names = [n for n in found if n != "Dashboard"]
    assert names[0] == "Review Queue" and len(names) in (4, 5) and all(len(found[n]) <= 31 for n in names)
    assert [r for n in names for r in found[n][1:]] == [[float(i), f"row {i}"] for i in range(95)]
    assert any(f"95 rows on {len(names)} sheets" in str(r) for r in found["Dashboard"])
    assert "notContainsBlanks" in zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()


def test_failures_leave_the_earlier_file(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    workbook.write({"A": spark.range(3)}, path, "T", {})
    bad = spark.range(4).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        workbook.write({"A": spark.range(9), "B": bad}, path, "T", {})
    assert len(read(path)["A"]) == 4 and glob.glob(f"{path}.parts-*") == []
    with pytest.raises(ValueError):
        workbook.write({"A": spark.range(1), "a": spark.range(1)}, path, "T", {})
    with pytest.raises(ValueError):
        workbook.write({}, path, "T", {})


def test_names():
    assert [workbook.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert workbook._table_names(["a", "A", "", "a2"]) == ["a", "A2", "column", "a22"]
    assert [workbook.style_of(c) for c in ("posterior_probability", "evidence_score", "weight_kg", "name")] == [workbook.PERCENT, workbook.PERCENT, workbook.DECIMAL, 0]
