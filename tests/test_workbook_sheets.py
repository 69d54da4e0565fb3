"""Workbooks whose sheets go on in others."""

import random
import zipfile
import zlib

from waymeter.sources import workbook


def test_full_sheets_are_read_as_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "SHEET_ROWS", 10)
    monkeypatch.setattr(workbook, "PART_ROWS", 4)
    rows = [(n, name, i, [(float(i), None), (None, f"{name} <&>&amp;\r\n {i}"), None, (None, "")]) for n, name, size in ((1, "All", 47), (2, "All +2", 3), (3, "all", 12), (4, "Last", 1)) for i in range(size)]
    path = str(tmp_path / "x.xlsx")
    workbook.save(spark.createDataFrame(rows, workbook.ROWS), path)
    got = {}
    for r in workbook.read(spark, path).orderBy("sheet", "place").collect():
        got.setdefault(r.sheet, []).append((r.place, r.cells))
    want = lambda name, size: [(i, [str(i), f"{name} <&>&amp;\r\n {i}", None, ""]) for i in range(size)]
    assert got == {"All": want("All", 47), "All +2 (2)": want("All +2", 3), "all (2)": want("all", 12), "Last": want("Last", 1)}
    with zipfile.ZipFile(path) as book:
        names = [n for n in book.namelist() if "worksheets" in n]
        assert book.testzip() is None and len(names) >= 9
        assert all(book.read(n).count(b"<row>") <= 10 for n in names)


def test_checksum_of_two_texts():
    draw = random.Random(1)
    for n in (0, 1, 7, 4096, 70001):
        a, b = draw.randbytes(33), draw.randbytes(n)
        assert workbook._checksum(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)
