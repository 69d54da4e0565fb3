"""Workbooks as a Spark sink: tasks write compressed parts of sheets, the commit joins them to one file; an abort leaves nothing.

Rows are (sheet_no, sheet, place, cells), a cell a number or a text. Sorted by sheet and place before they are written, each task has
a run of rows, and the parts follow one another. A sheet that is full goes on in another, as far as the format allows, titled with
" +2", " +3" and so on, which :func:`read` takes as one sheet again.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = "sheet_no int, sheet string, place long, cells array<struct<n:double,s:string>>"
#: Rows of a sheet that the format allows, and of a part.
SHEET_ROWS, PART_ROWS = 1_048_576, 65_536
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_UNFIT = "[^\\t\\n\\r\\x{20}-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]"
_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"))
_GOES_ON = re.compile(r"(.*) \+(\d+)", re.DOTALL)


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _rows(cells: pa.Array) -> pa.Array:
    """Each row of cells as XML: a number, else a text, else nothing."""
    each, size = cells.flatten(), pc.fill_null(pc.list_value_length(cells), 0)
    number, said = pc.struct_field(each, "n"), pc.replace_substring_regex(pc.struct_field(each, "s"), _UNFIT, "")
    for raw, entity in _ENTITIES:
        said = pc.replace_substring(said, raw, entity)
    join = lambda *x: pc.binary_join_element_wise(*x, "")
    given = pc.is_valid(number)
    at = pc.if_else(given, pc.subtract(pc.cumulative_sum(given.cast(pa.int32())), 1), None)
    number = join("<c><v>", pa.array([f"{n:.15g}" for n in number.drop_null().to_pylist()], pa.string()).take(at), "</v></c>")
    xml = pc.coalesce(number, join('<c t="inlineStr"><is><t xml:space="preserve">', said, "</t></is></c>"), pa.scalar("<c/>"))
    ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(size).cast(pa.int32())])
    return join("<row>", pc.binary_join(pa.ListArray.from_arrays(ends, xml), ""), "</row>")


def _times(a: int, b: int) -> int:
    """The product of two remainders of the checksum's polynomial, the highest bit for x to the 0."""
    out = 0
    for _ in range(32):
        out ^= b if a & 0x80000000 else 0
        a, b = a << 1 & 0xFFFFFFFF, b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def _checksum(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts, one after the other, of those of each and the second's number of bytes."""
    shift, power = 0x80000000, 0x00800000  # 1, and x to the 8
    while length:
        shift = _times(power, shift) if length & 1 else shift
        power, length = _times(power, power), length >> 1
    return _times(shift, first) ^ second


@dataclass
class Parts(WriterCommitMessage):
    """(sheet_no, sheet, partition, number, name, rows, crc, bytes, compressed bytes) of each part that a task has written."""

    parts: list[tuple[int, str, int, int, str, int, int, int, int]]


class _Part:
    """A part of a sheet, compressed; it ends at a whole byte and doesn't end the stream, so that parts may follow one another."""

    def __init__(self, out) -> None:
        self.out, self.to, self.crc, self.size, self.packed, self.rows = out, zlib.compressobj(6, zlib.DEFLATED, -15), 0, 0, 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.packed += len(data)

    def add(self, xml: pa.Array) -> None:
        data = "".join(xml.to_pylist()).encode()
        self.crc, self.size, self.rows = zlib.crc32(data, self.crc), self.size + len(data), self.rows + len(xml)
        self._put(self.to.compress(data))

    def close(self) -> tuple[int, int, int, int]:
        self._put(self.to.flush(zlib.Z_FULL_FLUSH))
        self.out.close()
        return self.rows, self.crc, self.size, self.packed


class _Zip:
    """A ZIP file of members whose compressed pieces and sums are known, with the wide fields that large ones need."""

    def __init__(self, out) -> None:
        self.out, self.at, self.directory, self.n = out, 0, b"", 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, crc: int, size: int, packed: int) -> None:
        """The head of a member, whose pieces follow."""
        name, at = name.encode(), self.at
        fixed = struct.pack("<HHHHHI", 45, 0x800, 8, 0, 0x21, crc) + b"\xff" * 8
        self.put(b"PK\3\4" + fixed + struct.pack("<HH", len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, packed))
        self.directory += b"PK\1\2\x2d\0" + fixed + struct.pack("<HHHHHII", len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, size, packed, at)
        self.n += 1

    def close(self) -> None:
        begin, size = self.at, len(self.directory)
        self.put(self.directory)
        end = self.at
        self.put(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, self.n, self.n, size, begin) + b"PK\6\7" + struct.pack("<IQI", 0, end, 1))
        self.put(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.stage = path, overwrite, f"{path}.parts-{uuid.uuid4().hex}"
        # made once: a task that still runs after an abort finds no folder to write to
        fs, stage = _store(self.stage)
        fs.create_dir(stage, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        fs, stage = _store(self.stage)
        parts, part, at = [], None, None
        try:
            for batch in iterator:
                number, title, xml = batch["sheet_no"].to_pylist(), batch["sheet"].to_pylist(), _rows(batch["cells"])
                start = 0
                while start < len(number):
                    if part is not None and (at != number[start] or part.rows >= PART_ROWS):
                        parts[-1] += part.close()
                        part = None
                    if part is None:
                        at, name = number[start], f"{partition}-{len(parts)}-{uuid.uuid4().hex}"
                        part = _Part(fs.open_output_stream(f"{stage}/{name}"))
                        parts.append((at, title[start], partition, len(parts), name))
                    end = start + 1
                    while end < len(number) and number[end] == at and part.rows + end - start < PART_ROWS:
                        end += 1
                    part.add(xml[start:end])
                    start = end
            if part is not None:
                parts[-1] += part.close()
                part = None
        finally:
            if part is not None:
                part.out.close()
        return Parts(parts)

    def _sheets(self, messages: list[WriterCommitMessage | None]) -> list[tuple[str, list[tuple]]]:
        """(title, parts) in order; titles are told apart, and fit the format. No title but that of a sheet that goes on reads like one."""
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: (p[0], p[2], p[3]))
        sheets: list[tuple[int, str, list[tuple], int, int]] = []  # number, name, parts, rows, how many sheets it goes on from
        for p in parts:
            no, name, rows = p[0], p[1], p[5]
            if not sheets or sheets[-1][0] != no:
                sheets.append((no, name, [], 0, 0))
            elif sheets[-1][3] + rows > SHEET_ROWS:
                sheets.append((no, name, [], 0, sheets[-1][4] + 1))
            sheets[-1] = (no, name, [*sheets[-1][2], p], sheets[-1][3] + rows, sheets[-1][4])
        out: list[tuple[str, list[tuple]]] = []
        taken, first = set(), ""
        for _, name, own, _, before in sheets:
            if before:
                out.append((f"{first} +{before + 1}", own))
                continue
            base, k = re.sub(r"[\[\]:*?/\\]", " ", name)[:26] or "Sheet", 1
            first = base
            while first.lower() in taken or _GOES_ON.fullmatch(first):
                k += 1
                first = f"{base[: 23 - len(str(k))]} ({k})"
            taken.add(first.lower())
            out.append((first, own))
        return out or [("Sheet", [])]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        sheets = self._sheets(messages)
        numbers = range(1, len(sheets) + 1)
        fs, target = _store(self.path)
        if not self.overwrite and fs.get_file_info(target).type.name != "NotFound":
            self.abort(messages)
            raise FileExistsError(self.path)
        _, stage = _store(self.stage)
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
        small = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{_KIND}.worksheet+xml"/>' for n in numbers) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, (t, _) in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + "</Relationships>",
        }

        def piece(data: bytes, last: bool = False) -> tuple[int, int, bytes]:
            to = zlib.compressobj(6, zlib.DEFLATED, -15)
            return zlib.crc32(data), len(data), to.compress(data) + to.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)

        with fs.open_output_stream(f"{stage}/whole") as out:
            book = _Zip(out)
            for name, text in small.items():
                crc, size, data = piece((head + text).encode(), last=True)
                book.member(name, crc, size, len(data))
                book.put(data)
            for n, (_, parts) in zip(numbers, sheets, strict=True):
                # how many rows there are is said in front, for readers that look at heads alone
                top = piece(f'{head}<worksheet xmlns="{_MAIN}"><dimension ref="A1:A{max(1, sum(p[5] for p in parts))}"/><sheetData>'.encode())
                end = piece(b"</sheetData></worksheet>", last=True)
                crc, size = top[0], top[1]
                for c, k in (*((p[6], p[7]) for p in parts), end[:2]):
                    crc, size = _checksum(crc, c, k), size + k
                book.member(f"xl/worksheets/sheet{n}.xml", crc, size, len(top[2]) + sum(p[8] for p in parts) + len(end[2]))
                book.put(top[2])
                for p in parts:
                    with fs.open_input_stream(f"{stage}/{p[4]}") as rows:
                        while data := rows.read(1 << 22):
                            book.put(data)
                book.put(end[2])
            book.close()
        fs.move(f"{stage}/whole", target)
        fs.delete_dir(stage)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, stage = _store(self.stage)
        for _ in range(3):  # tasks that still run may put a file there meanwhile
            if fs.get_file_info(stage).type.name == "NotFound":
                break
            try:
                fs.delete_dir(stage)
            except OSError:
                continue


class Workbook(DataSource):
    """``df.write.format("workbook").mode("overwrite").save(path)``, in append mode only where no file is."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(Workbook)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def save(rows: DataFrame, path: str) -> None:
    """Writes sheets (:data:`ROWS`) as one workbook; what is at ``path`` is replaced once the new one is whole."""
    register(rows.sparkSession)
    rows.repartitionByRange("sheet_no", "place").sortWithinPartitions("sheet_no", "place").write.format("workbook").mode("overwrite").save(path)


def _sheet_names(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, member) of each sheet, in order."""
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")]
    return [(name, f"xl/worksheets/sheet{n}.xml") for n, name in enumerate(names, 1)]


def _cells(xml: pa.Array) -> pa.Array:
    """Rows as :func:`_rows` makes them, without their ends, as lists of texts."""
    own = pc.split_pattern(pc.replace_substring(pc.replace_substring(xml, "<row>", ""), "<c/>", "<c></c>"), "</c>")
    each, size = own.flatten(), pc.list_value_length(own).to_numpy()
    ends = np.concatenate([[0], np.cumsum(size - 1)])  # behind a row's last cell nothing is left
    kept = np.ones(len(each), bool)
    kept[np.cumsum(size) - 1] = False
    each = each.filter(pa.array(kept))
    said = pc.replace_substring_regex(each, "<[^>]*>", "")
    for raw, entity in reversed(_ENTITIES):
        said = pc.replace_substring(said, entity, raw)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.if_else(pc.equal(each, "<c>"), None, said))


def _parsed(book: zipfile.ZipFile, member: str) -> Iterator[pa.Array]:
    """A sheet's rows, some at a time."""
    with book.open(member) as sheet:
        held, begun = b"", False
        while data := sheet.read(1 << 20):
            held += data
            if not begun:
                if (at := held.find(b"<sheetData>")) < 0:
                    continue
                begun, held = True, held[at + 11 :]
            if (at := held.rfind(b"</row>")) < 0:
                continue
            yield _cells(pc.split_pattern(pa.array([held[:at].decode()]), "</row>").flatten())
            held = held[at + 6 :]


def _row_count(book: zipfile.ZipFile, member: str) -> int:
    """How many rows a sheet of this sink has, by its head."""
    with book.open(member) as sheet:
        return int(re.search(rb'<dimension ref="A1:A(\d+)"/>', sheet.read(1 << 10))[1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, place, cells array<string>) of workbooks that this sink wrote, a sheet of the format a task; a sheet that goes on in others is one, its places counted on."""

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column(0).to_pylist():
                out, last, before = [], None, 0
                fs, at = _store(file)
                with fs.open_input_file(at) as data, zipfile.ZipFile(data) as book:
                    for title, member in _sheet_names(book):
                        said = _GOES_ON.fullmatch(title)
                        if said is None or said[1] != last:
                            last, before = title, 0
                        out.append({"file": file, "sheet": last, "member": member, "before": before})
                        before += _row_count(book, member)
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("sheet", pa.string()), ("member", pa.string()), ("before", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                fs, at = _store(s["file"])
                place = s["before"]
                with fs.open_input_file(at) as data, zipfile.ZipFile(data) as book:
                    for cells in _parsed(book, s["member"]):
                        n = len(cells)
                        yield pa.RecordBatch.from_arrays([pa.array([s["file"]] * n), pa.array([s["sheet"]] * n), pa.array(range(place, place + n), pa.int64()), cells], ["file", "sheet", "place", "cells"])
                        place += n

    found = spark.read.format("binaryFile").load(path).select("path").mapInArrow(sheets, "file string, sheet string, member string, before long")
    return found.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(rows, "file string, sheet string, place long, cells array<string>")
