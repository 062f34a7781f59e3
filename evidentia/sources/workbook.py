"""A spreadsheet workbook of many frames: tasks write the rows of sheets, a commit puts them together.

Each task streams its partition into compressed parts of a sheet in a folder that all nodes share, and reports them; a task that is lost leaves parts that no commit names. The commit
copies parts into one file, a piece at a time, and gives the file its name last, so a reader sees a whole workbook or none. No frame is collected, and memory does not grow with
rows; the file itself is one, so it is for results that people open. A frame with more rows than a sheet may have becomes several sheets, and the dashboard says so.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

from ..operators.exports import flat

#: Rows of a sheet with its header, and characters of a cell, that the format allows (fixed values).
SHEET_ROWS, CELL = 1_048_576, 32_767
#: Rows that widths are taken from, and the least and largest width (fixed values).
SAMPLE, NARROW, WIDE = 200, 12, 70
#: Numbers of styles in ``_STYLES``.
HEADER, PERCENT, DECIMAL, TITLE, METRIC, WARNING = range(1, 7)
_NAMESPACE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_STYLES = f"""{_HEAD}<styleSheet xmlns="{_NAMESPACE}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0%"/></numFmts>
<fonts count="5"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font><font><b/><sz val="20"/><color rgb="FF18212F"/><name val="Calibri"/></font>
<font><b/><sz val="14"/><name val="Calibri"/></font><font><sz val="11"/><color rgb="FF7F6000"/><name val="Calibri"/></font></fonts>
<fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{"".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in ("18212F", "E8EEF6", "FFF2CC"))}</fills>
<borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="7"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" applyAlignment="1"><alignment vertical="center" wrapText="1"/></xf><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="2" applyNumberFormat="1"/>
<xf fontId="2" applyFont="1"/><xf fontId="3" fillId="3" borderId="1" applyFont="1" applyFill="1" applyBorder="1"/><xf fontId="4" fillId="4" applyFont="1" applyFill="1"/></cellXfs>
<dxfs count="1"><dxf><font><color rgb="FF7F6000"/></font><fill><patternFill><bgColor rgb="FFFFF2CC"/></patternFill></fill></dxf></dxfs></styleSheet>"""


def style_of(column: str) -> int:
    """Shares in percent, confidences and weights with two digits, all else plain."""
    if "probability" in column or column == "evidence_score":
        return PERCENT
    return DECIMAL if "confidence" in column or "weight" in column else 0


def cell(value: object, style: int = 0) -> str:
    """A cell: numbers and truth values as such, null empty, all else text, cut where the format ends; characters that XML has not are spelled as the format spells them."""
    s = f' s="{style}"' if style else ""
    if value is None:
        return f"<c{s}/>"
    if isinstance(value, bool):
        return f'<c{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c{s}><v>{value!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", str(value)[:CELL])
    return f'<c{s} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: files with their rows, and the lengths of its first rows' cells."""

    place: int = 0
    files: list[tuple[str, int]] = field(default_factory=list)
    lengths: list[list[int]] = field(default_factory=list)


class _PartWriter(DataSourceWriter):
    def __init__(self, schema: StructType, folder: str, most: int):
        self.columns, self.folder, self.most = schema.names, folder, most

    def write(self, rows: Iterator[Row]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        part, styles, out = Part(TaskContext.get().partitionId()), [style_of(c) for c in self.columns], None
        try:
            for row in rows:
                if out is None or part.files[-1][1] >= self.most:
                    if out is not None:
                        out.close()
                    part.files.append((f"{self.folder}/{uuid.uuid4().hex}.gz", 0))
                    out = gzip.open(part.files[-1][0], "wt", 3, "utf-8", newline="")
                out.write(f"<row>{''.join(map(cell, row, styles))}</row>")
                part.files[-1] = (part.files[-1][0], part.files[-1][1] + 1)
                if len(part.lengths) < SAMPLE:
                    part.lengths.append([0 if v is None else len(str(v)) for v in row])
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        lengths = [x for m in parts for x in m.lengths][:SAMPLE]
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/manifest.json", "w") as f:
            json.dump({"columns": self.columns, "files": [x for m in parts for x in m.files], "lengths": lengths}, f)

    def abort(self, messages: list[Part | None]) -> None:
        for path, _ in (x for m in messages if m is not None for x in m.files):
            if os.path.exists(path):
                os.remove(path)


class SheetParts(DataSource):
    """``df.write.format("sheet_parts").option("folder", ...)``: parts of a sheet and their manifest; ``most``: rows of a part at most."""

    @classmethod
    def name(cls) -> str:
        return "sheet_parts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _PartWriter(schema, self.options["folder"], int(self.options.get("most", SHEET_ROWS - 1)))


def letters(i: int) -> str:
    """The name of a column, from 0."""
    return (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def _groups(files: list, most: int) -> list[list]:
    """Parts in order, so many to a sheet as fit; an empty frame has one sheet."""
    out, left = [[]], most
    for path, n in files:
        if n > left:
            out.append([])
            left = most
        out[-1].append((path, n))
        left -= n
    return out


def _table_names(columns: list[str]) -> list[str]:
    """A table's columns differ in any case: later ones get a number."""
    seen: set[str] = set()
    out = []
    for c in columns:
        name, k = c or "column", 2
        while name.lower() in seen:
            name, k = f"{c}{k}", k + 1
        seen.add(name.lower())
        out.append(name)
    return out


def _sheet(book: zipfile.ZipFile, number: int, held: dict, files: list, urgent: bool) -> None:
    columns, rows = (_table_names(held["columns"]), sum(n for _, n in files)) if files else (["message"], 1)
    lengths = held["lengths"] if files else [[len("No records")]]
    area = f"A1:{letters(len(columns) - 1)}{rows + 1}"
    sizes = [min(WIDE, max(NARROW, *(len(c) + 2, *(x[i] + 2 for x in lengths)))) for i, c in enumerate(columns)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1" style="{style_of(c)}"/>' for i, (c, w) in enumerate(zip(columns, sizes, strict=True), 1))
    with book.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as out:
        out.write(f'{_HEAD}<worksheet xmlns="{_NAMESPACE}" xmlns:r="{_RELATIONS}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols>'.encode())
        out.write(f"<sheetData><row>{''.join(cell(c, HEADER) for c in columns)}</row>".encode())
        if not files:
            out.write(f"<row>{cell('No records')}</row>".encode())
        for path, _ in files:
            with gzip.open(path, "rb") as part:
                shutil.copyfileobj(part, out, 1 << 20)
        warned = f'<conditionalFormatting sqref="A2:{area[3:]}"><cfRule type="notContainsBlanks" dxfId="0" priority="1"><formula>LEN(TRIM(A2))&gt;0</formula></cfRule></conditionalFormatting>' if urgent else ""
        out.write(f'</sheetData>{warned}<tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>'.encode())
    quoted = [escape(c, {'"': "&quot;", "\n": "_x000a_"}) for c in columns]
    named = "".join(f'<tableColumn id="{i}" name="{c}"/>' for i, c in enumerate(quoted, 1))
    book.writestr(f"xl/tables/table{number}.xml", f'{_HEAD}<table xmlns="{_NAMESPACE}" id="{number}" name="Table{number}" displayName="Table{number}" ref="{area}"><autoFilter ref="{area}"/><tableColumns count="{len(columns)}">{named}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>')
    book.writestr(f"xl/worksheets/_rels/sheet{number}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/table" Target="../tables/table{number}.xml"/></Relationships>')


def _dashboard(title: str, metrics: dict[str, object], notes: list[str]) -> str:
    line = lambda *cells: f"<row><c/>{''.join(cells)}</row>"
    body = ["<row/>", line(cell(title, TITLE)), "<row/>", *(line(cell(k, METRIC), cell(v, PERCENT if isinstance(v, float) else 0)) for k, v in metrics.items()), "<row/>", *(line(cell(n, WARNING)) for n in notes)]
    return f'{_HEAD}<worksheet xmlns="{_NAMESPACE}"><sheetPr><tabColor rgb="FFFF4B55"/></sheetPr><sheetViews><sheetView tabSelected="1" workbookViewId="0"/></sheetViews><cols><col min="2" max="2" width="38" customWidth="1"/><col min="3" max="3" width="26" customWidth="1"/></cols><sheetData>{"".join(body)}</sheetData></worksheet>'


def write(frames: dict[str, DataFrame], path: str, title: str, metrics: dict[str, object], notes: tuple[str, ...] = (), urgent: tuple[str, ...] = ("Review Queue",), most: int = SHEET_ROWS - 1) -> dict[str, int]:
    """Writes ``path`` (on a file system that all nodes share) with a sheet for each frame and a dashboard that opens first; returns each frame's rows.

    Containers become JSON, dates and decimals that are no plain numbers text. Metrics that are floats are shares in percent. Sheets' names are cut to 31 characters and must then
    differ. Frames named in ``urgent`` are coloured where not blank. A frame without rows says ``No records``; one without columns is an error. An earlier file stays until the new one is whole.
    """
    if not frames:
        raise ValueError("no frames")
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    held, counts, sheets = {}, {}, []
    try:
        for k, (name, df) in enumerate(frames.items()):
            if not df.columns:
                raise ValueError(f"{name} has no columns")
            df.sparkSession.dataSource.register(SheetParts)
            # what is neither number nor truth value is text as Spark writes it
            plain = flat(df)
            plain = plain.select(*(plain[f"`{f.name}`"] if f.dataType.simpleString() == "boolean" or isinstance(f.dataType, NumericType) and not f.dataType.simpleString().startswith("decimal") else plain[f"`{f.name}`"].cast("string").alias(f.name) for f in plain.schema.fields))
            plain.write.format("sheet_parts").option("folder", f"{folder}/{k}").option("most", most).mode("append").save()
            with open(f"{folder}/{k}/manifest.json") as f:
                held[name] = json.load(f)
            counts[name] = sum(n for _, n in held[name]["files"])
            groups = _groups(held[name]["files"], most)
            sheets += [(name if i == 0 else f"{name[:24]} ({i + 1})", name, g) for i, g in enumerate(groups)]
            if len(groups) > 1:
                notes = (*notes, f"{name}: {counts[name]} rows on {len(groups)} sheets.")
        titles = [re.sub(r"[\[\]:*?/\\]", " ", t)[:31] for t, _, _ in sheets] + ["Dashboard"]
        if len({t.lower() for t in titles}) < len(titles):
            raise ValueError(f"sheets with one name: {titles}")
        made, last = f"{folder}/book", len(titles)
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED, compresslevel=3) as book:
            for number, (_, name, files) in enumerate(sheets, 1):
                _sheet(book, number, held[name], files, name in urgent)
            book.writestr(f"xl/worksheets/sheet{last}.xml", _dashboard(title, metrics, list(notes)))
            listed = "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, t in enumerate(titles, 1))
            book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_NAMESPACE}" xmlns:r="{_RELATIONS}"><bookViews><workbookView activeTab="{last - 1}"/></bookViews><sheets>{listed}</sheets></workbook>')
            targets = "".join(f'<Relationship Id="rId{i}" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, last + 1))
            book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{targets}<Relationship Id="rId{last + 1}" Type="{_RELATIONS}/styles" Target="styles.xml"/></Relationships>')
            book.writestr("xl/styles.xml", _STYLES)
            book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kinds = "".join(f'<Override PartName="/xl/{p}.xml" ContentType="{_KIND}.{t}+xml"/>' for p, t in [("workbook", "sheet.main"), ("styles", "styles"), *((f"worksheets/sheet{i}", "worksheet") for i in range(1, last + 1)), *((f"tables/table{i}", "table") for i in range(1, last))])
            book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>')
        os.replace(made, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return counts
