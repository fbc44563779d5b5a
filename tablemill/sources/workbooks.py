"""Workbooks (XLSX): sheets as frames, and frames as workbooks in a binary column.

Workbooks are bounded by their format (1,048,576 rows a sheet) and by `max_cells`. Spark reads
them as binary files and a task decodes each; the driver sees names, a header and a few counts.
Writing cuts the ordered rows into workbooks of at most ROWS rows, one row of bytes for each, to
be written by any Spark sink. Existing workbooks are not edited in place.

Defined cases: rows without any filled cell are skipped; a sheet without cells is a frame without
columns; a column whose cells are of several kinds is mixed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, ColumnInfo, PreparedFrame, make_column_id
from tablemill.functions.storage import materialize, numbered
from tablemill.sources.delimited import Issue, SourceReadError, source_ids

MAX_CELLS, ROWS, SHEET_NAME = 250_000, 1_048_575, "Dados Preparados"
#: Cells of a workbook that is written: about 35 bytes of XML each are held by one task.
WRITTEN_CELLS = 10_000_000
#: Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
CELLS = "num long, cells array<struct<t:string,n:double,s:string,b:boolean>>, issue string"
CELL_TYPE = pa.list_(pa.struct([("t", pa.string()), ("n", pa.float64()), ("s", pa.string()), ("b", pa.bool_())]))
SHORT = re.compile(r"\{.*\}")


def short(element) -> str:
    return SHORT.sub("", element.tag)


def place_of(ref: str) -> tuple[int, int]:
    """Column (0-based) and row of a reference such as AB12."""
    letters = ref.rstrip("0123456789")
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1, int(ref[len(letters) :])


def letters_of(column: int) -> str:
    out, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


class Book:
    """Parts of a workbook that is open for reading."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        rels = {r.get("Id"): r.get("Target") for r in self.part("xl/_rels/workbook.xml.rels")}
        self.sheets = {}
        for s in (e for e in self.part("xl/workbook.xml").iter() if short(e) == "sheet"):
            target = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
            self.sheets[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        texts = self.part("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else []
        self.texts = [text_of(e) for e in texts]
        self.dates = self.date_styles() if "xl/styles.xml" in names else []

    def part(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def date_styles(self) -> list[bool]:
        root = self.part("xl/styles.xml")
        own = {int(e.get("numFmtId")): e.get("formatCode", "") for e in root.iter() if short(e) == "numFmt"}
        shown = lambda i: i in DATE_FORMATS or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(i, "")).lower()))
        return [shown(int(x.get("numFmtId", 0))) for e in root if short(e) == "cellXfs" for x in e]

    def rows(self, sheet: str) -> Iterator[tuple[int, dict[int, tuple]]]:
        """Row number and cells (kind and value by column)."""
        with self.zip.open(self.sheets[sheet]) as f:
            for _, e in ElementTree.iterparse(f):
                if short(e) == "row":
                    cells = {}
                    for c in e:
                        value = self.cell(c)
                        if value is not None:
                            cells[place_of(c.get("r"))[0]] = value
                    yield int(e.get("r")), cells
                    e.clear()

    def cell(self, c) -> tuple | None:
        kind, v = c.get("t", "n"), next((x.text for x in c if short(x) == "v"), None)
        if kind == "inlineStr":
            return "string", "".join(text_of(x) for x in c if short(x) == "is")
        if v is None:
            return None
        if kind == "s":
            return "string", self.texts[int(v)]
        if kind == "b":
            return "boolean", v == "1"
        if kind != "n":
            return "string", v
        style = int(c.get("s", 0))
        if style < len(self.dates) and self.dates[style]:
            return "date", (date(1899, 12, 30) + timedelta(days=int(float(v)))).isoformat()
        return "number", float(v)

    def cells_in(self, sheet: str) -> int:
        """Cells of the range that the sheet says it uses, or of its rows."""
        head = self.zip.open(self.sheets[sheet]).read(4096).decode("utf-8", "ignore")
        m = re.search(r'<dimension ref="([A-Z]+[0-9]+)(?::([A-Z]+[0-9]+))?"', head)
        if not m:
            return sum(len(c) for _, c in self.rows(sheet))
        (a, b), (c, d) = place_of(m[1]), place_of(m[2] or m[1])
        return (c - a + 1) * (d - b + 1)


def text_of(element) -> str:
    return "".join(x.text or "" for x in element.iter() if short(x) == "t")


def list_sheets(spark: SparkSession, path: str) -> list[str]:
    """Sheet names; none for a delimited file."""
    if not path.lower().endswith(".xlsx"):
        return []
    names = F.udf(lambda data: list(opened(bytes(data)).sheets), "array<string>")
    return spark.read.format("binaryFile").load(path).select(names("content")).first()[0]


def opened(data: bytes) -> Book:
    try:
        return Book(data)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise SourceReadError(Issue("InvalidWorkbook", "O arquivo não é uma pasta de trabalho válida.")) from e


def decoded(files: DataFrame, sheet: str | None, region: str | None, max_cells: int) -> DataFrame:
    """num and cells of the rows of a sheet, or one row with an issue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                try:
                    book = Book(data)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    yield issue_row("InvalidWorkbook")
                    continue
                name = sheet if sheet is not None else next(iter(book.sheets), None)
                if name not in book.sheets:
                    yield issue_row("MissingSheet")
                elif book.cells_in(name) > max_cells:
                    yield issue_row("WorksheetRangeTooLarge")
                else:
                    yield from sheet_rows(book, name, region)

    return files.select("content").mapInArrow(run, CELLS)


def issue_row(code: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([[]], CELL_TYPE), pa.array([code])], ["num", "cells", "issue"])


def sheet_rows(book: Book, name: str, region: str | None) -> Iterator[pa.RecordBatch]:
    rows = list(book.rows(name))
    used = [c for _, cells in rows for c in cells]
    low, high, first, last = min(used, default=0), max(used, default=-1), 1, ROWS + 1
    if region:
        (low, first), (high, last) = (place_of(x) for x in (region.replace("$", "") + ":" + region.replace("$", "")).split(":")[:2])
    nums, cells = [], []
    for n, own in rows:
        if first <= n <= last and any(low <= c <= high and v[1] != "" for c, v in own.items()):
            nums.append(n)
            cells.append([struct_of(own.get(c)) for c in range(low, high + 1)])
    if nums:
        yield pa.RecordBatch.from_arrays([pa.array(nums, pa.int64()), pa.array(cells, CELL_TYPE), pa.array([None] * len(nums), pa.string())], ["num", "cells", "issue"])


def struct_of(value: tuple | None) -> dict:
    kind, v = value or (None, None)
    return {"t": kind, "n": v if kind == "number" else None, "s": v if kind in ("string", "date") else None, "b": v if kind == "boolean" else None}


#: What is said of a workbook that cannot be read.
TROUBLE = {
    "InvalidWorkbook": "O arquivo não é uma pasta de trabalho válida.",
    "MissingSheet": "A planilha solicitada não existe.",
    "WorksheetRangeTooLarge": "A planilha excede o limite de células.",
}


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, max_cells: int = MAX_CELLS, region: str | None = None) -> PreparedFrame:
    """The first or the named sheet; region (A1:F20): a destination range, whose row ids begin
    with template- and whose columns are numbered by place; its numbers stay numbers."""
    if max_cells <= 0:
        raise SourceReadError(Issue("InvalidCellBound", "O limite de células deve ser positivo."))
    rows = materialize(decoded(spark.read.format("binaryFile").load(path), sheet, region, max_cells), "cells")
    bad = rows.where("issue is not null").first()
    if bad:
        raise SourceReadError(Issue(bad.issue, TROUBLE[bad.issue]))
    head = rows.orderBy("num").first()
    if head is None:
        return PreparedFrame(rows.select(F.lit("").alias(ROW_ID), F.col("num").alias(ROW_NUM), F.col("num").alias("_o0")), (), (("_o0", True),))
    texts = [x.s if x.s is not None else "" if x.t is None else f"{x.n:g}" if x.t == "number" else str(x.b).lower() for x in head.cells]
    headers = [t or f"Coluna {letters_of(i)}" for i, t in enumerate(texts)] if region else texts
    ids = [make_column_id(h, i + 1) for i, h in enumerate(headers)] if region else source_ids(headers)
    body = rows.where(F.col("num") > head.num)
    cell = lambda i: F.element_at("cells", i + 1)
    seen = body.agg(*[F.array_sort(F.collect_set(cell(i)["t"])).alias(f"c{i}") for i in range(len(ids))]).first()
    infos, columns = [], []
    for i, (c, h) in enumerate(zip(ids, headers)):
        kinds = seen[i]
        kind = "empty" if not kinds else kinds[0] if len(kinds) == 1 else "mixed"
        part = {"number": "n", "boolean": "b"}.get(kind, "s")
        plain = F.struct(F.when(cell(i)["t"] == "date", "string").otherwise(cell(i)["t"]).alias("t"), *[cell(i)[p].alias(p) for p in "nsb"])
        infos.append(ColumnInfo(c, h, i, kind))
        columns.append((F.when(cell(i)["t"].isNotNull(), plain) if kind == "mixed" else cell(i)[part]).alias(c))
    hidden = [F.concat(F.lit("template-" if region else "row-"), F.col("num").cast("string")).alias(ROW_ID), F.col("num").alias(ROW_NUM), F.col("num").alias("_o0")]
    return PreparedFrame(body.select(*columns, *hidden), tuple(infos), (("_o0", True),))


# --- writing

#: The parts of a workbook with one sheet.
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."
#: Characters that XML 1.0 has no place for.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def cell_xml(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(FORBIDDEN.sub("", str(v)))}</t></is></c>'


def row_xml(n: int, values: list, letters: list[str]) -> str:
    return f'<row r="{n}">{"".join(cell_xml(c + str(n), v) for c, v in zip(letters, values))}</row>'


def workbook_bytes(headers: list[str], rows: Iterator[list], sheet: str) -> bytes:
    """A workbook of one sheet: the headers, then the rows."""
    letters = [letters_of(i) for i in range(len(headers))]
    return zipped(headers, (row_xml(n, row, letters) for n, row in enumerate(rows, 2)), sheet)


def zipped(headers: list[str], rows: Iterator[str], sheet: str) -> bytes:
    """rows: the XML of each row but the first."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{XML}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KIND}worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{XML}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{XML}<workbook xmlns="{MAIN}" xmlns:r="{RELS}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{XML}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{RELS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        letters = [letters_of(i) for i in range(len(headers))]
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{XML}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            f.write(row_xml(1, headers, letters).encode())
            for row in rows:
                f.write(row.encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def unique_sheet_name(name: str, taken: list[str] = ()) -> str:
    """A valid sheet name of at most 31 characters that no other has in any case."""
    bare = re.sub(r"[\[\]:*?/\\]", " ", name).strip().strip("'")[:31] or "Planilha"
    known, out, k = {t.lower() for t in taken}, bare, 2
    while out.lower() in known:
        tail = f" ({k})"
        out, k = bare[: 31 - len(tail)] + tail, k + 1
    return out


def workbooks(frame: PreparedFrame, sheet: str = SHEET_NAME, rows: int = ROWS, cells: int = WRITTEN_CELLS) -> DataFrame:
    """part, n_rows and content (bytes) of workbooks that hold the frame's rows in order, at most
    `rows` and about `cells` each. Rows become sheet XML where they lie; one task for each workbook
    only puts their texts in order into the zip."""
    if not 0 < rows <= ROWS:
        raise SourceReadError(Issue("InvalidRowBound", "O limite de linhas da planilha é inválido."))
    rows = max(1, min(rows, cells // max(1, len(frame.columns))))
    headers, name = [c.header for c in frame.columns], unique_sheet_name(sheet)
    values = [frame.value(i) for i in frame.ids]
    fields = [F.struct(v.number.alias("n"), v.boolean.alias("b"), F.when(v.number.isNull() & v.boolean.isNull() & ~v.is_null, v.text).alias("s")) for v in values]
    dealt = numbered(frame.df.select(F.array(*fields).alias("cells"), *frame.hidden), frame.ordering, "at")
    dealt = dealt.select(F.floor(F.col("at") / rows).cast("long").alias("part"), F.col("at"), "cells")
    letters = [letters_of(i) for i in range(len(headers))]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = lambda c: c["n"] if c["n"] is not None else c["b"] if c["b"] is not None else c["s"]
        whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                b = batch.slice(start, 1024)
                texts = [row_xml(at % rows + 2, [whole(pick(c)) for c in r], letters) for at, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["part", "at", "xml"])

    def bound(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        each = (x for b in table.select(["xml"]).to_batches(max_chunksize=1024) for x in b.column(0).to_pylist())
        return pa.table({"part": [table.column("part")[0].as_py()], "n_rows": [table.num_rows], "content": pa.array([zipped(headers, each, name)], pa.binary())})

    return dealt.mapInArrow(written, "part long, at long, xml string").groupBy("part").applyInArrow(bound, "part long, n_rows long, content binary")


def read_references(spark: SparkSession, source: str | None = None, template: str | None = None, max_cells: int = MAX_CELLS) -> dict[str, PreparedFrame]:
    """Every sheet of both workbooks, named source:<sheet> and template:<sheet>, for relation rules;
    sheets that cannot be read are left out."""
    out = {}
    for name, path in (("source", source), ("template", template)):
        for sheet in list_sheets(spark, path) if path else ():
            try:
                out[f"{name}:{sheet}"] = read_xlsx(spark, path, sheet, max_cells)
            except SourceReadError:
                continue
    return out


def read_source(spark: SparkSession, path: str, delimiter: str | None = None, sheet: str | None = None, max_cells: int = MAX_CELLS) -> PreparedFrame:
    """By the file's extension."""
    from tablemill.sources.delimited import read_csv

    if path.lower().endswith(".csv"):
        return read_csv(spark, path, delimiter)
    if path.lower().endswith(".xlsx"):
        return read_xlsx(spark, path, sheet, max_cells)
    raise SourceReadError(Issue("UnsupportedFileType", "São aceitos arquivos CSV e XLSX."))
