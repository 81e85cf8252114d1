"""Workbooks in and out, with the standard library: an xlsx file is XML parts in a zip."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.operators.translate import column_letters, column_number, shifted

CELLS = "path string, sheet string, row int, col int, formula string, value string, kind string, shared int, style_date boolean"
#: XML namespaces, and the number formats that are dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47)


def serial_date(serial: Column) -> Column:
    """Text of a spreadsheet's day number; day 60 is a leap day that never was. A fraction is the time."""
    days = F.floor(serial)
    day = F.date_add(F.lit("1899-12-31").cast("date"), (days - F.when(days >= 60, 1).otherwise(0)).cast("int")).cast("string")
    seconds = F.round((serial - days) * 86400).cast("int")
    clock = F.format_string(" %02d:%02d:%02d", (seconds / 3600).cast("int"), ((seconds % 3600) / 60).cast("int"), seconds % 60)
    return F.when(seconds > 0, F.concat(day, clock)).otherwise(day)


def sheet_cells(raw: bytes) -> Iterator[tuple]:
    """(sheet, row, col, formula, value, kind, shared, is date) of all cells with content."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = lambda p: ElementTree.fromstring(z.read(p)) if p in z.namelist() else ElementTree.Element("none")
        strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in xml("xl/sharedStrings.xml").iter(f"{MAIN}si")]
        styles = xml("xl/styles.xml")
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        dated = [(n := int(x.get("numFmtId", 0))) in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I)) for xfs in styles.iter(f"{MAIN}cellXfs") for x in xfs]
        places = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
        for s in xml("xl/workbook.xml").iter(f"{MAIN}sheet"):
            part = "xl/" + places[s.get(LINK)].removeprefix("/xl/")
            for c in xml(part).iter(f"{MAIN}c"):
                f, v, kind = c.find(f"{MAIN}f"), c.findtext(f"{MAIN}v"), c.get("t", "n")
                if kind == "s" and v is not None:
                    v = strings[int(v)]
                if kind == "inlineStr":
                    v = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                if v is None and f is None:
                    continue
                letters, row = re.match(r"([A-Z]+)([0-9]+)", c.get("r")).groups()
                name = {"s": "text", "str": "text", "inlineStr": "text", "b": "bool", "e": "error"}.get(kind, "number")
                style = int(c.get("s", 0))
                group = int(f.get("si")) if f is not None and f.get("t") == "shared" else None
                yield s.get("name"), int(row), column_number(letters), f.text if f is not None else None, v, name, group, name == "number" and style < len(dated) and dated[style]


def read_cells(files: DataFrame) -> DataFrame:
    """files (path, content: bytes). Rows of CELLS; members of shared formulas get theirs from the first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                masters: dict[tuple, tuple] = {}
                for sheet, row, col, formula, value, kind, group, is_date in sheet_cells(bytes(raw)):
                    if group is not None:
                        if formula:
                            masters[sheet, group] = (row, col, formula)
                        elif (sheet, group) in masters:
                            r, c, text = masters[sheet, group]
                            formula = shifted(text, row - r, col - c)
                    rows.append((path, sheet, row, col, formula, value, kind, group, bool(is_date)))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"shared": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


def layout(cells: DataFrame, look: int = 20) -> DataFrame:
    """(path, sheet, header_row, first, last): the first of the first ``look`` rows with two or more cells, all plain text; the body is the leading run of rows below with the shape of the first."""
    key = ["path", "sheet"]
    plain = (F.coalesce(F.trim("value"), F.lit("")) != "") & F.col("formula").isNull() & ~F.col("value").rlike(r"^-?\d+(\.\d+)?$")
    per = cells.groupBy(*key, "row").agg(F.sum((F.coalesce(F.trim("value"), F.lit("")) != "").cast("int")).alias("filled"), F.sum((~F.coalesce(plain, F.lit(False))).cast("int")).alias("other"), F.array_join(F.array_sort(F.collect_list(F.concat(F.format_string("%05d", "col"), F.when(F.col("formula").isNull(), "v").otherwise("f")))), " ").alias("shape"))
    order = F.row_number().over(Window.partitionBy(*key).orderBy("row"))
    head = per.withColumn("i", order).where((F.col("i") <= look) & (F.col("filled") >= 2) & (F.col("other") == 0)).groupBy(*key).agg(F.min("row").alias("header_row"))
    body = per.join(head, key).where("row > header_row")
    w = Window.partitionBy(*key).orderBy("row")
    same = body.withColumn("first_shape", F.first("shape").over(w)).withColumn("broken", F.sum((F.col("shape") != F.col("first_shape")).cast("int")).over(w))
    return same.where("broken = 0").groupBy(*key, "header_row").agg(F.min("row").alias("first"), F.max("row").alias("last"))


def write_workbook(path: str, columns: list[str], rows: list[tuple], formulas: dict[str, str] | None = None) -> None:
    """One sheet with a table (ListObject); formulas: column to a formula in structured references. For results that fit the driver."""
    formulas = formulas or {}
    n, last = len(rows) + 1, column_letters(len(columns))

    def cell(i: int, r: int, v: object) -> str:
        at, f = f"{column_letters(i)}{r}", formulas.get(columns[i - 1])
        made = f"<f>{escape(f)}</f>" if f and r > 1 else ""
        if v is None:
            return f'<c r="{at}">{made}</c>' if made else ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{at}">{made}<v>{v}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(i, r, v) for i, v in enumerate(row, 1))}</row>' for r, row in enumerate([tuple(columns), *rows], 1))
    ns, rel = MAIN.strip("{}"), LINK.strip("{}").removesuffix("}id")
    table_columns = "".join(f'<tableColumn id="{i}" name="{escape(c)}">{f"<calculatedColumnFormula>{escape(formulas[c])}</calculatedColumnFormula>" if c in formulas else ""}</tableColumn>' for i, c in enumerate(columns, 1))
    pack, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = lambda i, t, to: f'<Relationships xmlns="{pack}/relationships"><Relationship Id="{i}" Type="{rel}/{t}" Target="{to}"/></Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/tables/table1.xml" ContentType="{kind}.table+xml"/></Types>',
        "_rels/.rels": link("rId1", "officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="table" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link("rId1", "worksheet", "worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}" xmlns:r="{rel}"><sheetData>{body}</sheetData><tableParts count="1"><tablePart r:id="rId1"/></tableParts></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": link("rId1", "table", "../tables/table1.xml"),
        "xl/tables/table1.xml": f'<table xmlns="{ns}" id="1" name="table1" displayName="table1" ref="A1:{last}{max(2, n)}"><autoFilter ref="A1:{last}{max(2, n)}"/><tableColumns count="{len(columns)}">{table_columns}</tableColumns></table>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)


def table_range(raw: bytes) -> list[tuple[str, int, int, int, int]]:
    """(name, first data row, last data row, first column, last column) of each table object."""
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for p in sorted(n for n in z.namelist() if re.match(r"xl/tables/table\d+\.xml$", n)):
            t = ElementTree.fromstring(z.read(p))
            a, r, b, s = re.match(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", t.get("ref")).groups()
            out.append((t.get("displayName"), int(r) + int(t.get("headerRowCount", 1)), int(s) - int(t.get("totalsRowCount", 0)), column_number(a), column_number(b)))
    return out


def to_rows(cells: DataFrame, where: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, sheet, row, name, value) of the bodies with header names, loss report (path, sheet, code, n)). Booleans are 1 and 0, dates text."""
    key = ["path", "sheet"]
    inside = cells.join(where, key)
    head = inside.where("row = header_row").select(*key, "col", F.trim("value").alias("name"))
    shown = F.when(F.col("kind") == "bool", F.col("value")).when(F.col("style_date"), serial_date(F.col("value").try_cast("double"))).otherwise(F.col("value"))
    body = inside.where("row between first and last").join(head, [*key, "col"]).select(*key, "row", "name", shown.alias("value"))
    code = F.when(F.col("row") > F.col("last"), "below-table").when(F.col("row") < F.col("header_row"), "above-table").when(F.col("kind") == "error", "error-cell").when(F.col("style_date"), "date-as-text").when(F.col("kind") == "bool", "bool-as-number")
    return body, inside.withColumn("code", code).where("code is not null").groupBy(*key, "code").agg(F.count(F.lit(1)).alias("n"))


def as_date(y: int, m: int, d: int) -> float:
    """The day number of a date after February 1900."""
    return float((date(y, m, d) - date(1899, 12, 31)) // timedelta(days=1) + 1)
