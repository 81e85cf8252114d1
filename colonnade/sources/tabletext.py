"""Tables as text: a header line, an alignment line, rows, and trailing declarations ``name := ...``."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.plans.grammar import Refused, parse, parse_total
from colonnade.plans.model import TableDef

#: Marks of an unresolved merge, an alignment cell, a declaration, an order.
CONFLICT = r"^(<{7}|={7}|>{7}|\|{7})"
ALIGN = r"^:?-+:?$"
DECLARATION = re.compile(r"^\s*(\w+)\s*:=\s*(.+?)\s*$")
ORDER = re.compile(r"^by\(\s*(\w+)\s*\)$")


def cells(line: str) -> list[str]:
    """Cells of a row; ``\\|`` is a bar in a cell."""
    body = line.strip().removeprefix("|")
    parts = re.split(r"(?<!\\)\|", body)
    if parts and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def cells_column(line: Column) -> Column:
    body = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(body, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))


def read_table(text: str) -> tuple[list[str], list[list[str]], TableDef]:
    """(columns, rows of text, definition); refuses what could be misread. For tables that fit the driver."""
    lines = unicodedata.normalize("NFC", text).split("\n")
    if any(re.match(CONFLICT, line) for line in lines):
        raise Refused("conflict marker")
    bars = [line for line in lines if line.lstrip().startswith("|")]
    if len(bars) < 2:
        raise Refused("no table")
    table, seen = TableDef(), set()
    for line in lines:
        if ":=" not in line or line.lstrip().startswith("|"):
            continue
        if not (m := DECLARATION.match(line)):
            raise Refused(f"malformed declaration: {line!r}")
        name, body = m[1], m[2]
        if name in seen:
            raise Refused(f"duplicate declaration of {name}")
        seen.add(name)
        if name == "key":
            table.key = body
        elif name == "order":
            if not (o := ORDER.match(body)):
                raise Refused(f"malformed order: {body!r}")
            table.order = o[1]
        else:
            if not body.endswith(")"):
                raise Refused(f"malformed declaration: {line!r}")
            parse_total(body)
            table.aggregates[name] = body
    header = cells(bars[0])
    columns = []
    for cell in header:
        name, is_computed, formula = cell.partition("=")
        name = name.strip()
        if name in columns:
            raise Refused(f"duplicate column {name}")
        columns.append(name)
        if is_computed:
            parse(formula)
            table.formulas[name] = formula.strip()
    align = cells(bars[1])
    if len(align) != len(header) or not all(re.match(ALIGN, c) for c in align):
        raise Refused("alignment line does not fit the header")
    rows = [cells(b) for b in bars[2:]]
    for r in rows:
        if len(r) != len(columns):
            raise Refused(f"field count: {len(r)} cells under {len(columns)} columns")
        if all(re.match(ALIGN, c) for c in r):
            raise Refused("a second alignment line")
        if bad := next((c for c, v in zip(columns, r, strict=True) if c in table.formulas and v), None):
            raise Refused(f"value in computed cell of {bad}")
    if table.key is not None:
        if table.key not in columns:
            raise Refused(f"unknown key column {table.key}")
        ids = [r[columns.index(table.key)] for r in rows]
        if len(set(ids)) < len(ids):
            raise Refused("duplicate row key")
    if table.order is not None and table.order not in columns:
        raise Refused(f"unknown order column {table.order}")
    if table.needs_order():
        if table.order is None:
            raise Refused("row-relative column without an order")
        if table.key is None:
            raise Refused("an order needs a key to break ties")
        if table.order in table.formulas:
            raise Refused("the order column can't be computed")
    if table.order is not None and table.order not in table.formulas:
        kinds = {"number" if re.match(r"^-?\d+(\.\d+)?$", v) else "date" if re.match(r"^\d{1,4}([-/])\d{1,2}\1\d{1,2}$", v) else "text" for v in (r[columns.index(table.order)] for r in rows)}
        if len(kinds) > 1:
            raise Refused("mixed types in the order column")
    return columns, rows, table


def stored(spark: SparkSession, columns: list[str], rows: list[list[str]], table: TableDef) -> DataFrame:
    keep = [i for i, c in enumerate(columns) if c not in table.formulas]
    schema = ", ".join(f"`{columns[i]}` string" for i in keep)
    return spark.createDataFrame([tuple(r[i] or None for i in keep) for r in rows], schema)


def scan_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of table files of any size: one record a line, split on the executors; the two head lines and declarations are left out."""
    lines = spark.read.text(path).where(F.ltrim("value").startswith("|")).select(cells_column(F.col("value")).alias("c"))
    body = lines.where(~F.forall("c", lambda x: x.rlike(ALIGN)) & (F.transform("c", lambda x: F.trim(F.split(x, "=")[0])) != F.array(*map(F.lit, columns))))
    return body.select(*(F.nullif(F.get("c", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(columns)))


def canonical(columns: list[str]) -> Column:
    """A row as text with single spaces; bars in cells escaped. canonical of canonical is the same line."""
    cell = lambda c: F.replace(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("|"), F.lit("\\|"))
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))


def render(df: DataFrame, table: TableDef, right: tuple[str, ...] = ()) -> DataFrame:
    """Lines of the whole table (column line, kept in order by n): head, rows by key, declarations. Computed cells are blank."""
    columns = df.columns + [c for c in table.formulas if c not in df.columns]
    head = "| " + " | ".join(f"{c} = {table.formulas[c]}" if c in table.formulas else c for c in columns) + " |"
    align = "| " + " | ".join("--:" if c in right else "---" for c in columns) + " |"
    tail = ["", *([f"key := {table.key}"] if table.key else []), *([f"order := by({table.order})"] if table.order else []), *(f"{n} := {b}" for n, b in table.aggregates.items())]
    blank = df.withColumns({c: F.lit("") for c in table.formulas})
    rows = blank.select(F.lit(1).alias("part"), F.col(table.key or columns[0]).cast("string").alias("n"), canonical(columns).alias("line"))
    fixed = df.sparkSession.createDataFrame([(p, f"{i:09d}", s) for p, part in ((0, [head, align]), (2, tail)) for i, s in enumerate(part)], "part int, n string, line string")
    return fixed.union(rows).orderBy("part", "n")


def set_cell(df: DataFrame, table: TableDef, key: str, column: str, value: str | None) -> DataFrame:
    if table.key is None:
        raise Refused("no key")
    if column in table.formulas:
        raise Refused(f"{column} is computed")
    if column not in df.columns:
        raise Refused(f"unknown column {column}")
    return df.withColumn(column, F.when(F.col(table.key) == key, F.lit(value)).otherwise(F.col(column)))
