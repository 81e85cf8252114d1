"""CSV in and out: every deviation is a row of a report, nothing that could change a value is applied silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.values import error_text
from colonnade.operators.validate import nfc

REPORT = "severity string, code string, place string, text string"
#: Fixed values: (pattern, kind, severity, code), in the order in which they are tried.
CELL_RULES = (
    (r"^$", "empty", None, None),
    (r"^0\d+$", "text", "NOTE", "leading-zero"),
    (r"^-?\d+(\.\d+)?$", "number", None, None),
    (r"^-?\d+(\.\d+)?[eE][+-]?\d+$", "number", "NOTE", "sci-notation"),
    (r"^-?\d{1,3}(,\d{3})+(\.\d+)?$", "number", "WARN", "thousands-sep"),
    (r"^-?\d{1,3}(\.\d{3})+(,\d+)?$|^-?\d+,\d+$", "reject", "REJECT", "decimal-comma"),
    (r"^\(\s*[\d,]+(\.\d+)?\s*\)$", "number", "WARN", "accounting-negative"),
    (r"^\d{2}/\d{2}/\d{4}$", "reject", "REJECT", "ambiguous-date"),
    (r"^\d{4}-\d{2}-\d{2}$|^\d{4}/\d{2}/\d{2}$|^[A-Z][a-z]{2} \d{1,2} \d{4}$|^\d{1,2}-[A-Z][a-z]{2}-\d{2}$", "date", "NOTE", "date"),
    (r"^-$", "empty", "WARN", "excel-dash-null"),
    (r"^[=+\-@]", "text", "WARN", "formula-looking-cell"),
)


def classify(cell: Column) -> Column:
    """struct(kind, canon, severity, code) of a cell's text; the first rule that fits decides."""
    text = F.coalesce(cell, F.lit(""))
    canon = {"thousands-sep": F.replace(text, F.lit(","), F.lit("")), "accounting-negative": F.concat(F.lit("-"), F.regexp_replace(text, r"[(),\s]", "")), "excel-dash-null": F.lit("")}

    def result(kind: str, severity: str | None, code: str | None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), canon.get(code, text).alias("canon"), F.lit(severity).cast("string").alias("severity"), F.lit(code).cast("string").alias("code"))

    out = result("text", None, None)
    for pattern, kind, severity, code in reversed(CELL_RULES):
        out = F.when(text.rlike(pattern), result(kind, severity, code)).otherwise(out)
    return out


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, content: bytes): ((path, text) of what is UTF-8, rows of REPORT). Composed form, line feeds, no byte order mark."""
    bom = F.substring(F.hex("content"), 1, 6) == "EFBBBF"
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    rows = files.select("path", bom.alias("bom"), body.alias("b")).withColumn("ok", F.expr("is_valid_utf8(b)"))
    rows = rows.withColumn("raw", F.when(F.col("ok"), F.decode("b", "UTF-8"))).withColumn("lf", F.replace("raw", F.lit("\r\n"), F.lit("\n"))).withColumn("text", nfc(F.col("lf")))
    said = F.array_compact(
        F.array(
            *(
                F.when(when, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.col("path").alias("place"), F.lit("").alias("text")))
                for when, s, c in ((F.col("bom"), "NOTE", "bom-stripped"), (~F.col("ok"), "REJECT", "not-utf8"), (F.col("raw").contains("\r\n"), "NOTE", "crlf-normalised"), (F.col("text") != F.col("lf"), "NOTE", "nfc-normalised"))
            )
        )
    )
    return rows.where("ok").select("path", "text"), rows.select(F.explode(said).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of text, ragged records with their text). Blank records are dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", __bad string"
    rows = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True)
    some = F.coalesce(*(F.col(c) for c in columns)).isNotNull()
    read = F.length(F.concat_ws("", *columns)) >= 0  # always so; the corrupt record can't be asked for alone
    return rows.where(F.col("__bad").isNull() & some).drop("__bad"), rows.where(F.col("__bad").isNotNull() & read).select(F.col("__bad").alias("text"))


def profile(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Rows of REPORT for every cell that isn't plain."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns))).alias("x")
    rows = df.select(F.col(row_id).cast("string").alias("id"), cells).select("id", "x.column", "x.cell", classify(F.col("x.cell")).alias("k"))
    return rows.where("k.code is not null").select(F.col("k.severity").alias("severity"), F.col("k.code").alias("code"), F.concat_ws(":", "column", "id").alias("place"), F.col("cell").alias("text"))


def import_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Canonical text of all cells; rows with a cell that must be rejected are left out (see profile)."""
    kinds = df.withColumns({f"__{c}": classify(F.col(c).cast("string")) for c in columns})
    good = F.lit(True)
    for c in columns:
        good = good & (F.col(f"__{c}.kind") != "reject")
    return kinds.where(good).select(*(F.nullif(F.col(f"__{c}.canon"), F.lit("")).alias(c) if c in columns else F.col(c) for c in df.columns))


def export_text(df: DataFrame, drop: str | None = None) -> DataFrame:
    """All columns as text for ``write.csv``: whole numbers without a fraction, error values spelled out, err columns and ``drop`` left out."""
    err = {c for c in df.columns if c.endswith("__err")}

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType.simpleString()
        x = F.col(c)
        text = F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string")) if kind in ("double", "float") else x.cast("string")
        return (F.when(F.col(f"{c}__err").isNotNull(), error_text(F.col(f"{c}__err"))).otherwise(text) if f"{c}__err" in err else text).alias(c)

    return df.select(*(cell(c) for c in df.columns if c not in err and c != drop))


def representable(df: DataFrame, columns: list[str]) -> DataFrame:
    """(defect, n): cells that a table row can't hold as they are."""
    cell = F.explode(F.array(*(F.col(c).cast("string") for c in columns))).alias("x")
    kind = F.when(F.col("x").contains("\n"), "newline").when(F.col("x").contains("|"), "pipe").when(F.col("x").rlike(r"^:?-+:?$"), "alignment-like")
    return df.select(cell).select(kind.alias("defect")).where("defect is not null").groupBy("defect").agg(F.count(F.lit(1)).alias("n"))


def canon_churn(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: cells that trimming and composing would change."""
    cell = df.select(F.explode(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))).alias("x")).withColumn("y", nfc(F.col("x")))
    return cell.agg(F.count(F.lit(1)).alias("cells"), F.sum((F.trim("x") != F.col("x")).cast("long")).alias("trimmed"), F.sum((F.col("x") != F.col("y")).cast("long")).alias("composed"))
