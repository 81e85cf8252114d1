"""Evaluated tables as Markdown or HTML lines, made on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.plans.evaluate import shown
from colonnade.sources.tabletext import canonical


def markdown(df: DataFrame, key: str) -> DataFrame:
    """(n, line): head, alignment, rows by key; the key column is left out."""
    view = shown(df)
    columns = [c for c in view.columns if c != key]
    head = [("| " + " | ".join(columns) + " |"), "| " + " | ".join(["---"] * len(columns)) + " |"]
    fixed = df.sparkSession.createDataFrame([("", i, h) for i, h in enumerate(head)], "k string, i int, line string")
    return fixed.union(view.select(F.col(key).cast("string"), F.lit(2), canonical(columns))).orderBy("i", "k").select("line")


def html(df: DataFrame, key: str) -> DataFrame:
    view = shown(df)
    columns = [c for c in view.columns if c != key]
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    fixed = df.sparkSession.createDataFrame([("", 0, head), ("", 2, "</table>")], "k string, i int, line string")
    return fixed.union(view.select(F.col(key).cast("string"), F.lit(1), row)).orderBy("i", "k").select("line")
