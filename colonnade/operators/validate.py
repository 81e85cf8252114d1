"""Refusals as rows: every check returns what violates it, so that a corpus is checked in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.values import order_kind
from colonnade.sources.tabletext import ALIGN, CONFLICT, cells_column

#: Characters that don't show.
INVISIBLE = "[­​-‏‪-‮⁠-⁤﻿]"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed Unicode form; Spark has no function for it."""
    return text.str.normalize("NFC")


def folded(name: Column) -> Column:
    """Composed form without invisible characters, case folded (ß as ss; either small sigma)."""
    return F.translate(F.lower(F.upper(F.regexp_replace(nfc(name), INVISIBLE, ""))), "ς", "σ")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def duplicate_names(df: DataFrame, file: str, name: str) -> DataFrame:
    """Columns, aggregates or declarations of a file that have one name."""
    return df.groupBy(file, name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflict_markers(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(CONFLICT))


def field_counts(lines: DataFrame, n: int) -> DataFrame:
    """Table rows (column line) with other than n cells."""
    return lines.where(F.ltrim("line").startswith("|")).withColumn("n_cells", F.size(cells_column(F.col("line")))).where(F.col("n_cells") != n)


def stray_alignment(lines: DataFrame) -> DataFrame:
    return lines.where(F.ltrim("line").startswith("|") & F.forall(cells_column(F.col("line")), lambda c: c.rlike(ALIGN)))


def byte_defects(lines: DataFrame) -> DataFrame:
    """Lines with a byte order mark, a lone carriage return, or invisible characters: (.., defect)."""
    c = F.col("line")
    kind = F.when(c.startswith("﻿"), "bom").when(c.rlike("\r(?!$)"), "lone-cr").when(c.rlike(INVISIBLE), "invisible")
    return lines.withColumn("defect", kind).where("defect is not null")


def computed_cells_with_value(df: DataFrame, computed: list[str]) -> DataFrame:
    bad = F.array_compact(F.array(*(F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.lit(c)) for c in computed)))
    return df.withColumn("bad", F.explode(bad))


def order_kinds(df: DataFrame, column: str) -> DataFrame:
    """How many cells of each kind an order column has; more than one kind is refused."""
    return df.groupBy(order_kind(F.col(column)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def fold_collisions(df: DataFrame, name: str) -> DataFrame:
    """Names that differ but can't be told apart: (folded, spellings)."""
    return df.select(folded(F.col(name)).alias("folded"), F.col(name).alias("n")).groupBy("folded").agg(F.array_sort(F.collect_set("n")).alias("spellings")).where("size(spellings) > 1")


def duplicate_artifacts(df: DataFrame, artifact: str, path: str) -> DataFrame:
    return df.groupBy(artifact).agg(F.countDistinct(path).alias("n_paths")).where("n_paths > 1")


def unsafe_paths(df: DataFrame, path: str) -> DataFrame:
    p = F.col(path)
    bad = (p == "") | p.startswith("/") | p.contains("\\") | p.rlike(r"(^|/)\.{1,2}(/|$)") | p.contains("//") | p.rlike(r"[\x00-\x1f\x7f]") | p.rlike(r"(?i)(^|/)\.git(/|$)") | p.endswith("/")
    return df.where(F.coalesce(bad, F.lit(True)))


def unbound(declared: DataFrame, bound: DataFrame, name: str) -> DataFrame:
    """Capabilities that are declared but nothing provides."""
    return declared.join(bound.select(name).distinct(), name, "left_anti")


def two_row_header(df: DataFrame, first: int = 0) -> DataFrame:
    """Per file (columns file, row, cells): whether a repetitive first row stands over a distinct second one."""
    share = lambda r: F.max(F.when(F.col("row") == r, F.size(F.array_distinct("cells")) / F.size("cells")))
    return df.groupBy("file").agg(share(first).alias("s0"), share(first + 1).alias("s1")).select("file", ((F.col("s0") < 1) & (F.col("s1") > F.col("s0"))).alias("grouped"))


def canvas_faults(nodes: DataFrame, edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """(fault, name): node or override given twice, edge end or override without a node."""
    twice = lambda d, c, k: d.groupBy(F.col(c).alias("name")).count().where("count > 1").select(F.lit(k).alias("fault"), "name")
    names = nodes.select("name").distinct()
    lost = lambda d, k: d.join(names, "name", "left_anti").select(F.lit(k).alias("fault"), "name")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    return twice(nodes, "name", "duplicate-node").union(twice(overrides, "name", "duplicate-override")).union(lost(ends, "unknown-edge-end")).union(lost(overrides.select("name").distinct(), "unknown-override"))


def markdown_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, name, n): link and footnote definitions and heading anchors that occur more than once in a document."""
    def found(kind: str, pattern: str) -> DataFrame:
        return docs.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))

    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), r"[^\p{L}\p{N} _-]", ""), " ", "-")
    heads = found("heading", r"(?m)^#{1,6}[ \t]+(.+)$").withColumn("name", slug)
    rows = found("link", r"(?m)^\[([^\]^]+)\]:").union(found("footnote", r"(?m)^\[\^([^\]]+)\]:")).union(heads)
    return rows.groupBy("doc_id", "kind", F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


POLICIES = ("preserve", "strict", "hint", "drop")


def recognise(lines: Iterator[str], known: tuple[str, ...], policy: str) -> tuple[list[str], list[str]]:
    """(lines that stay, messages) for declarations of unknown kind: kept, refused, kept with a message, or dropped with one."""
    if policy not in POLICIES:
        raise ValueError(policy)
    kept, said = [], []
    for line in lines:
        name = line.partition(":=")[0].strip()
        if ":=" not in line or name in known:
            kept.append(line)
            continue
        if policy == "strict":
            raise ValueError(f"unknown declaration {name}")
        if policy != "drop":
            kept.append(line)
        if policy != "preserve":
            said.append(f"unknown declaration {name}")
    return kept, said
