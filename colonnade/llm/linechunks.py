"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of the last ``window`` lines ends a chunk wherever it is divisible by
``divisor``. Such borders depend on the lines around them alone, so a passage that stands at another place
in another document is cut at the same lines. Of chunks with two or more lines that occur more than once in
all documents the first (smallest doc_id, then earliest) stays; every other one goes after its bytes were
compared with those of the one that stays. Lines in chunks of one line are never removed.

Counting and choosing move hashes only. A text moves twice: once to fetch the chunks that stay, once to
remove the others. No key gathers rows without a partial aggregate before the shuffle; a frequent chunk's
rows meet the one that stays in slices (:mod:`slices`).

Chunks miss a repeated passage that holds no whole chunk of two lines. :func:`dedup_passages` misses none of two
or more lines: after the chunks it compares the pairs of neighbouring lines that are left, which are those inside
distinct chunks and those across the borders of all.

Defined cases: a null text stays null, with n_lines and n_removed 0; an empty text has one empty line; a
text that loses all lines becomes the empty string; a null doc_id sorts last; rows with equal doc_id and
equal text share one decision (they are one document given twice); an empty table gives an empty result;
other columns pass through under any name that doesn't begin with two underscores; those named n_lines or
n_removed (or as ``added`` names these two) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import cut
from colonnade.llm.slices import sliced_join

PRIME, BASE = 1_000_003, 257


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, not once for each element of the arrays inside body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column, window: int, divisor: int, body: Callable[[Column, Column], Column], joined: bool = False) -> Column:
    """body(lines, chunks); chunks: array of struct(idx from 0, first from 1, n).

    joined: of borders at neighbouring lines only the first counts, none before the last line; a text of two or more lines has no chunk of one.
    """

    def rolled(hashes: Column, end: Column) -> Column:
        return F.aggregate(F.slice(hashes, end - (window - 1), F.lit(window)), F.lit(0).cast("long"), lambda a, x: (a * BASE + x) % PRIME)

    def ends(lines: Column, hashes: Column) -> Column:
        last = F.size(lines)
        border = lambda i: F.when(i >= window, rolled(hashes, i) % divisor == 0).otherwise(F.lit(False))
        inner = (lambda i: border(i) & ~border(i - 1) & (i > 1) & (i < last - 1)) if joined else border
        return F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | inner(i))

    def spans(e: Column) -> Column:
        def span(end: Column, k: Column) -> Column:
            first = F.when(k == 0, F.lit(1)).otherwise(F.get(e, k - 1) + 1)
            return F.struct(k.alias("idx"), first.alias("first"), (end - first + 1).alias("n"))

        return F.transform(e, span)

    lines = F.split(text, "\n", -1)
    return let(lines, lambda ls: let(F.transform(ls, _line_hash), lambda h: let(ends(ls, h), lambda e: let(spans(e), lambda c: body(ls, c)))))


def _joined(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"], chunk["n"]), "\n")


def _firsts(rows: DataFrame, *more: str) -> DataFrame:
    """How often each h occurs and where first: h, n, f (struct of __null, __d, __t, idx and more)."""
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__null", "__d", "__t", "idx", *more)).alias("f"))


def _repeated(firsts: DataFrame) -> DataFrame:
    return firsts.where("n >= 2").select("h", "n", F.col("f.__d").alias("fd"), F.col("f.__t").alias("ft"), F.col("f.idx").alias("fi"))


def _deduped(docs: DataFrame, parts: Callable[[DataFrame], tuple[DataFrame, DataFrame]], fetched: Column, stays: Column, added: tuple[str, str]) -> DataFrame:
    """docs without the repeated parts of texts.

    parts: of the texts with two or more lines, rows (__d, __t, __null, idx, h: hash) and what _repeated tells of them, written. Of the text
    column: fetched, of ``__w`` (array of idx, h) the structs (h, kept: bytes); stays, what is left without ``__r`` (array of idx, kept) where
    the bytes are equal: struct(text, n: lines before, kept: lines).
    """
    own = [c for c in docs.columns if c not in added]
    keyed = docs.select(*(F.col(f"`{c}`") for c in own), F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("__d"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("__t"))
    slim = keyed.select("__d", "__t", F.col("doc_id").isNull().alias("__null"), "text")
    rows, first = parts(slim.where(F.col("text").contains("\n")))
    wanted = first.groupBy(F.col("fd").alias("__d"), F.col("ft").alias("__t")).agg(F.collect_list(F.struct(F.col("fi").alias("idx"), "h")).alias("__w"))
    kept = slim.join(wanted, ["__d", "__t"]).select(F.explode(fetched).alias("k")).select("k.h", "k.kept")
    stay = cut(first.join(kept.groupBy("h").agg(F.first("kept").alias("kept")), "h"))  # a row given twice fetches twice
    later = sliced_join(rows, stay, ["h"], "n", ["__d", "__t", "idx"]).where(~((F.col("__d") == F.col("fd")) & (F.col("__t") == F.col("ft")) & (F.col("idx") == F.col("fi"))))
    drop = later.groupBy("__d", "__t").agg(F.collect_list(F.struct("idx", "kept")).alias("__r"))
    cleaned = keyed.join(drop, ["__d", "__t"], "left").withColumn("__s", F.when(F.col("__r").isNotNull(), stays))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.col("__s.n"), F.regexp_count("text", F.lit("\n")) + 1))
    gone = F.coalesce(F.col("__s.n") - F.col("__s.kept"), F.lit(0))
    return cleaned.select(*(F.coalesce("__s.text", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in own), n_lines.cast("long").alias(added[0]), gone.cast("long").alias(added[1]))


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 3, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text without the repeated chunks, n_lines (before) and n_removed; added: other names for these two."""

    def found(ls: Column, cs: Column) -> Column:
        return F.transform(F.filter(cs, lambda c: c["n"] >= 2), lambda c: F.struct(c["idx"].alias("idx"), F.xxhash64(_joined(ls, c)).alias("h")))

    def fetched(ls: Column, cs: Column) -> Column:
        return F.transform(F.col("__w"), lambda w: F.struct(w["h"].alias("h"), _joined(ls, F.get(cs, w["idx"])).alias("kept")))

    def stays(ls: Column, cs: Column) -> Column:
        gone = lambda c: F.exists("__r", lambda r: (r["idx"] == c["idx"]) & (r["kept"] == _joined(ls, c)))
        parts = F.filter(cs, lambda c: ~F.coalesce(gone(c), F.lit(False)))
        return F.struct(F.array_join(F.transform(parts, lambda c: _joined(ls, c)), "\n").alias("text"), F.size(ls).alias("n"), F.aggregate(parts, F.lit(0), lambda a, c: a + c["n"]).alias("kept"))

    def parts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = texts.select("__d", "__t", "__null", F.explode(chunks(F.col("text"), window, divisor, found)).alias("c")).select("__d", "__t", "__null", "c.idx", "c.h")
        return rows, cut(_repeated(_firsts(rows)))

    return _deduped(docs, parts, *(chunks(F.col("text"), window, divisor, f) for f in (fetched, stays)), added)


def passage_parts(texts: DataFrame, window: int, divisor: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of all texts and the pairs of lines inside distinct chunks and across borders: rows and repeated parts as _deduped takes them.

    idx: struct(at: first line from 0, n: lines). A pair inside a chunk that stands earlier is no row: its two lines go with the chunk,
    and where the pair is first, its chunk is first too.
    """

    def found(ls: Column, cs: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(ls) - 2), lambda i: F.xxhash64(F.lit(2), F.concat(F.get(ls, i), F.lit("\n"), F.get(ls, i + 1))))

        def part(c: Column, p: Column) -> Column:
            at = c["first"] - 1
            return F.struct(F.struct(at.alias("at"), c["n"].alias("n")).alias("idx"), F.xxhash64(_joined(ls, c)).alias("h"), F.slice(p, c["first"], c["n"] - 1).alias("inside"), F.get(p, at + c["n"] - 1).alias("across"))

        return let(pairs, lambda p: F.transform(cs, lambda c: part(c, p)))

    def pair(at: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(2).alias("n")).alias("idx")

    where = ["__d", "__t", "__null"]
    cs = cut(texts.select(*where, F.explode(chunks(F.col("text"), window, divisor, found, joined=True)).alias("c")).select(*where, "c.*"))
    firsts = cut(_firsts(cs, "inside"))
    inside = firsts.select("f.*").select(*where, "idx", F.posexplode("inside").alias("k", "h")).select(*where, pair(F.col("idx.at") + F.col("k")), "h")
    across = cs.where("across is not null").select(*where, pair(F.col("idx.at") + F.col("idx.n") - 1), F.col("across").alias("h"))
    pairs = inside.unionByName(across)
    return cs.select(*where, "idx", "h").unionByName(pairs), cut(_repeated(firsts).unionByName(_repeated(_firsts(pairs))))


def dedup_passages(docs: DataFrame, window: int = 2, divisor: int = 3, added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs as :func:`dedup_lines` gives them, without any line of a run of two or more lines that stands earlier.

    Chunks have two lines or more here, so a repeated text goes whole by its chunks; every later chunk goes. Of what is
    left, each pair of neighbouring lines that occurs more than once stays where it is first (smallest doc_id, then
    earliest); the two lines of every other one go. All are removed after their bytes were compared. All that
    dedup_lines removes goes too, and each line that goes stays somewhere else. Of a run that repeats within itself
    (a, a, a) its first line stays. The result does not depend on where the borders fall.
    """
    lines = F.split("text", "\n", -1)
    joined = lambda ls, idx: F.array_join(F.slice(ls, idx["at"] + 1, idx["n"]), "\n")

    def stays(ls: Column) -> Column:
        same = F.filter("__r", lambda r: r["kept"] == joined(ls, r["idx"]))
        gone = F.flatten(F.transform(same, lambda r: F.sequence(r["idx"]["at"], r["idx"]["at"] + r["idx"]["n"] - 1)))
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone)
        return F.struct(F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n").alias("text"), F.size(ls).alias("n"), F.size(left).alias("kept"))

    fetched = let(lines, lambda ls: F.transform("__w", lambda w: F.struct(w["h"].alias("h"), joined(ls, w["idx"]).alias("kept"))))
    return _deduped(docs, lambda texts: passage_parts(texts, window, divisor), fetched, let(lines, stays), added)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {
    "op5_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
w AS (SELECT *, lag(h) OVER (PARTITION BY doc_id ORDER BY i) AS p, max(i) OVER (PARTITION BY doc_id) AS last FROM h),
b AS (SELECT *, i = last OR coalesce((((p % 1000003) * 257 + h) % 1000003) % 3 = 0, false) AS ends FROM w),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM b),
c AS (SELECT doc_id, idx, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS part FROM g GROUP BY doc_id, idx),
r AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY part ORDER BY doc_id, idx) > 1 AS gone FROM c),
k AS (SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '') AS text, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed FROM r GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
}
