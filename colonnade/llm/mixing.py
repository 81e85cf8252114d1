"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Whole copies of all its documents that fit under the target
are certain. What is left is drawn from its documents: each has an inclusion probability p, a permanent
random number u, and the rank value q = [u / (1 - u)] / [p / (1 - p)]; the documents of lowest q make up a
sample of fixed size, counted in words, that ends at the document which brings it nearest to the target.
``importance`` makes the probabilities unequal within a source too (p grows with it, at most 1).

The cut-off on q is found by bucket sums that narrow down in four passes over (source, key, size) rows, so a
source with most of all rows is only ever summed, never sorted or gathered in one task. Each document then
decides for itself from its source's three numbers.

Defined cases: a null text has size 0; a null source is a source, sorted last; a null doc_id draws by its
text; repeated rows (same doc_id) share one draw and are taken or left together; an empty table gives an
empty result; other columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from colonnade.functions.prefix import global_row_number
from colonnade.functions.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Per-source rows are broadcast up to this number (about 100 bytes each); beyond it they are joined by shuffle.
SMALL = 50_000
ADDED = ("size", "source_size", "target", "copies", "taken")
KEY_BITS, STEP_BITS = 52, 13


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... in the order of the sources."""
    return ((rank - 1) % 3 + 1).cast("long")


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    """Permanent random number, uniform in (0, 1): 52 bits of an MD5 of the seed and the document's id."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << KEY_BITS))


def source_targets(sizes: DataFrame, max_copies: int, weight: Callable[[Column], Column]) -> DataFrame:
    """Per source (rows: __source, source_size): its weight's share of all words, at most max_copies times its own, the excess shared again."""
    ranked = cut(global_row_number(sizes, [F.col("__source").asc_nulls_last()], "__rank").withColumn("__weight", weight(F.col("__rank"))).drop("__rank"))
    cap = F.lit(max_copies) * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else cap < F.lit(level) * F.col("__weight")
        left, open_weight = ranked.agg(F.lit(total) - F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("__weight"))), F.lit(0))).first()
        now = float(left) / float(open_weight) if open_weight else 0.0
        if now == level or not open_weight:
            break
        level = now
    return ranked.withColumn("target", F.least(cap.cast("double"), F.lit(level or 0.0) * F.col("__weight"))).drop("__weight")


def _cutoffs(keyed: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """Per source the cut-off: keys below __cut are drawn, the documents at __cut too if __with. plan: __source, __need."""
    found = plan.withColumn("__low", F.lit(0).cast("long")).withColumn("__got", F.lit(0).cast("long")).where(F.col("__need") > 0)
    same = lambda a, b: a["__source"].eqNullSafe(b["__source"])
    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        k, f = keyed.alias("k"), found.alias("f")
        inside = k.join(F.broadcast(f) if small else f, same(keyed, found) & (F.shiftright("k.__key", shift + STEP_BITS) == F.shiftright("f.__low", shift + STEP_BITS)))
        sums = inside.groupBy(F.col("f.__source").alias("__source"), "f.__need", "f.__got", F.shiftright("k.__key", shift).alias("__b")).agg(F.sum("k.size").alias("__words"))
        upto = F.sum("__words").over(Window.partitionBy("__source").orderBy("__b"))
        reached = sums.withColumn("__upto", F.col("__got") + upto).where(F.col("__upto") >= F.col("__need"))
        first = Window.partitionBy("__source").orderBy("__b")
        found = cut(reached.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("__source", "__need", F.shiftleft("__b", shift).alias("__low"), (F.col("__upto") - F.col("__words")).alias("__got"), F.col("__words")))
    nearest = (F.col("__got") + F.col("__words") - F.col("__need")) <= (F.col("__need") - F.col("__got"))
    return found.select("__source", F.col("__low").alias("__cut"), nearest.alias("__with"))


def mix_sources(docs: DataFrame, weight: Callable[[Column], Column] = cyclic_weight, max_copies: int = 3, seed: int = 7, importance: Column | None = None) -> DataFrame:
    """All rows of docs with size, source_size, target, copies and taken (words the mix takes, repeats counted).

    weight: from a source's rank by code point to its weight. importance: relative inclusion odds of a
    document within its source; without it all documents of a source are equally likely.
    """
    sized = docs.drop(*ADDED).withColumn("size", word_count(F.col("text"))).withColumn("__u", _draw(seed, F.col("doc_id"), F.col("text"))).withColumn("__i", importance if importance is not None else F.lit(1.0))
    slim = cut(sized.select(F.col("source").alias("__source"), "size", "__u", "__i"))
    sources = slim.groupBy("__source").agg(F.sum("size").cast("long").alias("source_size"), F.try_divide(F.sum(F.col("size") * F.col("__i")), F.sum("size")).alias("__mean"))
    target = source_targets(sources, max_copies, weight)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = cut(target.withColumn("__whole", whole).withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size")))
    small = plan.count() <= SMALL
    sent = lambda d: F.broadcast(d) if small else d

    def keyed(rows: DataFrame) -> DataFrame:
        """Adds the order key: q / (1 + q) on 52 bits, which keeps the order of q."""
        p = F.least(F.lit(1.0 - 2.0**-30), F.col("__need") / F.col("source_size") * (F.col("__i") / F.col("__mean")))
        q = (F.col("__u") / (F.lit(1.0) - F.col("__u"))) / (p / (F.lit(1.0) - p))
        return rows.withColumn("__key", F.when((F.col("__need") > 0) & (F.col("__i") > 0), F.floor(q / (F.lit(1.0) + q) * F.lit(float(1 << KEY_BITS))).cast("long")))

    a, b = slim.alias("a"), plan.alias("b")
    slim_keys = keyed(a.join(sent(b), F.col("a.__source").eqNullSafe(F.col("b.__source"))).select("a.*", "b.source_size", "b.__need", "b.__mean")).where(F.col("__key").isNotNull()).select("__source", "size", "__key")
    c = _cutoffs(cut(slim_keys), plan.select("__source", "__need"), small).alias("c")
    decided = b.join(c, F.col("b.__source").eqNullSafe(F.col("c.__source")), "left").select("b.*", "c.__cut", "c.__with").alias("s")
    out = keyed(sized.join(sent(decided), sized["source"].eqNullSafe(F.col("s.__source"))))
    drawn = F.coalesce((F.col("__key") < F.col("__cut")) | ((F.col("__key") == F.col("__cut")) & F.col("__with")), F.col("__key").isNotNull())  # no cut-off: the eligible hold fewer words than needed, all are drawn
    out = out.withColumn("copies", (F.col("__whole") + drawn.cast("long")).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED), *ADDED)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op10_mix": op10_mix}
SQL = {
    "op10_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS j FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s2),
s4 AS (SELECT *, (total - capped)::DOUBLE / open_weight::DOUBLE AS level FROM s3),
lev AS (SELECT level FROM s4 WHERE level * w <= 3 * source_size ORDER BY j LIMIT 1),
s5 AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM lev), 0.0) * w) AS target FROM s1),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s5),
s7 AS (SELECT *, target - whole * source_size AS need FROM s6),
k0 AS (SELECT d.doc_id, d.size, d.u, s7.* FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
k1 AS (SELECT *, least(1.0::DOUBLE - power(2.0::DOUBLE, -30), need / source_size) AS p FROM k0),
k2 AS (SELECT *, CASE WHEN need > 0 THEN (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) END AS q FROM k1),
k3 AS (SELECT *, CASE WHEN need > 0 THEN floor(q / (1.0::DOUBLE + q) * 4503599627370496.0::DOUBLE)::BIGINT END AS key FROM k2),
g AS (SELECT source, key, need, sum(size) AS words FROM k3 WHERE key IS NOT NULL GROUP BY source, key, need),
h AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY key) AS upto FROM g),
cutoff AS (SELECT source, key AS cut, (upto - need) <= (need - (upto - words)) AS with_it FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key) AS n FROM h WHERE upto >= need) WHERE n = 1),
r AS (SELECT k3.*, whole + CASE WHEN key < cut OR (key = cut AND with_it) THEN 1 ELSE 0 END AS copies FROM k3 LEFT JOIN cutoff ON k3.source IS NOT DISTINCT FROM cutoff.source)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM r
"""
}
