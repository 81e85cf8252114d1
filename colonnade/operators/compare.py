"""Comparing computed with expected values, counting by stage, and reporting."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same_digits(a: Column, b: Column, digits: int) -> Column:
    """Equal to so many significant digits (half a unit of the last one, slightly widened)."""
    zero = (a == 0) | (b == 0)
    return (a == b) | F.when(zero, F.abs(a - b) < F.lit(10.0 ** -(digits + 6))).otherwise(F.abs(a - b) <= F.abs(b) * F.lit(10.0 ** -(digits - 1) * 0.5000001))


def compare_class(expected_kind: Column, expected: Column, status: Column, value: Column, err: Column, precise: Column | None = None) -> Column:
    """Class of one cell. expected_kind: number, text, bool or error; status: ok, refused or crashed; precise: a high-precision result."""
    e, v = expected.try_cast("double"), value.try_cast("double")
    errors = F.when(status == "crashed", "differs:crash-for-error").when(status == "refused", "agrees:refused-for-error").when(err.isNotNull(), "agrees:error").otherwise("differs:value-for-error")
    numeric = F.when(e.isNull(), "skipped:unparseable").when(err.isNotNull(), "differs:error-for-number").when(v.isNull(), "differs:not-a-number").when(v == e, "agrees:exact").when(same_digits(v, e, 15), "agrees:15-digits")
    if precise is not None:
        numeric = numeric.when(same_digits(precise, v, 15) & ~same_digits(precise, e, 15), "differs:semantic").when(same_digits(precise, e, 15), "differs:float-accumulation")
    rest = F.when(status != "ok", F.concat(F.lit("differs:"), status)).when(expected_kind == "text", F.when(value.eqNullSafe(expected), "agrees:text").otherwise("differs:text")).when(expected_kind == "bool", "differs:bool")
    return F.when(expected_kind == "error", errors).otherwise(F.coalesce(rest, numeric.otherwise("differs:other")))


def ladder(df: DataFrame, stages: list[tuple[str, Column]], name: str = "stage") -> DataFrame:
    """Adds the first stage whose condition holds, else ``kept``: an exclusion ladder."""
    out = F.lit("kept")
    for stage, condition in reversed(stages):
        out = F.when(condition, stage).otherwise(out)
    return df.withColumn(name, out)


def rollup(df: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias(weight)] if weight else []))


def shard_faults(shards: DataFrame, n_shards: int) -> DataFrame:
    """Shards (shard, settings) that must not be merged: (fault, shard) of duplicates, missing ones and mixed settings."""
    every = shards.sparkSession.range(n_shards).select(F.col("id").alias("shard"))
    twice = shards.groupBy("shard").count().where("count > 1").select(F.lit("duplicate").alias("fault"), "shard")
    gone = every.join(shards.select("shard").distinct(), "shard", "left_anti").select(F.lit("missing").alias("fault"), "shard")
    least = shards.agg(F.min("settings").alias("first"))
    mixed = shards.join(F.broadcast(least)).where("settings <> first").select(F.lit("mixed-settings").alias("fault"), "shard").distinct()
    return twice.union(gone).union(mixed)


def pooled(df: DataFrame, value: str, of: str) -> DataFrame:
    """n, median, p90 (the element at int(0.9 n) in order, not interpolated) and the ratio of the sums of value and of."""
    n = df.where(F.col(value).isNotNull()).count()
    exact = F.expr(f"percentile({value}, 0.5)").alias("median")
    at = int(n * 0.9)
    ranked = F.expr(f"percentile_disc({min(1.0, (at + 1) / n) if n else 0.5}) within group (order by {value})").alias("p90")
    return df.agg(F.count(value).alias("n"), exact, ranked, F.try_divide(F.sum(value), F.sum(of)).alias("ratio"))


def stratified_estimate(df: DataFrame, stratum: str, hit: Column, sizes: DataFrame) -> DataFrame:
    """Share of hits weighted by the strata's true sizes (stratum, size)."""
    per = df.groupBy(stratum).agg(F.avg(hit.cast("double")).alias("share"))
    return per.join(sizes, stratum).agg((F.sum(F.col("share") * F.col("size")) / F.sum("size")).alias("estimate"))


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial."""
    if p <= 0 or p >= 1:
        return float(k <= (0 if p <= 0 else n))
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    return math.fsum(math.exp(x) for x in logs)


def _bound(k: int, n: int, target: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _tail(k, n, mid) < target else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.StructType().add("low", "double").add("high", "double"))
def exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Clopper-Pearson interval at 95 %."""
    ends = [(0.0 if a == 0 else _bound(a, b, 0.025), 1.0 if a == b else _bound(a + 1, b, 0.975)) for a, b in zip(k, n, strict=True)]
    return pd.DataFrame(ends, columns=["low", "high"])


def agreement(first: DataFrame, second: DataFrame, decided: DataFrame, item: str, label: str) -> DataFrame:
    """Items labelled twice: (item, final, how): the common label, else the adjudicated one."""
    a, b, c = (d.select(item, F.col(label).alias(t)) for d, t in ((first, "a"), (second, "b"), (decided, "c")))
    both = a.join(b, item).join(c, item, "left")
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.select(item, F.when(same, F.col("a")).otherwise(F.col("c")).alias("final"), F.when(same, "agreed").when(F.col("c").isNotNull(), "adjudicated").otherwise("open").alias("how"))


def stratified_sample(df: DataFrame, stratum: list[str], item: str, cap: int, seed: int = 1) -> DataFrame:
    """At most cap items of each stratum, by a seeded hash."""
    n = F.row_number().over(Window.partitionBy(*stratum).orderBy(F.xxhash64(F.lit(seed), F.col(item)), item))
    return df.withColumn("__n", n).where(F.col("__n") <= cap).drop("__n")


def signatures(df: DataFrame, reason: str, example: str) -> DataFrame:
    """Refusals by reason: how many, and the first example."""
    return df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("example")).orderBy(F.desc("n"), reason)


def depth_by_gap(versions: DataFrame, file: str, gaps: list[int]) -> DataFrame:
    """(gap, files): files with at least gap + 1 versions."""
    depth = versions.groupBy(file).agg(F.count(F.lit(1)).alias("depth"))
    g = F.explode(F.array(*map(F.lit, gaps))).alias("gap")
    return depth.select("depth", g).groupBy("gap").agg(F.sum((F.col("depth") >= F.col("gap") + 1).cast("long")).alias("files"))


def true_merges(commits: DataFrame) -> DataFrame:
    """Commits (version, parent1, parent2, base, blob, blob1, blob2, blob0) of which both sides differ from the base."""
    return commits.where("parent2 is not null and blob1 <> blob0 and blob2 <> blob0 and blob1 <> blob2")


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many different values each column has; nulls are no value."""
    return df.agg(*(F.countDistinct(c).alias(c) for c in columns))


def distinct_facts(df: DataFrame, fact: list[str], item: str) -> DataFrame:
    """Each different fact once (null equals null), with how often it stands and its least item."""
    return df.groupBy(*fact).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first"))


def top(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent combinations, ties in ascending order (null first). Each task keeps k rows; nothing is sorted as a whole."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(k)


def ledger_summary(df: DataFrame, ledger: str, refused: Column, carried: str, rows: str) -> DataFrame:
    """Per ledger: versions, those refused and their share, and the share of rows carried over among those that were not."""
    ok = ~F.coalesce(refused, F.lit(False))
    n, bad = F.count(F.lit(1)), F.count(F.when(~ok, 1))
    return df.groupBy(ledger).agg(n.alias("versions"), bad.alias("refused"), (bad / n).alias("refusal_rate"), F.try_divide(F.sum(F.when(ok, F.col(carried))), F.sum(F.when(ok, F.col(rows)))).alias("carriage"))
