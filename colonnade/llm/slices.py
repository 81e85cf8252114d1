"""Equi-joins in which frequent keys are dealt in slices, so that no task gets a group that grows with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is dealt in slices; so many keys can be frequent at most.
HEAVY = 1_000


def sliced_join(rows: DataFrame, per_key: DataFrame, on: list[str], n: str, spread: list[str]) -> DataFrame:
    """rows joined (inner) with per_key, which has one row for each key, and in n how many of the rows have that key.

    A key of more than a HEAVY-th of all those rows is dealt by the columns ``spread`` to slices of about so
    many, and its row of per_key is repeated for each. No more than HEAVY keys can be so frequent, so they are
    broadcast whatever the input's size, and no more than twice HEAVY rows are repeated. per_key is read three times:
    it should be written before. Null keys meet nothing; without rows the result is empty.
    """
    share = max(1, -(-(per_key.agg(F.sum(n)).first()[0] or 0) // HEAVY))
    slices = F.ceil(F.col(n) / F.lit(share))
    heavy = per_key.where(F.col(n) > share).select(*on, slices.alias("__slices"))
    dealt = rows.join(F.broadcast(heavy), on, "left").withColumn("__slice", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__slices")), F.lit(0).cast("long")))
    repeated = per_key.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    return dealt.drop("__slices").join(repeated, [*on, "__slice"]).drop("__slice")
