"""An extension: running totals over a stream. A late row re-leads every total after it, so its whole group is evaluated again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colonnade.plans.evaluate import evaluate
from colonnade.plans.model import TableDef


def keep_evaluated(stream: DataFrame, table: TableDef, store: str, result: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch to ``store`` (one folder a batch, so a repeated batch overwrites itself) and rewrites the evaluated rows of the groups it touches, as ``result``/batch=n.

    The definition must have a partition: groups are what is evaluated again. ``latest`` reads the result.
    """
    if not table.partition:
        raise ValueError("a partition is needed to bound what late rows touch")
    keys = list(table.partition)

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={n}")
        rows = spark.read.parquet(store).drop("batch")
        touched = spark.read.parquet(f"{store}/batch={n}").select(*keys).distinct()
        evaluate(rows.join(touched, keys, "left_semi"), table).write.mode("overwrite").parquet(f"{result}/batch={n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(result: DataFrame, table: TableDef) -> DataFrame:
    """Rows of the last batch that evaluated their group."""
    last = result.groupBy(*table.partition).agg(F.max("batch").alias("batch"))
    return result.join(last, [*table.partition, "batch"]).drop("batch")
