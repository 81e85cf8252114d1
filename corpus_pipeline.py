"""A cleaning pipeline over documents: toxicity, line dedup, near-duplicates, decontamination, source mix.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. ``run`` writes each
stage's result to the shared folder and reads it again, so a lost executor repeats one stage at most.

Defined cases: as the operators state them. A document that line dedup leaves without any line (each of
them stands elsewhere in the corpus) goes; texts that were empty before stay. Of the mix, documents with at
least one copy are returned, with the columns that the mix adds (input columns of those names are replaced). All
stages before it keep every column, whatever its name (but names may not begin with two underscores nor hold a
dot); where line dedup shortens a text it counts n_chars again, if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import fresh_path
from colonnade.llm.contamination import decontaminate
from colonnade.llm.linechunks import dedup_passages
from colonnade.llm.mixing import mix_sources
from colonnade.llm.similar import one_of_similar
from colonnade.llm.toxicity import fit, toxic_labels, with_scores

TOXIC = 0.3


def quoted(name: str) -> str:
    return f"`{name}`"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = fit(docs, toxic_labels(spark, sf_dir))
    return with_scores(docs, scorer, "__toxicity").where(F.col("__toxicity") < TOXIC).select(*map(quoted, docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = dedup_passages(docs, added=("__lines", "__gone")).where("not (__gone > 0 and __gone = __lines)")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*map(quoted, docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_similar(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).where(F.col("copies") > 0)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]
#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < last:
            path = fresh_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
