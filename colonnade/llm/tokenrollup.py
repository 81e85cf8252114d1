"""Token counts in delta-maintained rollups.

A store holds two kinds of rows, both additive: the ledger (document, source, language, tokenizer version ->
signed documents, tokens, characters) and the totals by source, language and tokenizer version. A batch of
changes becomes signed rows: an insert adds, a delete takes back all that the ledger holds of the document,
a revised count takes that back and adds the new one. Totals are sums of the batches' deltas; nothing that was
counted before is counted again.

A batch is written under its id and is committed by a marker written last. A batch whose marker is there is
not applied again; one without (a writer died) is invisible to readers and is overwritten when it
is tried again, so commits are idempotent. An id that comes back with other changes is refused. The store has one writer at a time.

The ledger is laid out in ``BUCKETS`` by document, and a commit reads those that its documents fall in. :meth:`RollupStore.compact`
folds all batches into one (their ids stay known), so that reads do not grow with the number of batches.

Defined cases: a null text counts 0 tokens and 0 characters; null source or language is a group of its own;
a null doc_id is one document per source and language; within a batch repeated rows of a document add
up; inserting a document that is there revises it; deleting or revising one that is not there takes nothing
back; groups whose totals are all 0 are left out of the rollup; an empty batch commits.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import cut, fresh_path

#: Fixed value: the public split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
GROUP, SUMS = ("source", "lang", "tokenizer"), ("n_docs", "n_tokens", "n_chars")
BUCKETS = 64
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"


def token_counts(docs: DataFrame, version: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, n_chars of whole texts. The vocabulary is read once, on the driver, and sent along."""
    with open(vocabulary, "rb") as f:
        packed = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, packed.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n, pa.int64()), b.column(4)], names=["doc_id", "source", "lang", "n_tokens", "n_chars"])

    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return slim.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_chars long").withColumn("tokenizer", F.lit(version))


class RollupStore:
    """A store under ``path``, which every executor must be able to reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[tuple[str, str]]:
        """(batch id, digest of its changes) of all markers; a compaction's id is ``~n`` and its file lists what it holds."""
        jvm, fs = self._fs()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return [tuple(n.rsplit("@", 1)) for n in sorted(names) if "@" in n]

    def committed(self) -> dict[str, str]:
        """Batch id -> digest of its changes."""
        return {b: digest for b, digest in self._log() if b[0] != "~"}

    def _held(self) -> list[str]:
        """The batches to read: the last compaction, and those that it does not hold."""
        ids = [b for b, _ in self._log()]
        folds = sorted((b for b in ids if b[0] == "~"), key=lambda b: int(b[1:]))
        if not folds:
            return ids
        inside = {r["value"] for r in self.spark.read.text(f"{self.path}/folds/{folds[-1][1:]}").toLocalIterator()}
        return [folds[-1], *(b for b in ids if b[0] != "~" and b not in inside)]

    def _rows(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={b}" for b in self._held()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """What is counted now, per document; of some buckets only, if they are given."""
        keys = ("doc_id", *GROUP)
        rows = self._rows("ledger", f"{LEDGER}, bucket int")
        rows = rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
        return rows.groupBy(*keys).agg(*(F.sum(s).cast("long").alias(s) for s in SUMS)).where(" or ".join(f"{s} <> 0" for s in SUMS))

    def totals(self) -> DataFrame:
        rows = self._rows("totals", LEDGER.partition(", ")[2])
        return rows.groupBy(*GROUP).agg(*(F.sum(s).cast("long").alias(s) for s in SUMS)).where(" or ".join(f"{s} <> 0" for s in SUMS))

    def _write(self, rows: DataFrame, batch: str) -> None:
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ledger/batch={batch}")
        fixed = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{self.path}/ledger/batch={batch}")
        fixed.groupBy(*GROUP).agg(*(F.sum(s).cast("long").alias(s) for s in SUMS)).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")

    def _mark(self, batch: str, digest: str) -> None:
        jvm, fs = self._fs()
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log"))
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/log/{batch}@{digest}"), True).close()

    def compact(self) -> None:
        """Folds all batches into one. As with a batch its marker comes last: until then readers take the batches themselves."""
        log = self._log()
        n = 1 + max((int(b[1:]) for b, _ in log if b[0] == "~"), default=0)
        self._write(self.ledger(), f"~{n}")
        self.spark.createDataFrame([(b,) for b, _ in log], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folds/{n}")
        self._mark(f"~{n}", "fold")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: op (insert, delete or revise), doc_id, source, lang, tokenizer, n_tokens, n_chars. False if it was committed before.

        A delete needs doc_id and tokenizer only. Batch ids are made of letters, digits, '.', '_' and '-'.
        """
        if not batch or not all(c.isalnum() or c in "._-" for c in batch):
            raise ValueError(f"not a batch id: {batch!r}")
        columns = ("op", "doc_id", *GROUP, "n_tokens", "n_chars")
        changes = changes.select(*columns)
        done = self.committed()
        # counting may be dear: changes are fixed once, before digest, ledger and totals read them
        changes = cut(changes)
        bad = changes.where(~F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"unknown op: {bad[0]['op']!r}")
        n, mark = changes.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))).first()
        digest = f"{n}.{mark}"
        if batch in done:
            if done[batch] != digest:
                raise ValueError(f"batch {batch} was committed with other changes")
            return False
        one = F.when(F.col("op") == "delete", 0).otherwise(1)
        plus = changes.where("op <> 'delete'").select("doc_id", *GROUP, one.cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))
        signed = plus
        if done:
            touched = changes.groupBy("doc_id", "tokenizer").agg(F.count(F.lit(1)).alias("__n")).alias("t")
            near = [r["b"] for r in changes.select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]
            held = self.ledger(near).alias("l")
            same = F.col("l.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("l.tokenizer").eqNullSafe(F.col("t.tokenizer"))
            signed = plus.unionByName(held.join(touched, same, "left_semi").select("doc_id", *GROUP, *((-F.col(s)).alias(s) for s in SUMS)))
        rows = signed.groupBy("doc_id", *GROUP).agg(*(F.sum(s).cast("long").alias(s) for s in SUMS))
        self._write(rows, batch)
        self._mark(batch, digest)
        return True


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of a new store after five batches, each of all documents or half of them, whose net result is the documents as they are.

    All are loaded under a draft's counts (a token too many); half are deleted, the other half revised to what they hold;
    that batch comes a second time and changes nothing; the deleted half is inserted again; the batches are folded into one.
    """
    store = RollupStore(spark, fresh_path(spark, "rollup"))
    counts = cut(token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k"))
    out = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    store.commit("draft", counts.withColumn("op", F.lit("insert")).withColumn("n_tokens", F.col("n_tokens") + 1))
    change = counts.withColumn("op", F.when(out, "delete").otherwise("revise"))
    store.commit("change", change)
    store.commit("change", change)
    store.commit("again", counts.where(out).withColumn("op", F.lit("insert")))
    store.compact()
    return store.totals()


QUERIES = {"op8_token_rollup": op8_token_rollup}
