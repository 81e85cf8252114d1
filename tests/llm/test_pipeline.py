"""The pipeline stage by stage, and the queries that SQL can express."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade import llm
from colonnade.llm import contamination, linechunks, toxicity
from tests.llm.test_small import kept_by_definition
from tests.test_catalog import plain

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for n in os.listdir(DIR):
        con.execute(f"CREATE VIEW {n.partition('.')[0]} AS SELECT * FROM '{DIR}/{n}'")
    df = llm.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    relation = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({llm.oracle_sql()[name]})")
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == sorted((tuple(map(plain, r)) for r in relation.fetchall()), key=repr)


def test_stages_by_definition(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    was, now = seen["toxicity"]
    scorer = toxicity.fit(spark.read.parquet(f"{DIR}/documents.parquet"), toxicity.toxic_labels(spark, DIR))
    assert set(now) == {i for i, t in was.items() if scorer.score(t) < 0.3} and len(now) > 0.8 * len(was)
    was, now = seen["line_dedup"]
    assert all(len(r["text"]) == r["n_chars"] for r in now.values()) and len(now) >= 0.9 * len(was)
    was, now = seen["near_duplicates"]
    assert set(now) == kept_by_definition(sorted(was.items()))
    was, now = seen["decontamination"]
    items = [contamination.tokens(r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    dirty = set()
    for i, t in was.items():
        w = contamination.tokens(t)
        grams = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        for b in items:
            if any(tuple(b[j : j + 3]) in grams for j in range(len(b) - 2)) and sum(n for *_, n in contamination.tile(b, w, 3)) >= 0.6 * len(b):
                dirty.add(i)
    assert set(now) == set(was) - dirty and dirty
    was, now = seen["mixing"]
    assert all(r["copies"] >= 1 and r["taken"] == r["copies"] * len(was[i].split()) for i, r in now.items())


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and {"doc_id", "text", "taken"} <= set(got.columns)


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "w " * 100_000, "en", "s", 200_000), (4, "a\nb\na\nb", "en", "t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, part in enumerate((docs, docs.limit(0))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, "/root/testdata/sf0.001")
            path = str(tmp_path / f"{name}{n}")
            out.write.parquet(path)
            part = spark.read.parquet(path)


def test_no_exact_copy_is_left_as_a_fragment(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first, copies = {}, set()
    for r in docs.orderBy("doc_id").collect():
        if r["text"] is not None and "\n" in r["text"] and first.setdefault(r["text"], r["doc_id"]) != r["doc_id"]:
            copies.add(r["doc_id"])
    left = {r["doc_id"] for r in corpus_pipeline.without_repeated_lines(spark, docs, DIR).collect()}
    assert copies and not copies & left


def test_near_duplicates_are_pairs_of_0_8(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert {r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, DIR).collect()} == kept_by_definition(rows)


def test_columns_named_like_the_stages_own_are_kept(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", "s"), (2, "a\nb\nd", "s"), (3, "x y z", "t")], "doc_id long, text string, source string")
    own = "r w k h c idx kept n f fd ft fi score n_lines n_removed node size fps bits u v su sv root linked g fp nth lead key".split()
    docs = docs.withColumns({n: F.lit(7.5) for n in own})
    assert linechunks.dedup_lines(docs).drop("n_lines", "n_removed").collect()[0]["r"] == 7.5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == 3 and all(r[n] == 7.5 for r in rows for n in own)


def test_line_dedup_stage_compares_content_defined_chunks(spark, monkeypatch):
    cut_by, real = [], linechunks.chunks
    monkeypatch.setattr(linechunks, "chunks", lambda text, window, divisor, *more, **named: cut_by.append((window, divisor)) or real(text, window, divisor, *more, **named))
    docs = spark.createDataFrame([(1, "a\nb\nc", "s"), (2, "z\na\nb\ny", "s"), (3, "a\nb\nc", "s")], "doc_id long, text string, source string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeated_lines(spark, docs, DIR).collect()}
    assert cut_by == [(2, 3)] and left == {1: "a\nb\nc", 2: "z\ny"}
