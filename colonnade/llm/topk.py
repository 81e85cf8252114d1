"""Exact top-k search by inner product with a pivot table.

d(q, p) and d(x, p), the distances of query and candidate to each of many pivots p, are computed once per
vector. The largest |d(q, p) - d(x, p)| is a lower bound of d(q, x), and because
2 q.x = |q|^2 + |x|^2 - d(q, x)^2 it gives an upper bound of the score. Three steps use it:

1. A bounded sample of rows is scored for every query; the k-th best of those scores is a floor that the result
   can't fall below.
2. Rows are dealt into blocks by their nearest pivot. The ranges of a block's distances bound all its scores; a query
   goes only to the blocks whose bound reaches its floor. Only summaries meet all queries here, not rows.
3. In a block, candidates are scored in the order of their own bounds until these fall below the floor or the k-th best
   score so far; equal bounds are still scored, for ties.

How much that saves depends on the vectors: of rows in clusters most are never scored, of vectors alike in all directions
(as random ones in many dimensions) nearly all bounds stay above the k-th score, and nearly all rows are.

Scores are exact integers. Where float arithmetic could round (components from 2^22 on, or sums from 2^53 on) Python's
integers are used, and such vectors are never eliminated by a bound. A score that no long can hold is ranked
by its exact value and returned as the nearest long.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; vectors are
compared with those of equal dimension (of dimension 0: score 0); repeated rows (same id, same vector) count
once; candidates with the query's own id are never its results; fewer than k candidates give fewer rows; a
null id takes no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.shared import cut

RESULT = "query_id long, rank int, vec_id long, score long"
#: A component from here on makes its vector a large one; distances are taken of components cut to CLIP.
LARGE, CLIP = 2.0**22, 2.0**40
LONG = 1 << 63
_FOUND = "query_id long, vec_id long, score long, big binary"


def _stack(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """To the pivots, each cut or filled with zeros to the vectors' dimension."""
    dim = x.shape[1]
    p = np.zeros((len(pivots), dim))
    p[:, : pivots.shape[1]] = np.clip(pivots[:, :dim], -CLIP, CLIP)
    x = np.clip(x, -CLIP, CLIP)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0)).astype(np.float32)


class Rows:
    """Candidates of one dimension: ids, components, pivot distances."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pv: np.ndarray) -> None:
        self.ids, self.x, self.pv = ids, x, np.ascontiguousarray(pv.T)
        self.square = (x * x).sum(1) if x.size else np.zeros(len(ids))
        self.most = np.abs(x).max(axis=1, initial=0.0)
        self.large = self.most >= LARGE
        self.scored = 0

    def scores(self, part: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact; as floats where all sums stay under 2^53, else as Python's integers."""
        self.scored += len(part)
        if float(self.most[part].max(initial=0.0)) * float(np.abs(q).max(initial=0.0)) * max(1, len(q)) < 2.0**53:
            return self.x[part] @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(r, q.tolist(), strict=True)) for r in self.x[part].tolist()], object)

    def best(self, own: np.ndarray, q: np.ndarray, qpv: np.ndarray, floors: np.ndarray, k: int, batch: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of its k best candidates, of those that can reach its floor."""
        for at in range(0, len(own), 32):
            part = slice(at, at + 32)
            low = np.zeros((len(own[part]), len(self.ids)), np.float32)
            for p, row in enumerate(self.pv):
                np.maximum(low, np.abs(row[None] - qpv[part, p][:, None]), out=low)
            low = np.maximum(low - np.float32(1e-6) * (np.abs(self.pv).max(initial=0) + np.abs(qpv[part]).max(initial=0)), 0).astype(np.float64)
            qq = (q[part] * q[part]).sum(1)[:, None]
            with np.errstate(over="ignore", invalid="ignore"):
                high = (self.square[None] + qq - low * low) / 2 + 1e-9 * np.maximum(self.square[None], qq) + 1e-3  # above any rounding of the distances
            high[:, self.large] = np.inf
            high[np.abs(q[part]).max(axis=1, initial=0.0) >= LARGE] = np.inf
            for i, h in enumerate(high):
                yield self._ordered(own[at + i], q[at + i], h, floors[at + i], k, batch)

    def _ordered(self, own: int, q: np.ndarray, high: np.ndarray, floor: float, k: int, batch: int) -> tuple[np.ndarray, np.ndarray]:
        use = np.flatnonzero((high >= floor) & (self.ids != own))
        use = use[np.argsort(-high[use], kind="stable")]
        ids, best = np.zeros(0, np.int64), np.zeros(0)
        for at in range(0, len(use), batch):
            full = len(best) == k
            if full and high[use[at]] < best[-1]:
                break
            part = use[at : at + batch]
            s = self.scores(part, q)
            near = s >= best[-1] if full else np.ones(len(part), bool)
            ids, best = np.concatenate([ids, self.ids[part[near]]]), np.concatenate([best, s[near]])
            keep = np.lexsort((ids, -best))[:k] if best.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-best[i], ids[i]))[:k], np.int64)
            ids, best = ids[keep], best[keep]
        return ids, best


def _found(own: np.ndarray, results: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """big: where no long holds the score, bytes that are ordered as the scores are."""
    qs, ids, scores, big = [], [], [], []
    for q, (x, s) in zip(own.tolist(), results, strict=True):
        for i, v in zip(x.tolist(), map(int, s), strict=True):
            fits = -LONG <= v < LONG
            qs.append(q), ids.append(i), scores.append(v if fits else LONG - 1 if v > 0 else -LONG)
            big.append(None if fits else (v + (1 << 2200)).to_bytes(280, "big"))
    return pa.table({"query_id": pa.array(qs, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64()), "big": pa.array(big, pa.binary())})


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, dim, v, pv, square, cell): pv the distances to the pivots, cell the nearest one; square is infinite for large vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim in b.column(1).unique().to_pylist():
                g = b.filter(pc.equal(b.column(1), dim))
                x = _stack(g.column(2), dim)
                pv = distances(x, pivots)
                square = np.where(np.abs(x).max(axis=1, initial=0.0) >= LARGE, np.inf, (np.clip(x, -CLIP, CLIP) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*g.columns, _lists(pv, pa.float32()), pa.array(square), pa.array(pv.argmin(1).astype(np.int32))], names=["vec_id", "dim", "v", "pv", "square", "cell"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v array<double>, pv array<float>, square double, cell int")


def with_floors(asked: DataFrame, ids: np.ndarray, sample: list[list[float]], pivots: np.ndarray, k: int) -> DataFrame:
    """asked with floor: the k-th best score among the sample's rows, -inf where there are fewer."""
    by_dim: dict[int, list[int]] = {}
    for i, v in enumerate(sample):
        by_dim.setdefault(len(v), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Rows] = {}
        for dim, at in by_dim.items():
            x = np.array([sample[i] for i in at]).reshape(len(at), dim)
            held[dim] = Rows(ids[at], x, distances(x, pivots))
        for b in batches:
            floors = np.full(b.num_rows, -np.inf)
            dims = b.column(1).to_numpy()
            for dim, rows in held.items():
                at = np.flatnonzero(dims == dim)
                g = b.take(pa.array(at))
                q, pv = _stack(g.column(2), dim), _stack(g.column(3), len(pivots))
                for i, (_, s) in zip(at, rows.best(g.column(0).to_numpy(), q, pv, np.full(len(at), -np.inf), k), strict=True):
                    if len(s) == k:
                        floors[i] = np.nextafter(float(min(max(s[-1], -(10**300)), 10**300)), -np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors)], names=[*b.schema.names, "floor"])

    return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("floor", T.DoubleType())]))


def needed(asked: DataFrame, blocks: DataFrame, n_asked: int, n_blocks: int, pivots: int, query_block: int, at_once: int = 4096) -> DataFrame:
    """asked with rb: once for each block that can hold a score at or above the floor. blocks: dim, rb, square (most), lo, hi (of each distance)."""
    g_asked, g_blocks = -(-n_asked // query_block) or 1, -(-n_blocks // at_once) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(g_asked)).cast("int")).withColumn("sb", every(g_blocks))
    right = blocks.withColumn("sb", F.pmod(F.col("rb"), F.lit(g_blocks)).cast("int")).withColumn("qb", every(g_asked))

    names = asked.columns

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, rb, square = a.select(names).combine_chunks(), b.column("rb").combine_chunks(), b.column("square").to_numpy()
        own, lo, hi = (_stack(t.column(c).combine_chunks(), pivots) for t, c in ((a, "pv"), (b, "lo"), (b, "hi")))
        out = []
        for i, (qq, floor) in enumerate(zip(a.column("square").to_numpy(), a.column("floor").to_numpy(), strict=True)):
            gap = np.maximum(np.maximum(lo - own[i], own[i] - hi), 0).max(axis=1, initial=0.0)
            low = np.maximum(gap.astype(np.float64) - 1e-6 * (np.abs(own[i]).max(initial=0) + np.abs(hi).max(initial=0)), 0)
            with np.errstate(invalid="ignore"):
                high = (square + qq - low * low) / 2 + 1e-9 * np.maximum(square, qq) + 1e-3
            use = np.flatnonzero(~(high < floor))
            out.append((np.full(len(use), i), use))
        i, j = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in (0, 1))
        return a.take(pa.array(i)).append_column("rb", rb.take(pa.array(j)))

    return left.groupBy("dim", "qb", "sb").cogroup(right.groupBy("dim", "qb", "sb")).applyInArrow(run, T.StructType([*asked.schema.fields, T.StructField("rb", T.LongType())]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32, query_block: int = 2048, row_block: int = 8192, sample: int = 2048) -> DataFrame:
    """vectors, queries: vec_id long, v array of integers (as longs or doubles). Rows of RESULT, rank from 1, ties to the smaller vec_id.

    pivots, sample: how many; they are the vectors of least hash. query_block, row_block: a task holds about so many.
    """
    clean = lambda d: d.where("vec_id is not null and v is not null").select("vec_id", F.size("v").alias("dim"), F.col("v").cast("array<double>").alias("v")).dropDuplicates()
    base = clean(vectors)
    chosen = base.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(max(sample, pivots)).select("vec_id", "v").collect()
    width = max((len(r["v"]) for r in chosen[:pivots]), default=0)
    table = np.array([list(r["v"]) + [0.0] * (width - len(r["v"])) for r in chosen[:pivots]]).reshape(len(chosen[:pivots]), width)
    if not chosen:
        return vectors.sparkSession.createDataFrame([], RESULT)
    room = max(k + 1, (1 << 22) // max(1, *(len(r["v"]) for r in chosen)))  # the sample stays under 32 MB however long its vectors are
    seen = [list(r["v"]) for r in chosen[:room]]
    rows = with_pivots(base, table)
    asked = cut(with_floors(with_pivots(clean(queries), table).drop("cell"), np.array([r["vec_id"] for r in chosen[:room]], np.int64), seen, table, k))
    rows = cut(rows)
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(row_block)).alias("slices"))
    dealt = rows.join(sizes, ["dim", "cell"]).select("vec_id", "dim", "v", "pv", "square", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("slices"))).alias("rb"))
    ends: list[Column] = [f(F.col("pv")[i]).alias(f"{n}{i}") for i in range(len(table)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    blocks = dealt.groupBy("dim", "rb").agg(F.max("square").alias("square"), *ends)
    blocks = cut(blocks.select("dim", "rb", "square", *(F.array(*(f"{n}{i}" for i in range(len(table)))).alias(n) for n in ("lo", "hi"))))
    wants = cut(needed(asked, blocks, asked.count(), blocks.count(), len(table), query_block))
    per = cut(wants.groupBy("dim", "rb").agg(F.ceil(F.count(F.lit(1)) / F.lit(query_block)).alias("parts")))
    part, parts = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    left = wants.join(per, ["dim", "rb"]).select("dim", "rb", part.alias("qb"), "vec_id", "v", "pv", "floor")
    right = dealt.join(per.toDF("d", "b", "parts"), (F.col("dim") == F.col("d")) & (F.col("rb") == F.col("b"))).select("dim", "rb", parts.alias("qb"), "vec_id", "v", "pv")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _found(np.zeros(0, np.int64), iter(()))
        dim = a.column("dim")[0].as_py()
        of = lambda t: (t.column("vec_id").to_numpy(), _stack(t.column("v").combine_chunks(), dim), _stack(t.column("pv").combine_chunks(), len(table)))
        own, q, pv = of(a)
        return _found(own, Rows(*of(b)).best(own, q, pv, a.column("floor").to_numpy(), k))

    near = left.groupBy("dim", "rb", "qb").cogroup(right.groupBy("dim", "rb", "qb")).applyInArrow(search, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("big"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with v: floor(256 x) of each component, as doubles, which hold it exactly; vectors with a component that is no finite number have null."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def floored(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # from 2^52 on a double is an integer

    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.when(F.forall("embedding", finite), F.transform("embedding", floored)).alias("v"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark, sf_dir)
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op2_top_k": op2_top_k}
SQL = {
    "op2_top_k": """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM e q JOIN e x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
