"""Quality scores by positive-unlabelled learning.

Only trusted positives carry a label; every document is unlabelled web text. The classifier minimises the
non-negative unbiased risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

(logistic loss; where the second part turns negative its gradient is followed backwards). The class prior is
estimated without negatives: a first classifier tells positives from unlabelled text, and the prior is the
smallest ratio over its scores of the unlabelled to the positive share above them, with its sampling error added.

Texts become a fixed number of shape features (shares of character kinds, repetition, lengths). Means,
score histograms and the unlabelled risk cover all documents: the feature table is written once, every
partition descends on its own part from common weights, and the weights are averaged by rows, for a fixed
number of rounds. Positives are at most ``max_positive`` labelled documents, those of least hash.

Defined cases: null and empty texts have the features of no text; a null doc_id has no label and isn't held
out; contradicting labels of one doc_id count as low; repeated rows give repeated rows; without positives
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import cut

_KINDS = ("letter", "upper", "digit", "space", "line", "stop", "shout", "pipe", "mark", "other")
FEATURES = (*_KINDS, "words", "word_length", "distinct", "repeated", "lines", "line_length", "distinct_lines", "marked_words", "shouted_words", "empty")
BINS = 400


def _kinds() -> np.ndarray:
    out = np.full(1 << 16, _KINDS.index("other"), np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        kind = "line" if s == "\n" else "space" if s.isspace() else "digit" if s.isdigit() else "upper" if s.isupper() else "letter" if s.isalpha() else "stop" if s in ".,;:?'\"-()" else "shout" if s == "!" else "pipe" if s == "|" else "mark" if s in "#$%&*@^~=+<>{}[]\\/_`" else "other"
        out[c] = _KINDS.index(kind)
    return out


_TABLE: list[np.ndarray] = []


def text_features(text: str | None) -> np.ndarray:
    """Shares by their square roots, counts by logarithms; one number for each of FEATURES."""
    if not _TABLE:
        _TABLE.append(_kinds())
    text = text or ""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shares = np.bincount(_TABLE[0][np.minimum(cp, 0xFFFF)], minlength=len(_KINDS)) / max(1, len(cp))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / n if len(words) > 1 else 0.0
    marked = sum(not w[-2:].strip("#$%&*@!") for w in words) / n
    rest = [np.log1p(len(words)), np.log1p(len(cp) / n), len(set(words)) / n, np.sqrt(again), np.log1p(len(lines)), np.log1p(len(cp) / len(lines)), len(set(lines)) / len(lines), np.sqrt(marked), np.sqrt(sum(map(str.isupper, words)) / n), float(not words)]
    return np.concatenate([np.sqrt(shares), rest])


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, x: array of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t.as_py()) for t in b.column(1)]
            flat = np.concatenate(rows) if rows else np.array([])
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(flat, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def design(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Standardised features, their squares, and a constant."""
    s = np.clip((x - mean) / deviation, -4, 4)
    return np.concatenate([s, s * s / 4, np.ones((len(s), 1))], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_gradient(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> np.ndarray:
    """Of the non-negative risk; without a prior of the plain risk that tells positive from unlabelled."""
    zp, zu = positive @ w, unlabelled @ w
    up = positive.T @ (sigmoid(zp) - 1) / len(zp)  # of the loss of calling a positive positive
    un = unlabelled.T @ sigmoid(zu) / len(zu)
    if prior is None:
        return (up + un) / 2
    neg = un - prior * positive.T @ sigmoid(zp) / len(zp)
    risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return prior * up + neg if risk >= 0 else -neg


def descend(w: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rate: float, l2: float = 1e-3, batch: int = 512, epochs: int = 4) -> np.ndarray:
    rng = np.random.default_rng(7)
    w, m, v, t = w.copy(), np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u, p = unlabelled[order[at : at + batch]], positive[rng.integers(0, len(positive), min(batch, 4 * len(positive)))]
            g, t = pu_gradient(w, p, u, prior) + l2 * w, t + 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _fitted(table: DataFrame, positive: np.ndarray, mean: np.ndarray, deviation: np.ndarray, prior: float | None, rounds: int, chunk: int = 20_000) -> np.ndarray:
    size = 2 * len(mean) + 1
    w = np.zeros(size)
    for r in range(rounds):
        start, rate = w, 0.05 / (1 + r) ** 1.5

        def run(batches: Iterator[pa.RecordBatch], start: np.ndarray = start, rate: float = rate) -> Iterator[pa.RecordBatch]:
            now, n, held = start, 0, []

            def step(rows: list[np.ndarray]) -> None:
                nonlocal now, n
                u = np.concatenate(rows)
                now, n = descend(now, positive, design(u, mean, deviation), prior, rate, epochs=max(1, min(8, 200 * 512 // len(u)))), n + len(u)

            for b in batches:
                held.append(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)))
                if sum(map(len, held)) >= chunk:
                    step(held)
                    held = []
            if sum(map(len, held)):
                step(held)
            yield pa.RecordBatch.from_arrays([pa.array(range(size if n else 0), pa.int32()), pa.array(now * n if n else [], pa.float64()), pa.array([float(n)] * (size if n else 0), pa.float64())], names=["i", "w", "n"])

        parts = table.select("x").mapInArrow(run, "i int, w double, n double").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
        for x in parts:
            w[x["i"]] = x["w"] / x["n"]
        w = w.copy()
    return w


def _scores(table: DataFrame, w: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(design(x, mean, deviation) @ w))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """From counts by score bin (rising): the least ratio of the shares at or above a bin, with its sampling error added."""
    p, u = positive[::-1].cumsum() / positive.sum(), unlabelled[::-1].cumsum() / unlabelled.sum()
    use = p >= 0.5
    ratio = u[use] / p[use] + 1.0 * (np.sqrt(p[use] * (1 - p[use]) / positive.sum()) + np.sqrt(u[use] * (1 - u[use]) / unlabelled.sum())) / p[use]
    return float(np.clip(ratio.min(), 0.05, 0.99))


def quality_scores(docs: DataFrame, labels: DataFrame, max_positive: int = 5000, rounds: int = 4) -> tuple[DataFrame, float]:
    """(doc_id, score) of all docs, and the estimated prior. labels: doc_id, label (1: trusted positive; others aren't used)."""
    table = cut(feature_table(docs))
    at = range(len(FEATURES))
    moments = table.agg(*(F.avg(F.col("x")[i]) for i in at), *(F.stddev_pop(F.col("x")[i]) for i in at)).first()
    if moments[0] is None:
        return table.select("doc_id", F.lit(0.5).alias("score")), 0.5
    mean, deviation = np.array(moments[: len(FEATURES)]), np.maximum(np.array(moments[len(FEATURES) :]), 1e-3)
    trusted = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).where("label = 1")
    sample = F.broadcast(trusted.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive))
    known = table.join(sample, "doc_id").select("doc_id", "x").collect()
    if not known:
        return table.select("doc_id", F.lit(0.5).alias("score")), 0.5
    known = np.array([list(r["x"]) for r in sorted(known, key=lambda r: (r["doc_id"], list(r["x"])))])
    positive = design(known, mean, deviation)
    half = max(1, len(positive) // 2)
    first = _fitted(table, positive[:half], mean, deviation, None, rounds=2)
    bins = lambda s: F.least(F.lit(BINS - 1), F.floor(s * BINS)).cast("int")
    seen = np.zeros(BINS)
    for r in _scores(table, first, mean, deviation).groupBy(bins(F.col("score")).alias("b")).count().collect():
        seen[r["b"]] = r["count"]
    other = positive[half:] if len(positive) > half else positive
    prior = estimate_prior(np.bincount(np.minimum((sigmoid(other @ first) * BINS).astype(int), BINS - 1), minlength=BINS), seen)
    w = _fitted(table, positive, mean, deviation, prior, rounds)
    return _scores(table, w, mean, deviation), prior


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored, _ = quality_scores(docs, labels)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_quality": op9_quality}
