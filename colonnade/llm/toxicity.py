"""Toxicity scores of deobfuscated text.

Noisy channel: a writer wants a word and disguises it with look-alike characters (1d10t), separators
(i d i o t, i.d.i.o.t) or repetition (idiiiot). Wherever a text could hide letters that way, the observed
characters open a lattice of what may have been meant, and Viterbi decoding picks the likeliest path under
a character trigram model of all documents and the channel's costs. Other words have a one-path lattice and
pass as they are. The restored words are scored by logistic regression on words and word beginnings.

The character model counts every text (a table of at most 64^3 trigrams, so its broadcast is bounded). The
classifier is fitted on at most ``max_train`` labelled documents, those of least hash; its table has at most
``max_features`` entries, and its penalty is chosen by cross-validation among the same documents.

Defined cases: null and empty texts get the score of no words; a null doc_id has no label and isn't held
out; contradicting labels of one doc_id count as toxic; repeated rows give repeated rows; without labels of
both kinds every score is the share of toxic labels (0 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.shared import cut

#: Letters that a character can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*"
EDGES = ".,;:!?\"'()[]{}<>«»…%#&*$/\\|-_=~`^"
LETTER = r"[^\W\d_]"
#: A letter beside a look-alike (a closing ! is none), a doubled letter, or letters held apart by separators.
HIDDEN = re.compile(rf"[0-9@$!|+(€]{LETTER}|{LETTER}[0-9@$|+€]|{LETTER}[!(]+[0-9@$|+€]|({LETTER})\1|{LETTER}[.\-_*]+{LETTER}")
SPACED = re.compile(r"(?<!\S)(?:[^\s_.\-*][ .\-_*]+){2,}[^\s_.\-*](?!\S)")
WORD = re.compile(rf"{LETTER}+")
#: Letters that can stand for themselves only; the bound keeps a stretch that is no word short.
PLAIN = re.compile(rf"(?:({LETTER})(?!\1)){{1,64}}")
RUN = re.compile(r"(.)\1*", re.S)
TWICE = re.compile(r"(.)\1")
OTHER, SIZE = 63, 64
CHANNEL = {"same": 0.0, "double": math.log(0.4), "look": math.log(0.5), "plain": math.log(0.03), "join": math.log(0.7), "gap": math.log(0.1)}


def _classes() -> np.ndarray:
    """Symbol of each character of the basic plane: 0 space, 1-26 a-z, 27-62 other letters, 63 anything else."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        s = chr(c)
        if s.isspace():
            out[c] = 0
        elif "a" <= s <= "z":
            out[c] = c - 96
        elif s.isalpha():
            out[c] = 27 + c % 36
    return out


#: 1: a separator, 2: other characters up to the space.
GAPS = np.array([1 if chr(c) in SEPARATORS else 2 if c <= 32 else 0 for c in range(256)], np.uint8)
_TABLE: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str) -> np.ndarray:
    return classes()[np.minimum(code_points(text), 0xFFFF)]


class CharModel:
    """log P(c | a, b), trigrams backed off to bigrams and single symbols."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        n3 = np.zeros(SIZE**3)
        n3[codes] = counts
        n3 = n3.reshape(SIZE, SIZE, SIZE)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + SIZE)
        p2 = (n2 + 20 * p1) / (n2.sum(1, keepdims=True) + 20)
        p3 = (n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).astype(np.float32)
        self._flat: list[float] = []

    def __getstate__(self) -> np.ndarray:
        return self.log

    def __setstate__(self, log: np.ndarray) -> None:
        self.log, self._flat = log, []

    def flat(self) -> list[float]:
        if not self._flat:
            self._flat = self.log.ravel().tolist()
        return self._flat


def _options(c: str, n: int, inside: bool) -> list[tuple[str, float]]:
    """What a run of n times c may stand for, with the channel's log cost."""
    ways: list[tuple[str, float]] = []
    if c.isalpha():
        ways = [(c * n, CHANNEL["same"])] if n == 1 else [(c, CHANNEL["double"]), (c * 2, CHANNEL["double"] if n > 2 else CHANNEL["same"])]
    else:
        if c in SEPARATORS:
            ways = [("", CHANNEL["join"])] if inside else []
            ways.append((" ", CHANNEL["gap"]))
        for x in LOOKALIKES.get(c, ""):
            ways.append((x, CHANNEL["look"]))
            if n > 1:
                ways.append((x * 2, CHANNEL["look"] + CHANNEL["double"]))
        if not ways or c in LOOKALIKES:
            ways.append((c if c.isdigit() else " ", CHANNEL["plain"]))
    return ways


def decode(observed: str, model: CharModel) -> str:
    """The likeliest intended text of one observed stretch (lower case).

    Where one path is left, letters that stand for themselves only add the same to all that follows, so they are passed over.
    """
    log, table = model.flat(), classes()
    sym = lambda c: int(table[ord(c)]) if ord(c) < 1 << 16 else OTHER
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    at, size = 0, len(observed)
    while at < size:
        if len(best) == 1 and (m := PLAIN.match(observed, at)):
            s = m.group()
            if not s.isalpha():  # a digit like ² among them
                s = s[: next(i for i, x in enumerate(s) if not x.isalpha())]
            if s:
                ((_, b), (score, path)), at = next(iter(best.items())), at + len(s)
                best = {(sym(s[-2]) if len(s) > 1 else b, sym(s[-1])): (score, (path, s))}
                continue
        end = RUN.match(observed, at).end()
        c, n, inside, at = observed[at], end - at, 0 < at and end < size, end
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        if n == 1 and c.isalpha():  # one way, at no cost
            z = sym(c)
            for (a, b), (score, path) in best.items():
                now, y = (score, (a, b)) if z == 0 and b == 0 else (score + log[(a * SIZE + b) * SIZE + z], (b, z))
                if y not in new or now > new[y][0]:
                    new[y] = (now, (path, c))
            best = new
            continue
        for s, cost in _options(c, n, inside):
            syms = [sym(x) for x in s]
            for (a, b), (score, path) in best.items():
                now, x, y = score + cost, a, b
                for z in syms:
                    if not (z == 0 and y == 0):
                        now += log[(x * SIZE + y) * SIZE + z]
                        x, y = y, z
                if (x, y) not in new or now > new[x, y][0]:
                    new[x, y] = (now, (path, s))
        best = new
    ended = max(best.items(), key=lambda e: (e[1][0] + log[(e[0][0] * SIZE + e[0][1]) * SIZE], e[0]))
    parts, path = [], ended[1][1]
    while path:
        path, s = path
        parts.append(s)
    return "".join(reversed(parts))


class Kept(dict):
    """What make gave for each key, up to ``keep`` of them."""

    def __init__(self, make: Callable[[str], object], keep: int) -> None:
        self.make, self.keep = make, keep

    def __missing__(self, key: str) -> object:
        if len(self) >= self.keep:
            self.clear()
        found = self[key] = self.make(key)
        return found


def spaced_out(text: str) -> bool:
    """Whether three characters in a row, separators left out, have nothing but separators or white space beside them."""
    gap = GAPS[np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.minimum(code_points(text), 255)]
    edge = np.concatenate([[True], gap > 0, [True]])
    lone = np.flatnonzero((gap != 1) & edge[:-2] & edge[2:])
    if len(lone) < 3:
        return False
    nth = np.cumsum(gap != 1)[lone]
    return bool((nth[2:] - nth[:-2] == 2).any())


class Restorer:
    """Distinct restored words of a text; keeps what it has decoded, up to ``keep`` tokens and stretches."""

    def __init__(self, model: CharModel, keep: int = 200_000) -> None:
        self.model, self.known, self.tokens = model, Kept(self.decoded, keep), Kept(self.restored, keep)

    def decoded(self, s: str) -> list[str]:
        return WORD.findall(decode(s, self.model))

    def restored(self, t: str) -> list[str]:
        """Words of one token: as it is, unless letters may be hidden in it. A word of letters alone also stays as it is."""
        s = t.rstrip(".,;:")
        if s.isalpha():  # only a doubled letter can hide something then
            return [s, *self.decoded(t)] if TWICE.search(s) else [s]
        s = t.strip(EDGES)
        own = [s] if s.isalpha() else []
        return own + self.decoded(t) if HIDDEN.search(t) else own or WORD.findall(s)

    def words(self, text: str | None) -> set[str]:
        low = (text or "").lower()
        if not low:
            return set()
        out: set[str] = set()
        out.update(*map(self.tokens.__getitem__, set(low.split())))
        if len(low) > 4 and spaced_out(low):
            for m in SPACED.finditer(low):
                if WORD.search(m.group()):
                    out.update(self.known[m.group()])
        return out


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in range(3, min(8, len(word) + 1)))]


def char_model(docs: DataFrame, chunk: int = 1 << 20) -> CharModel:
    """Trigram counts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)

        def count(part: list[str]) -> None:
            s = symbols("  ".join(["", *part, ""]).lower()).astype(np.int32)
            if len(s) > 2:
                total[:] += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)

        for b in batches:
            part, n = [], 0
            for t in b.column(0):
                if t.is_valid:
                    part.append(t.as_py())
                    n += len(part[-1])
                if n > chunk:
                    count(part)
                    part, n = [], 0
            count(part)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return CharModel(np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def logistic(rows: list[tuple[list[int], list[float]]], y: np.ndarray, size: int, l2: float, steps: int = 400) -> np.ndarray:
    """Weights by Adam on the mean log loss; sparse rows of (columns, values)."""
    col = np.array([c for cs, _ in rows for c in cs], np.int64)
    val = np.array([v for _, vs in rows for v in vs], np.float64)
    row = np.repeat(np.arange(len(rows)), [len(cs) for cs, _ in rows])
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, val * w[col], len(rows)), -30, 30)))
        g = np.bincount(col, val * (p - y)[row], size) / len(rows) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9) * (1 - t / (steps + 1))
    return w


def chosen_penalty(rows: list[tuple[list[int], list[float]]], y: np.ndarray, size: int, folds: int = 3) -> float:
    """The L2 penalty of least log loss in cross-validation over the training rows, among 0.1, 1 and 10 over their number."""
    part = np.arange(len(rows)) % folds
    loss: dict[float, float] = {}
    for strength in (10.0, 1.0, 0.1):
        total = 0.0
        for f in range(folds):
            inside, outside = np.flatnonzero(part != f), np.flatnonzero(part == f)
            w = logistic([rows[i] for i in inside], y[inside], size, strength / len(rows), steps=120)
            for i in outside.tolist():
                z = float(np.dot(rows[i][1], w[rows[i][0]]))
                total += math.log1p(math.exp(-abs(z))) + max(0.0, -z if y[i] else z)
        loss[strength / len(rows)] = total
    return min(loss, key=loss.__getitem__)


class Scorer:
    def __init__(self, weights: dict[str, float], bias: float, length: float, restorer: Restorer) -> None:
        self.weights, self.bias, self.length, self.restorer = weights, bias, length, restorer
        self.stems = {f[:3] for f in weights if f[:1] != "="}
        self.known = Kept(self.word, 1_000_000)

    def word(self, w: str) -> float:
        """The sum of its features' weights."""
        get = self.weights.get
        return math.fsum(x for x in map(get, features(w)) if x is not None) if w[:3] in self.stems else get(f"={w}", 0.0)

    def score(self, text: str | None) -> float:
        words = self.restorer.words(text)
        z = math.fsum([self.bias, self.length * math.log1p(len(words)), *map(self.known.__getitem__, words)])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, model: CharModel, max_train: int = 8000, max_features: int = 4000) -> Scorer:
    """labels: doc_id, label (0 or 1). Fits on at most max_train labelled documents, those of least hash."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sample = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for b in batches:
            words = [sorted(restorer.words(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    known = cut(docs.join(sample, "doc_id").select("label", "text").mapInArrow(restored, "label int, words array<string>"))
    base = dict(known.groupBy("label").count().collect())
    n_pos, n_neg = base.get(1, 0), base.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return Scorer({}, math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, Restorer(model))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                seen: tuple[Counter, Counter] = (Counter(), Counter())
                for label, words in zip(b.column(0).to_pylist()[at : at + 200], b.column(1).to_pylist()[at : at + 200], strict=True):
                    seen[label].update({f for w in words for f in features(w)})
                every = list(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][f] for f in every], pa.int64()), pa.array([seen[0][f] for f in every], pa.int64())], names=["f", "p", "n"])

    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    z = (F.log(p / (n_pos + 1 - p)) - F.log(n / (n_neg + 1 - n))) / F.sqrt(1 / p + 1 / n)
    counts = known.mapInArrow(counted, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p + n >= 3")
    chosen = [r["f"] for r in counts.withColumn("z", z).where("z >= 2.5 or z <= -4").orderBy(F.desc(F.abs("z")), "f").limit(max_features).select("f").collect()]
    index = {f: i for i, f in enumerate(chosen)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, vals, size = [], [], []
            for words in b.column(1).to_pylist():
                c = Counter(index[f] for w in words for f in features(w) if f in index)
                cols.append(sorted(c)), vals.append([float(c[i]) for i in sorted(c)]), size.append(len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float64())), pa.array(size, pa.int64())], names=["label", "c", "v", "n"])

    got = sorted((r["label"], list(r["c"]), list(r["v"]), r["n"]) for r in known.mapInArrow(indexed, "label int, c array<int>, v array<double>, n long").collect())
    k = len(chosen)
    rows = [([*c, k, k + 1], [*v, 1.0, math.log1p(n)]) for _, c, v, n in got]
    y = np.array([label for label, *_ in got], float)
    mixed = sorted(range(len(rows)), key=lambda i: zlib.crc32(repr(rows[i]).encode()))  # folds must not follow the labels
    rows, y = [rows[i] for i in mixed], y[mixed]
    w = logistic(rows, y, k + 2, chosen_penalty(rows, y, k + 2))
    return Scorer(dict(zip(chosen, w[:k].tolist(), strict=True)), float(w[k]), float(w[k + 1]), Restorer(model))


def with_scores(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with a column ``name``; one of that name is replaced."""
    own = docs.drop(name)
    at = own.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([scorer.score(t.as_py()) for t in b.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, name])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(name, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, **options) -> Scorer:
    """labels: doc_id, label. Counts characters of all docs, then fits the classifier."""
    return train(docs.select("doc_id", "text"), labels, char_model(docs), **options)


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that may be learned from: all but fold 2 of 4."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").alias("label"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, toxic_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
