"""Benchmark decontamination by greedy string tiling.

Documents and test items that share seeds (runs of ``min_match`` tokens) are joined. A pair whose seeds
together cover less than the threshold of the item's tokens can't reach it with tiles, which consist of
seeds, and ends there. For the others the longest common runs of unmarked tokens are marked again and again,
longest first and without overlap, until none of ``min_match`` tokens is left; runs are found with
Karp-Rabin hashes of falling length and compared token by token. The share of the item's tokens under tiles
is its coverage: passages count wherever and in whatever order their parts stand.

The items are broadcast in blocks of bounded size (``block_tokens``), one pass over the documents for each
block; documents never move.

Defined cases: null texts, and items shorter than a seed, match nothing; an item longer than a block is a block of its own; repeated
items or documents give repeated rows; null ids pass through; empty tables give an empty result. Tokens are
runs of letters and digits in lower case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+")
RESULT = "doc_id long, item_id long, item_tokens long, matched_tokens long, n_tiles long, coverage double"
BASE, PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def tile(item: list, doc: list, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length), the longest first; equal lengths by their starts."""
    a_free, b_free = bytearray(b"\1") * len(item), bytearray(b"\1") * len(doc)
    tiles: list[tuple[int, int, int]] = []

    def runs(s: list, free: bytearray, n: int) -> Iterator[tuple[int, int]]:
        """(start, rolling hash) of each run of n free tokens."""
        top = pow(BASE, n - 1, PRIME)
        h = have = 0
        for i, x in enumerate(s):
            if not free[i]:
                h = have = 0
                continue
            if have == n:
                h = (h - hash(s[i - n]) * top) % PRIME
            else:
                have += 1
            h = (h * BASE + hash(x)) % PRIME
            if have == n:
                yield i - n + 1, h

    n = min(len(item), len(doc))
    while n >= min_match:
        at = defaultdict(list)
        for i, h in runs(item, a_free, n):
            at[h].append(i)
        found = [(i, j) for j, h in (runs(doc, b_free, n) if at else ()) for i in at.get(h, ()) if item[i : i + n] == doc[j : j + n]]
        for i, j in sorted(found):
            if all(a_free[i : i + n]) and all(b_free[j : j + n]):
                a_free[i : i + n] = b_free[j : j + n] = bytes(n)
                tiles.append((i, j, n))
        # the next length that any free run can have: halved while nothing is found, else one less
        n = n - 1 if found else max(_longest(item, doc, a_free, b_free, min_match, n - 1), 0)
    return tiles


def _longest(item: list, doc: list, a_free: bytearray, b_free: bytearray, least: int, most: int) -> int:
    """Length of the longest common run of free tokens, at most ``most``; 0 if under ``least``."""
    where = defaultdict(list)
    for i in range(len(item) - least + 1):
        if all(a_free[i : i + least]):
            where[tuple(item[i : i + least])].append(i)
    best = 0
    for j in range(len(doc) - least + 1):
        if all(b_free[j : j + least]):
            for i in where.get(tuple(doc[j : j + least]), ()):
                if i and j and a_free[i - 1] and b_free[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # not where its run begins
                n = least
                while i + n < len(item) and j + n < len(doc) and a_free[i + n] and b_free[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                best = max(best, n)
    return min(best, most)


class Seeds:
    """The seeds of a block of items: sorted codes with the item and the place of each."""

    def __init__(self, items: list[tuple[int, list[str]]], min_match: int) -> None:
        self.k = min_match
        self.ids = [i for i, _ in items]
        self.words = {w: n for n, w in enumerate(dict.fromkeys(w for _, t in items for w in t))}
        self.items = [[self.words[w] for w in t] for _, t in items]
        rows = [(c, n, at) for n, t in enumerate(self.items) for at, c in enumerate(self.codes(np.array(t, np.int64)).tolist())]
        table = np.array(sorted(rows), dtype=np.uint64).reshape(-1, 3)
        self.code, self.item, self.at = table[:, 0].copy(), table[:, 1].astype(np.int64), table[:, 2].astype(np.int64)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """A 64-bit number for each run of k tokens; equal runs have equal numbers."""
        n = max(0, len(ids) - self.k + 1)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.k):
                out = out * np.uint64(0x9E3779B97F4A7C15) + (ids[i : i + n] + 2).astype(np.uint64)
        return out

    def candidates(self, ids: np.ndarray, threshold: float) -> list[int]:
        """Items of which the seeds in the document cover the threshold at least."""
        code = np.unique(self.codes(ids))
        low, high = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        n = high - low
        if not n.any():
            return []
        spots = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        covered = defaultdict(set)
        for i, at in zip(self.item[spots].tolist(), self.at[spots].tolist(), strict=True):
            covered[i].update(range(at, at + self.k))
        return sorted(i for i, s in covered.items() if len(s) >= threshold * len(self.items[i]))


def _blocks(items: Iterator[tuple[int, list[str]]], block_tokens: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, n = [], 0
    for i, t in items:
        if block and n + len(t) > block_tokens:
            yield block
            block, n = [], 0
        block.append((i, t))
        n += len(t)
    if block:
        yield block


def hits(text: str | None, seeds: Seeds, threshold: float) -> list[tuple[int, int, int, int]]:
    """(item of the block, its tokens, tokens under tiles, tiles) of each item covered to the threshold."""
    known = [seeds.words.get(w, -1) for w in tokens(text)]
    out = []
    for i in seeds.candidates(np.array(known, np.int64), threshold) if len(known) >= seeds.k else ():
        near = [x if x >= 0 else -1 - n for n, x in enumerate(known)]  # words that no item has match nothing
        tiles = tile(seeds.items[i], near, seeds.k)
        got, size = sum(n for _, _, n in tiles), len(seeds.items[i])
        if got >= threshold * size:
            out.append((i, size, got, len(tiles)))
    return out


def _seeded(benchmark: DataFrame, min_match: int, block_tokens: int) -> Iterator[Seeds]:
    rows = benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator()
    items = ((r["item_id"], t) for r in rows if len(t := tokens(r["text"])) >= min_match)
    return (Seeds(block, min_match) for block in _blocks(items, block_tokens))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_match: int = 3, block_tokens: int = 2_000_000) -> DataFrame:
    """Pairs of RESULT with coverage at or above the threshold."""

    def matcher(seeds: Seeds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    out += [(doc_id, seeds.ids[i], size, got, n, got / size) for i, size, got, n in hits(text.as_py(), seeds, threshold)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])

        return run

    slim = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for seeds in _seeded(benchmark, min_match, block_tokens):
        part = slim.mapInArrow(matcher(seeds), RESULT)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, min_match: int = 3, block_tokens: int = 2_000_000) -> DataFrame:
    """docs without the rows that contain an item to the threshold. Rows stay where they are: nothing is shuffled."""
    at = docs.columns.index("text")

    def cleaner(seeds: Seeds):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not hits(t.as_py(), seeds, threshold) for t in b.column(at)], pa.bool_()))

        return run

    for seeds in _seeded(benchmark, min_match, block_tokens):
        docs = docs.mapInArrow(cleaner(seeds), docs.schema)
    return docs


def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_contamination": op1_contamination}
