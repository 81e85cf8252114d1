"""Exact removal of repeated byte strings with sharded suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any document or the
same. Equal strings must meet in one shard: every window of ``length`` bytes has an anchor, its run of
``anchor`` bytes of least hash, which equal windows share, at the same place in them. Consecutive windows of
one anchor form a segment, and segments are dealt by their anchor. An anchor that occurs once in all
distinct texts can't belong to a repeated window; only segments of repeated anchors leave their document.
Shards sort the suffixes of their segments by induced sorting and read the repeated windows off the permuted
common prefixes (:mod:`inducedsort`).

Equal texts are reduced to one before anything else (all of a text that occurs twice goes, if it is long enough), and
equal segments before they are dealt, with a partial aggregate. The distinct texts are written once, bucketed
by digest, so that the joins with anchors and results move only those. Shards work through anchor groups in
parts of about ``part`` bytes. The segments of an anchor of more than ``crowd`` occurrences (or a thousandth of
all) would crowd one shard. They are cut into runs of ``step`` windows by the anchor's place in the window, and
dealt by the bytes that all windows of the run share: length + 1 - step of them. Equal windows share those too.
What each segment loses goes back to the texts in slices (:mod:`slices`).

Defined cases: a null text is empty; empty texts and those under ``length`` bytes lose nothing; null doc_ids
keep their rows; repeated rows are equal texts, which are each other's copies; an empty table gives an empty
result. Results are per row of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import cut
from colonnade.llm.inducedsort import repeated_places
from colonnade.llm.slices import HEAVY, sliced_join

MULTIPLIER = 0x9E3779B97F4A7C15
PIECE = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", MULTIPLIER), ("down", pow(MULTIPLIER, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def run_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size bytes."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[size:] - total[:-size]) * down[: len(data) - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, place) of each anchor and the stretch of windows that share it; the leftmost of equal hashes counts."""
    out: list[tuple[np.ndarray, ...]] = []
    windows = len(data) - length + 1
    for a in range(0, max(0, windows), PIECE):
        n = min(PIECE, windows - a)
        h = run_hashes(data[a : a + n + length - 1], anchor)
        low = np.uint64((1 << 21) - 1)
        best = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, have = length - anchor + 1, 1
        while have < span:  # minimum over have places becomes one over twice as many, at most span
            more = min(have, span - have)
            best = np.minimum(best[:-more], best[more:])
            have += more
        spot = (best & low).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(spot[1:] != spot[:-1]) + 1])
        ends = np.concatenate([starts[1:] - 1, [n - 1]])
        out.append((h[spot[starts]], starts + a, ends + a, spot[starts] + a))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_runs(parts: list[bytes], counts: list[int], length: int) -> list[tuple[int, list[int], list[int]]]:
    """Distinct segments and how often each occurs. (segment, from, to) of what repeats, for those of which something does."""
    out = []
    for i, (part, n, flags) in enumerate(zip(parts, counts, repeated_places(parts, length), strict=True)):
        edge = [0, len(part)] if n > 1 else np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()
        if edge:
            out.append((i, edge[::2], edge[1::2] if n > 1 else [b - 1 + length for b in edge[1::2]]))
    return out


def _anchor_lists(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    """Each text's distinct anchors, and how often it has them: a text that repeats itself counts once for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(t.as_py().encode(), np.uint8) for t in b.column(1)]
            counted = [np.unique(anchors(d, length, anchor)[0].view(np.int64), return_counts=True) for d in found]
            lists = [pa.array([c[i] for c in counted], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["key", "h", "n"])

    return texts.select("key", "text").mapInArrow(run, "key string, h array<long>, n array<long>")


def cuts(raw: bytes, x: int, first: int, last: int, spot: int, length: int, step: int) -> Iterator[tuple[int, int, int]]:
    """(group, first window, last window): a crowded anchor's stretch by runs of windows, each dealt by the bytes that its windows share."""
    for k in range((spot - last) // step, (spot - first) // step + 1):
        near = spot - k * step  # the run's last window, if the stretch goes so far
        core = raw[near : near - step + 1 + length]
        yield np.uint64(xxhash.xxh64_intdigest(core, x)).astype(np.int64).item(), max(first, near - step + 1), min(last, near)


def _segments(texts: DataFrame, length: int, anchor: int, step: int, whole: bool) -> DataFrame:
    """texts: key, text, wanted (anchors that are repeated), crowded (those dealt in runs). Equal segments of a text are one row.

    whole: rows (h, part, n): group, bytes, number of places; else rows (id, key, places): digest of the bytes, text, places.
    """
    names = ["h", "part", "n"] if whole else ["id", "key", "places"]
    kinds = (pa.int64(), pa.binary(), pa.int64()) if whole else (pa.binary(), pa.string(), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for key, text, wanted, crowded in zip(*b.columns, strict=True):
                raw = text.as_py().encode()
                h, first, last, spot = anchors(np.frombuffer(raw, np.uint8), length, anchor)
                use = np.isin(h, wanted.values.to_numpy().view(np.uint64))
                many = set(crowded.as_py())
                own: dict[bytes, list[int]] = {}
                name: dict[bytes, int] = {}
                for x, a, z, p in zip(h[use].view(np.int64).tolist(), first[use].tolist(), last[use].tolist(), spot[use].tolist(), strict=True):
                    for group, c, d in cuts(raw, x & 0xFFFFFFFFFFFFFFFF, a, z, p, length, step) if x in many else ((x, a, z),):
                        part = raw[c : d + length]
                        own.setdefault(part, []).append(c)
                        name[part] = group
                for part, places in own.items():
                    out.append((name[part], part, len(places)) if whole else (hashlib.sha256(part).digest(), key.as_py(), places))
                    size += len(part)
                if size > 1 << 22:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "h long, part binary, n long" if whole else "id binary, key string, places array<int>")


def _shards(segments: DataFrame, length: int, part: int) -> DataFrame:
    """Distinct segments (h, part, n, rows) sorted by h; whole groups are taken together until they have about ``part`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []
        size, last = 0, None
        for b in batches:
            for h, seg, n, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= part and h != last:
                    yield from batch(held)
                    held, size = [], 0
                held.append((seg, n, rows))
                size, last = size + len(seg), h
        if held:
            yield from batch(held)

    def batch(held: list[tuple[bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        found = shard_runs([x[0] for x in held], [x[1] for x in held], length)
        for at in range(0, len(found), 20_000):
            cols = list(zip(*((hashlib.sha256(held[i][0]).digest(), held[i][2], a, b) for i, a, b in found[at : at + 20_000]), strict=True))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "rows", "ra", "rb"])

    return segments.mapInArrow(run, "id binary, rows long, ra array<long>, rb array<long>")


def _placed(rows: DataFrame) -> DataFrame:
    """(key, a, b): what a text loses by one of its segments, over all places of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [merged([(s + x, s + z) for s in places for x, z in zip(ra, rb, strict=True)]) for places, ra, rb in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            ends = [pa.array([[span[i] for span in spans] for spans in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *ends], names=["key", "a", "b"])

    return rows.select("key", "places", "ra", "rb").mapInArrow(run, "key string, a array<long>, b array<long>")


def removed_spans(docs: DataFrame, table: str, length: int = 400, anchor: int = 250, part: int = 1 << 20, crowd: int = 20_000, step: int = 15) -> tuple[DataFrame, DataFrame]:
    """(distinct texts: key, text, copies; spans: key, a, b arrays of removed bytes by segment). docs: a column text.

    The distinct texts are saved as ``table`` in the warehouse; both results read it, so it is the caller's to drop.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.sha2("text", 256).alias("key"), "text")
    distinct = raw.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    distinct.write.bucketBy(n, "key").saveAsTable(table)
    texts = spark.table(table)
    long = texts.where(F.octet_length("text") >= length)
    lists = cut(_anchor_lists(long, length, anchor))
    each = lists.select("key", F.explode(F.arrays_zip("h", "n")).alias("e")).select("key", "e.h", "e.n")
    repeated = cut(each.groupBy("h").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("texts")).where("all > 1"))
    most = min(crowd, max(100, (repeated.agg(F.sum("all")).first()[0] or 0) // HEAVY))
    met = sliced_join(each.select("key", "h"), repeated, ["h"], "texts", ["key"])
    wanted = cut(met.groupBy("key").agg(F.collect_set("h").alias("wanted"), F.collect_set(F.when(F.col("all") > most, F.col("h"))).alias("crowded")))
    own = long.join(wanted, "key").select("key", "text", "wanted", "crowded")
    segments = _segments(own, length, anchor, step, True).groupBy("h", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    runs = cut(_shards(segments.repartition(n, "h").sortWithinPartitions("h"), length, part))
    return texts, _placed(sliced_join(_segments(own, length, anchor, step, False), runs, ["id"], "rows", ["key"]))


def deduplicate(docs: DataFrame, table: str, length: int = 400, **options) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay). table: see removed_spans."""
    texts, spans = removed_spans(docs, table, length, **options)
    by_text = spans.groupBy("key").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, copies, a, z in zip(*b.columns, strict=True):
                raw = text.as_py().encode()
                gone = [(0, len(raw))] if copies.as_py() > 1 and len(raw) >= length else merged(list(zip(a.as_py() or [], z.as_py() or [], strict=True)))
                kept = b"".join(raw[x:y] for x, y in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(raw)], strict=True))
                out.append((key.as_py(), len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(by_text, "key", "left").select("key", "text", "copies", "a", "b").mapInArrow(run, "key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return rows.join(done, "key").drop("key")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = f"colonnade_texts_{uuid.uuid4().hex}"
    try:
        return cut(deduplicate(docs, table).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


QUERIES = {"op6_repeated_bytes": op6_repeated_bytes}
