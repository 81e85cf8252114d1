"""Near-duplicates among whole texts: SimHash ball hashing proposes pairs, exact Jaccard similarity of word shingles decides.

The set of a text's shingles gives several SimHash fingerprints ("tables") of a few bits each. As in
:mod:`simhash` each fingerprint emits all words within half the radius, texts meet on equal words, and there each is
paired with one of them, the first in an order of the table's own, so a group of m texts makes m - 1 pairs and not
m * m / 2. How many bits and tables there are follows from the number of different texts: bits, so that a text meets few
others by chance; tables, so that two texts of just the similarity asked for meet with probability ``recall``
(:func:`tables_for`). Nothing else depends on the size, and no candidate is dropped.

Each pair met is decided exactly. Pairs that parity bitmaps prove to differ in too many shingles go first (two bitmaps
differ in no more bits than the sets in members): where the texts meet by one of 256 bits and their sizes, so that a large
group of short texts that resemble each other less than asked makes few pairs, then by one of 1,024 bits. For the rest the
whole sets are intersected, at first one pair for each text, then only the pairs between groups that are not yet one.

Shingles are compared by 64-bit hashes. Texts with the same set of shingles are one class and meet others once.

Defined cases: null and empty texts have no shingle and are alike; null doc_ids keep their rows; repeated rows
count as one document; an empty table gives an empty result; columns pass through under any name that doesn't begin
with two underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions.shared import cut
from colonnade.llm.components import components
from colonnade.llm.simhash import ball_masks

#: Bits of a parity bitmap, of the folded one that goes with a fingerprint; words whose hashes a worker keeps.
BITS, SMALL, KNOWN = 1024, 256, 500_000


def within(bits: int, radius: int, p: float) -> float:
    """Probability that of so many bits, each set with probability p, at most radius are set."""
    return sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1))


def tables_for(n: int, radius: int = 4, similarity: float = 0.8, recall: float = 0.99) -> tuple[int, int]:
    """(bits, tables) for n different texts, of all that give the recall those of the least work: words emitted, and texts met by chance, which cost about 200 words each.

    A bit differs with probability angle / pi; two sets of equal size and Jaccard similarity s have the cosine 2s / (1 + s).
    """
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tables = {b: math.ceil(math.log(1 - recall) / math.log(1 - within(b, radius, angle))) for b in range(16, 65)}
    work = lambda b: tables[b] * (sum(math.comb(b, k) for k in range(radius // 2 + 1)) + 200 * n * within(b, radius, 0.5))
    bits = min(tables, key=work)
    return bits, tables[bits]


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles (ASCII letters in lower case, split at ASCII white space)."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts, known = (text or "").encode().lower().split(), self.known
        if not parts:
            return np.zeros(0, np.uint64)
        if len(known) > KNOWN:
            known.clear()
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        k = min(self.words, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signs(hashes: np.ndarray, n: int) -> np.ndarray:
    """n SimHash bits: whether over half the mixed hashes have the bit set; the least hash decides ties."""
    salts = np.arange(1, -(-n // 64) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)

    def mixed(h: np.ndarray) -> np.ndarray:
        x = (h[:, None] ^ salts[None]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        return np.unpackbits(x.view(np.uint8).reshape(len(h), -1), axis=1)

    if not len(hashes):
        return np.zeros(n, bool)
    votes = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(hashes), 255):  # sums that fit a byte
        votes += mixed(hashes[at : at + 255]).sum(axis=0, dtype=np.uint8)
    votes = 2 * votes - len(hashes)
    return np.where(votes == 0, mixed(hashes[:1])[0] == 1, votes > 0)[:n]


def bitmap(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) % 2 == 1).tobytes()


def longs(maps: pa.Array | pa.ChunkedArray, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(maps.to_pylist()), np.uint64).reshape(len(maps), bits // 64)


@lru_cache(maxsize=256)
def _masks(bits: int, flips: int) -> np.ndarray:
    return ball_masks(bits, flips)


def meetings(fps: np.ndarray, own: np.ndarray, lead: int, done: int, bits: int, half: int, limit: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(member, first member) of those that meet on a word whose leading ``done`` bits are ``lead``. own: the members' numbers, in their order.

    Beyond ``limit`` words the next bit divides them, so that memory stays bounded however alike the texts are.
    """
    rest = bits - done
    apart = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(lead)) if done else np.zeros(len(fps), np.uint8)
    use = apart <= half
    fps, own, apart = fps[use], own[use], apart[use]
    if len(fps) < 2:
        return
    k = int(own.max()).bit_length()
    each = np.bincount(apart, minlength=half + 1)
    if rest and (rest + k > 64 or sum(int(n) * len(_masks(rest, half - d)) for d, n in enumerate(each)) > limit):
        for bit in (0, 1):
            yield from meetings(fps, own, lead << 1 | bit, done + 1, bits, half, limit)
        return
    base, low = fps & np.uint64((1 << rest) - 1), np.uint64((1 << k) - 1)
    parts = [(((base[at][:, None] ^ _masks(rest, half - d)[None]) << np.uint64(k)) | own[at][:, None]).ravel() for d in range(half + 1) for at in [apart == d]]
    s = np.concatenate(parts)
    s.sort()
    same = (s[1:] >> np.uint64(k)) == (s[:-1] >> np.uint64(k))
    at = np.flatnonzero(same) + 1
    if len(at):
        begins = np.flatnonzero(~same) + 1
        first = np.concatenate([[0], begins])[np.searchsorted(begins, at, "right")]
        pair = np.unique((s[at] & low) << np.uint64(32) | (s[first] & low))
        yield pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)


def room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many shingles two sets of these sizes may differ: their sum less twice the least overlap; -1 if the sizes alone differ too much."""
    return np.where(5 * np.minimum(a, b) >= 4 * np.maximum(a, b), a + b + 2 * (-4 * (a + b) // 9), -1)


def dealing(n: int, bits: int, half: int, block: int) -> tuple[list[tuple[int, ...]], int]:
    """(choices of parts, each given by its lowest bit; bits of a part): about ``block`` of n fingerprints that are alike in a choice come to a group.

    A word lies within ``half`` flips of each of two fingerprints that meet on it, so of 2 * half + c parts of the bits at least c are
    those of both. Each choice of c parts deals the fingerprints by their bits there: comb(2 * half + c, c) copies, whatever n is up to
    block * 2 ** (c * width). Without parts (c = 0) one group has all.
    """
    widths = [bits // (2 * half + c) for c in range(bits - 2 * half + 1)] if half else [0, bits]
    c = next((c for c, w in enumerate(widths) if n <= block << c * w), max(range(len(widths)), key=lambda c: c * widths[c]))
    w = widths[c]
    return list(combinations(range(0, (2 * half + c) * w, w) if w else [0], c)), w


def turned(fps: np.ndarray, parts: tuple[int, ...], width: int, bits: int) -> np.ndarray:
    """The fingerprints with the bits of these parts in front."""
    front = [p + i for p in parts for i in range(width - 1, -1, -1)]
    out = np.zeros(len(fps), np.uint64)
    for i in [*front, *sorted({*range(bits)} - {*front}, reverse=True)]:
        out = out << np.uint64(1) | (fps >> np.uint64(i)) & np.uint64(1)
    return out


def candidates(classes: DataFrame, bits: int, radius: int, n: int, block: int = 400_000) -> DataFrame:
    """classes (node, size, small, fps), n of them: distinct (u, v), u < v, that sizes and small bitmaps don't rule out.

    About ``block`` fingerprints come to one task (:func:`dealing`). Each text that a word joins with the first of all its texts
    meets that one in a group too, for both keep the bits of one choice of parts.
    """
    half = radius // 2
    ways, width = dealing(n, bits, half, block)
    lead = width * len(ways[0])
    each = classes.select("node", "size", "small", F.posexplode("fps").alias("nth", "fp"))

    def group(way: int) -> Column:
        own = F.col("nth").cast("long") * len(ways) + way
        for p in ways[way]:
            own = F.shiftleft(own, width).bitwiseOR(F.shiftrightunsigned("fp", p).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        return own

    dealt = each.select(F.explode(F.array(*map(group, range(len(ways))))).alias("g"), "fp", "node", "size", "small")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        nth, way = divmod(g >> lead, len(ways))
        node, fps, size = (table.column(c).to_numpy() for c in ("node", "fp", "size"))
        small = longs(table.column("small"), SMALL)
        order = np.argsort((node.view(np.uint64) ^ np.uint64(nth)) * np.uint64(0x9E3779B97F4A7C15))
        node, fps, size, small = node[order], turned(fps[order].view(np.uint64), ways[way], width, bits), size[order].astype(np.int64), small[order]
        found = [np.zeros(0, np.uint64)]
        for a, b in meetings(fps, np.arange(len(node), dtype=np.uint64), g & ((1 << lead) - 1), lead, bits, half):
            x, y = a.astype(np.int64), b.astype(np.int64)
            near = np.bitwise_count(small[x] ^ small[y]).sum(1) <= room(size[x], size[y])
            found.append(a[near] << np.uint64(32) | b[near])
        pair = np.unique(np.concatenate(found))
        a, b = node[(pair >> np.uint64(32)).astype(np.int64)], node[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        return pa.table({"u": pa.array(np.minimum(a, b)), "v": pa.array(np.maximum(a, b))})

    return dealt.groupBy("g").applyInArrow(run, "u long, v long").distinct()


def similar_links(docs: DataFrame, keep: tuple[str, ...], words: int = 5, radius: int = 4, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """docs (keep, text): rows (keep, node), and roots (linked, root) of the nodes that a link of similarity 0.8 or more, or a chain of them, joins."""
    own = docs.select(*keep, "text")
    bits, tables = tables_for(own.select(F.xxhash64("text").alias("t")).distinct().count(), radius, 0.8, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, places = Shingler(words), np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(len(keep))]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            fps = [(signs(s, bits * tables).reshape(tables, bits) * places).sum(axis=1, dtype=np.uint64) for s in sets]
            flat = np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * tables, pa.int32()), pa.array(flat))
            maps = [bitmap(s) for s in sets]
            small = [np.bitwise_xor.reduce(np.frombuffer(m, np.uint64).reshape(-1, SMALL // 64)).tobytes() for m in maps]
            columns = [pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array(small, pa.binary()), lists, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*keep, "node", "size", "small", "fps", "bits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("text").schema)
    found = cut(own.mapInArrow(run, f"{schema}, node long, size int, small binary, fps array<long>, bits binary"))
    classes = cut(found.groupBy("node").agg(F.min(F.struct(*keep)).alias("k"), *(F.first(c).alias(c) for c in ("size", "small", "fps", "bits"))))
    pairs = candidates(classes.select("node", "size", "small", "fps"), bits, radius, classes.count())

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (longs(b.column(c), BITS) for c in ("bu", "bv"))
            near = np.bitwise_count(x ^ y).sum(1) <= room(b.column("su").to_numpy().astype(np.int64), b.column("sv").to_numpy().astype(np.int64))
            yield b.select(["u", "v", "su", "sv"]).filter(pa.array(near))

    ends = classes.select("node", "size", "bits")
    both = pairs.join(ends.toDF("u", "su", "bu"), "u").join(ends.toDF("v", "sv", "bv"), "v")
    close = cut(both.select("u", "v", "su", "sv", "bu", "bv").mapInArrow(differ, "u long, v long, su int, sv int"))
    asked = close.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node").select("node", "k.*")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            for k in range(b.num_rows):
                s = pa.array(shingles(b.column(1)[k].as_py()).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), s)], names=["node", "s"])

    sets = cut(own.join(asked, list(keep)).dropDuplicates(["node"]).select("node", "text").mapInArrow(whole, "node long, s array<long>"))

    def linked(of: DataFrame) -> DataFrame:
        shared = of.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v").withColumn("o", F.size(F.array_intersect("x", "y")))
        return shared.where("9 * o >= 4 * (su + sv)").select("u", "v")

    chosen = close.groupBy("u").agg(F.min(F.struct("v", "su", "sv")).alias("c")).select("u", "c.*")
    sure = cut(linked(chosen))
    roots = components(sure).toDF("linked", "root")
    apart = close.join(roots.alias("a"), F.col("u") == F.col("a.linked"), "left").join(roots.alias("b"), F.col("v") == F.col("b.linked"), "left")
    apart = apart.where(F.coalesce("a.root", "u") != F.coalesce("b.root", "v")).select(*close.columns)
    more = cut(linked(apart.join(chosen.select("u", "v"), ["u", "v"], "left_anti")))
    return found.select(*keep, "node"), components(sure.union(more)).toDF("linked", "root") if more.limit(1).count() else roots


def one_of_similar(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each group linked by similarity 0.8 or more: that of the smallest doc_id (null last), then of the least hash of its text."""
    keep = ("__n", "__d", "__t")
    keyed = docs.withColumn("__d", F.coalesce("doc_id", F.lit(0))).withColumn("__t", F.xxhash64(F.col("doc_id").isNull(), "text")).withColumn("__n", F.col("doc_id").isNull())
    found, roots = similar_links(keyed, keep, words)
    rooted = found.join(roots, F.col("node") == F.col("linked"), "left").select(*keep, F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct(*keep)).alias("f")).select("f.__d", "f.__t")
    stays = keyed.join(first, ["__d", "__t"], "left_semi")
    again = F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.lit(1)))  # the same row given twice
    return stays.withColumn("__again", again).where("__again = 1").drop("__d", "__t", "__n", "__again")
