"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 2h have a word within h of both. So every distinct fingerprint emits all
words within h of it (its ball), the words are brought together, and fingerprints that meet on a word are
linked: the triangle inequality makes each meeting a true link, and none is missed.

A ball of 64 bits and h = 2 has 2,081 words. They are not shuffled one by one: words are dealt by their
leading bits, a fingerprint goes once to each leading-bit pattern its ball reaches, and the words with
that pattern are written out where it arrives. The number of leading bits follows the number of
fingerprints, so that a task's words stay within a fixed size. At a word only star links to the smallest
fingerprint are emitted, not all pairs; they are made distinct, verified bit by bit, and reduced to a
forest before they leave the task. Components come from alternating star contraction.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; equal texts share a
fingerprint, so copies never multiply work; null doc_ids keep their rows, and a component of null ids alone
has a null id; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.shared import cut
from colonnade.llm.components import components
from colonnade.llm.slices import sliced_join

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeats included; ASCII letters in lower case, split at ASCII white space."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, "<u8")
    flat = b" ".join(parts)
    ends = np.cumsum([len(p) for p in parts]) + np.arange(len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts by parts
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for row in range(0, len(bits), 255):  # sums that fit a byte
            counts += bits[row : row + 255].sum(axis=0, dtype=np.uint8)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprint(text: str | None, words: int = 5) -> int:
    """64-bit SimHash of a text."""
    return majority(shingle_hashes(text, words))


def several(text: str | None, words: int, n: int) -> list[int]:
    """n SimHashes: the first over the hashes themselves, the others over n - 1 further mixes of them."""
    h = shingle_hashes(text, words)
    out = [majority(h)]
    for i in range(1, n):
        g = (h ^ (h >> np.uint64(32))) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1)
        out.append(majority((g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)))
    return out


def fingerprints(docs: DataFrame, words: int = 5, keep: tuple[str, ...] = ("doc_id",), n: int = 1) -> DataFrame:
    """The columns to keep, and fps: n fingerprints, their 64 bits as signed longs."""
    own = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([several(t.as_py(), words, n) for t in b.column(len(keep))], dtype=np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * n, pa.int32()), pa.array(fps.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*keep, "fps"])

    return own.mapInArrow(run, own.drop("text").schema.add("fps", T.ArrayType(T.LongType())))


def ball_masks(bits: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(bits), n)], dtype=np.uint64)


def block_links(fps: np.ndarray, lead: int, lead_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller one of its group) among those whose balls meet on words with this lead."""
    rest = 64 - lead_bits
    word, owner = [], []
    apart = np.bitwise_count((fps >> np.uint64(rest)) ^ np.uint64(lead))
    base = (fps & np.uint64((1 << rest) - 1)) | np.uint64(lead << rest)
    for d in range(half + 1):
        own = np.flatnonzero(apart == d)
        masks = ball_masks(rest, half - d)
        word.append((base[own][:, None] ^ masks[None]).ravel())
        owner.append(np.repeat(own.astype(np.int32), len(masks)))
    words, owners = np.concatenate(word), np.concatenate(owner)
    del word, owner
    ordered = np.sort(words)
    met = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if not len(met):
        return fps[:0], fps[:0]
    spot = np.searchsorted(met, words)
    spot[spot == len(met)] = 0
    hit = met[spot] == words
    group, member = spot[hit], owners[hit]
    rank = np.argsort(np.argsort(fps, kind="stable"), kind="stable")
    first = np.full(len(met), len(fps), np.int64)
    np.minimum.at(first, group, rank[member])
    ranked = np.sort(fps)
    links = np.unique(np.stack([rank[member], first[group]], 1), axis=0)
    links = links[links[:, 0] != links[:, 1]]
    near = np.bitwise_count(ranked[links[:, 0]] ^ ranked[links[:, 1]]) <= 2 * half
    links = links[near]
    root = np.arange(len(fps))
    while True:  # the links of this task reduced to a forest
        new = root.copy()
        np.minimum.at(new, links[:, 0], root[links[:, 1]])
        np.minimum.at(new, links[:, 1], root[links[:, 0]])
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return ranked[moved], ranked[root[moved]]


def ball_links(fps: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Star links (nth, u, v) that connect all fingerprints (distinct nth, fp) of the same nth within an even radius of each other.

    block: about so many fingerprints write out their whole balls in one task.
    """
    half = radius // 2
    most = fps.groupBy("nth").count().agg(F.max("count")).first()[0] or 1
    bits = min(20, max(6, (max(1, most // block) - 1).bit_length()))
    reach = F.array(*(F.lit(int(m)).cast("long") for m in ball_masks(bits, half)))
    lead = F.shiftrightunsigned("fp", 64 - bits)
    dealt = fps.select("nth", "fp", F.explode(F.transform(reach, lambda m: lead.bitwiseXOR(m))).alias("lead"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.column("fp").to_numpy().view(np.uint64)
        u, v = block_links(own, key[1].as_py(), bits, half)
        return pa.table({"nth": pa.array([key[0].as_py()] * len(u), pa.int32()), "u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return dealt.groupBy("nth", "lead").applyInArrow(run, "nth int, u long, v long")


def rooted(classes: DataFrame, radius: int = 4) -> DataFrame:
    """classes (node, fps: fingerprints by place). (node, root): the same root for all nodes that share a fingerprint, or have ones within the radius, over any way."""
    each = cut(classes.select("node", F.posexplode("fps").alias("nth", "fp")))
    least = cut(each.groupBy("nth", "fp").agg(F.min("node").alias("m")))
    links = ball_links(least.select("nth", "fp"), radius)
    ends = links.join(least.toDF("nth", "u", "mu"), ["nth", "u"]).join(least.toDF("nth", "v", "mv"), ["nth", "v"]).select(F.col("mu").alias("u"), F.col("mv").alias("v"))
    shared = each.join(least, ["nth", "fp"]).where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    linked = components(ends.union(shared)).toDF("linked", "root")
    return cut(classes.select("node").join(linked, F.col("node") == F.col("linked"), "left").select("node", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 5) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links)."""
    found = cut(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), words).select("doc_id", F.get("fps", F.lit(0)).alias("fp")))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = rooted(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), radius).toDF("fp", "root")
    smallest = cut(distinct.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = sliced_join(roots, smallest, ["root"], "n", ["fp"]).select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, words: int = 5, n: int = 12) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then of the least hash of its text.

    Of two texts of similarity 0.8 to 0.9 one fingerprint seldom falls within 4 bits; each further one of the n gives another chance.
    """
    keyed = docs.withColumn("__d", F.coalesce("doc_id", F.lit(0))).withColumn("__t", F.xxhash64(F.col("doc_id").isNull(), "text")).withColumn("__n", F.col("doc_id").isNull())
    found = cut(fingerprints(keyed, words, ("__n", "__d", "__t"), n).withColumn("node", F.xxhash64("fps")))
    classes = found.groupBy("node").agg(F.first("fps").alias("fps"))
    first = found.join(rooted(classes, radius), "node").groupBy("root").agg(F.min(F.struct("__n", "__d", "__t")).alias("f")).select("f.__d", "f.__t")
    stays = keyed.join(first, ["__d", "__t"], "left_semi")
    again = F.row_number().over(Window.partitionBy("__d", "__t").orderBy(F.lit(1)))  # the same row given twice
    return stays.withColumn("__again", again).where("__again = 1").select(*docs.columns)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=4)


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
