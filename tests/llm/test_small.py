"""Operators on pairs, searches and byte strings against brute force, and the defined edge cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colonnade.llm import contamination, inducedsort, linechunks, mixing, quality, simhash, similar, suffixes, tokenrollup, topk, toxicity, urltree
from colonnade.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, h string, key string"


def documents(spark, texts, sources=None):
    """Rows with columns that clash with names operators use."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), 0.5, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, null ids."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    d = documents(spark, [None, "", "a", "one two three four five", "one two three four five", long, "x\ny\nx\ny\nz", "\n\n\n", "ümläut 😀 text", "\x00\x01"], ["s", None, "s", "t", "t", "s", "u", "u", None, "s"])
    nulls = d.limit(3).withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    return d.union(d.where("doc_id = 3")).union(nulls)


# ---- 1: contamination


def tiles_by_definition(a, b, least):
    """Greedy string tiling as it is defined: all longest common runs of unmarked tokens, again and again."""
    ma, mb, out = set(), set(), []
    while True:
        best, found = least, []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ma and j + n not in mb:
                n += 1
            if n > best:
                best, found = n, [(i, j)]
            elif n == best:
                found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not ma & set(range(i, i + best)) and not mb & set(range(j, j + best)):
                ma |= set(range(i, i + best))
                mb |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiling_is_greedy_string_tiling():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        assert contamination.tile(a, b, 2) == tiles_by_definition(a, b, 2)


def test_contamination_finds_reordered_passages(spark, odd):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    turned = "noise zeta ETA theta, iota kappa! more noise alpha beta gamma delta epsilon end"
    docs = documents(spark, [turned, item, "alpha beta gamma only", None, "", "alpha x beta y gamma z"])
    got = sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["coverage"]) for r in contamination.contaminated(docs, bench).collect())
    assert got == [(0, 7, 2, 1.0)] * 2 + [(1, 7, 1, 1.0)] * 2
    small = contamination.contaminated(docs, bench, block_tokens=5)
    assert sorted((r["doc_id"], r["item_id"]) for r in small.collect()) == [(0, 7)] * 2 + [(1, 7)] * 2
    assert sorted(r["doc_id"] for r in contamination.decontaminate(docs, bench).collect()) == [2, 3, 4, 5]
    assert contamination.contaminated(odd, bench).count() == 0 and contamination.decontaminate(odd, bench).count() == odd.count()
    assert contamination.contaminated(docs.limit(0), bench).count() == 0 and contamination.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = ([(r[0], contamination.tokens(r["text"])) for r in spark.read.parquet(f"{d}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    want = set()
    for (i, a), (k, b) in itertools.product(docs, items):
        grams = {tuple(b[j : j + 3]) for j in range(len(b) - 2)}
        if grams & {tuple(a[j : j + 3]) for j in range(len(a) - 2)} and sum(n for *_, n in contamination.tile(b, a, 3)) >= 0.6 * len(b):
            want.add((i, k))
    got = {(r["doc_id"], r["item_id"]) for r in contamination.op1_contamination(spark, d).collect()}
    assert got == want and want


# ---- 2: top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (300, 12))
    x[50:120] = x[50]  # ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (400, None), (None, [1] * 12), (500, [1, 2]), (501, [3, 4]), (502, []), (503, [])]
    df = spark.createDataFrame(data, "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), 5, pivots=6, query_block=3, row_block=40).collect()
    for q in range(0, 300, 50):
        want = sorted(((-int(x[q] @ x[i]), i) for i in range(300) if i != q))[:5]
        assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == [(k, *w) for k, w in enumerate(want, 1)]
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 500] == [(501, 11)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_pivot_bounds_stop_early():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (8, 16)).astype(float)
    x = centres[np.arange(4000) % 8] + rng.integers(-3, 3, (4000, 16))
    rows = topk.Rows(np.arange(4000), x, topk.distances(x, centres))
    for floor in (-np.inf, float(np.sort(x @ x[0])[-40])):
        rows.scored = 0
        ids, scores = next(rows.best(np.array([0]), x[:1], topk.distances(x[:1], centres), np.array([floor]), 5, batch=64))
        order = sorted((-int(x[0] @ x[i]), i) for i in range(1, 4000))[:5]
        assert list(zip((-scores).astype(int), ids, strict=True)) == order
        assert rows.scored <= 640, rows.scored  # of 3,999


def test_queries_reach_only_the_blocks_they_need(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (8, 16))
    x = centres[np.arange(800) % 8] + rng.integers(-3, 3, (800, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    sent, real = [], topk.needed
    topk.needed = lambda *a: sent.append((out := real(*a)).count()) or out
    try:
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), row_block=25, sample=200).collect()
    finally:
        topk.needed = real
    want = {(q, k, i) for q in range(0, 800, 50) for k, (_, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(800) if i != q)[:5], 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want
    assert sent[0] <= 16 * 32 / 3, sent  # 16 queries, 32 blocks or more


def test_top_k_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [-1e300, 5.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, None), (50, [2.0, -1.0]), (8, [3e9, 3e9]), (9, [0.001, -0.001])]
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in topk.op2_top_k(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    exact = {i: [int(x * 256) if abs(x) > 1e6 else int(np.floor(x * 256)) for x in v] for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i], strict=True)), i) for i in exact if i != q)[:5]
        want += [(q, k, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best, 1)]
    assert got == want
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert topk.op2_top_k(spark, str(tmp_path / "none")).count() == 0


# ---- 3: SimHash


def fingerprint_by_definition(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_definition(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components(spark, odd):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    fps = [fingerprint_by_definition(t) for _, t in rows]
    want = {i: (f"{f:016x}", rows[r][0]) for (i, _), f, r in zip(rows, fps, linked_by_definition(fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_near_duplicates(spark, d).collect()} == want
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {0}
    assert {r["doc_id"] for r in simhash.one_of_each(odd).collect()} >= {0, 2, 3, 5} and simhash.one_of_each(odd).where("doc_id = 3").count() == 1
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.one_of_each(odd.limit(0)).columns == odd.columns


def test_ball_links_miss_no_chain(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains of near ones
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["node"]: r["root"] for r in simhash.rooted(spark.createDataFrame([(s, [s]) for s in signed], "node long, fps array<long>")).collect()}
    want = linked_by_definition(fps)
    groups = lambda label: {frozenset(i for i in range(len(fps)) if label(i) == g) for g in map(label, range(len(fps)))}
    assert groups(lambda i: got[signed[i]]) == groups(lambda i: want[i])


def test_several_fingerprints_link_what_one_misses(spark):
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    near = list(words)
    for i in (40, 120, 200, 280, 360):
        near[i] = "edited"
    texts = [" ".join(words), " ".join(near), " ".join(rng.sample(words, 400))]
    assert [r["doc_id"] for r in simhash.one_of_each(documents(spark, texts), n=32).orderBy("doc_id").collect()] == [0, 2]
    fps = [simhash.several(t, 5, 32) for t in texts]
    assert fps[0][0] == simhash.fingerprint(texts[0], 5) == fingerprint_by_definition(texts[0], 5) and len(set(fps[0])) == 32


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).distinct().collect())
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(30)}


# ---- 5: line chunks


def test_line_dedup_edges(spark, odd):
    passage = "\n".join(f"line {i} of the passage" for i in range(30))
    texts = [f"head a\n{passage}\ntail a", f"other\nmore\n{passage}\nend", passage, "solo"]
    got = {r["doc_id"]: r for r in linechunks.dedup_lines(documents(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_removed"] == 0 and got[3]["text"] == "solo"
    assert got[1]["n_removed"] >= 20 and got[1]["text"].startswith("other") and got[1]["n_lines"] == 33
    out = linechunks.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count()
    assert {r["doc_id"]: r["n_lines"] for r in out.where("doc_id is not null").collect()}[1] == 1 and out.where("text is null and n_lines = 0").count() == 2
    assert out.where("doc_id = 3 and n_removed = 0").count() == 2 and linechunks.dedup_lines(odd.limit(0)).count() == 0


# ---- 6: suffix arrays


def test_suffix_arrays_and_repeats():
    rng, wide = random.Random(6), inducedsort.WIDE
    try:
        for n in range(300):
            inducedsort.WIDE = rng.choice([1, 3, 2048])
            parts = [bytes(rng.choice(b"ab" if n % 2 else b"abcd") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
            t, _ = inducedsort.joined(parts)
            assert inducedsort.suffix_array(t, 258).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
            k = rng.randint(1, 6)
            seen = collections.Counter(p[i : i + k] for p in parts for i in range(len(p) - k + 1))
            for p, flags in zip(parts, inducedsort.repeated_places(parts, k), strict=True):
                assert flags.tolist() == [i + k <= len(p) and seen[p[i : i + k]] > 1 for i in range(len(p))]
    finally:
        inducedsort.WIDE = wide


def test_names_are_sorted_by_induction_at_every_level(spark):
    """1 MB of given texts has tens of thousands of names; whatever the scan, the order is the same."""
    raw = "\n".join(r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"]).encode()[: 1 << 20]
    t, left = inducedsort.joined([raw])
    levels, real = [], inducedsort.suffix_array
    inducedsort.suffix_array = lambda s, sigma: levels.append(sigma) or real(s, sigma)
    try:
        sa = inducedsort.suffix_array(t, 258)
    finally:
        inducedsort.suffix_array = real
    assert max(levels) > inducedsort.WIDE and len(levels) > 2
    before, shared = inducedsort.common_prefixes(t, sa, left)
    for i in random.Random(1).sample(range(len(raw)), 3000):
        if before[i] >= 0:
            j, n = int(before[i]), int(shared[i])
            assert t[i : i + n].tolist() == t[j : j + n].tolist() and t[j : j + n + 400].tolist() < t[i : i + n + 400].tolist()
    assert sorted(sa.tolist()) == list(range(len(t)))


def removed_by_definition(texts, k):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + k] for r in raws for i in range(len(r) - k + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - k + 1):
            if seen[r[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes_against_definition(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 90))) for _ in range(6)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("xyz") for _ in range(9)) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    texts += [None, "", texts[0], "for " * 100, "ab" * 30, "for " * 70]
    got = suffixes.deduplicate(documents(spark, texts), f"t6_{seed}", 40, anchor=25, part=500)
    assert {r["doc_id"]: tuple(r)[1:5] for r in got.collect()} == dict(enumerate(removed_by_definition(texts, 40)))
    assert got.where("sha2(kept, 256) <> kept_sha256").count() == 0
    crowded = suffixes.deduplicate(documents(spark, texts), f"t6_crowded_{seed}", 40, anchor=25, part=500, crowd=1, step=4)
    assert {r["doc_id"]: tuple(r)[1:5] for r in crowded.collect()} == dict(enumerate(removed_by_definition(texts, 40)))
    for t in (f"t6_{seed}", f"t6_crowded_{seed}"):
        spark.sql(f"DROP TABLE {t}")


def test_runs_of_a_crowded_anchor_share_their_bytes():
    rng = random.Random(3)
    base = bytes(rng.choice(b"abcd") for _ in range(300))
    raws = [base, b"x" * 7 + base[20:] + b"y" * 50, base[:200]]
    groups: dict[bytes, set[int]] = {}
    for raw in raws:
        for h, first, last, spot in zip(*(v.tolist() for v in suffixes.anchors(np.frombuffer(raw, np.uint8), 40, 25)), strict=True):
            seen = []
            for group, a, z in suffixes.cuts(raw, h, first, last, spot, 40, 4):
                seen += range(a, z + 1)
                for w in range(a, z + 1):
                    groups.setdefault(raw[w : w + 40], set()).add(group)
            assert sorted(seen) == list(range(first, last + 1))
    assert all(len(g) == 1 for g in groups.values())


def test_repeated_bytes_edges(spark, odd):
    out = suffixes.deduplicate(odd, "t6_odd", 400)
    assert out.count() == odd.count() and out.where("n_bytes = 0 and n_removed = 0 and n_spans = 0").count() >= 4
    assert suffixes.deduplicate(odd.limit(0), "t6_none", 400).count() == 0
    for t in ("t6_odd", "t6_none"):
        spark.sql(f"DROP TABLE {t}")


def test_repeated_bytes_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = dict(zip([i for i, _ in rows], removed_by_definition([t for _, t in rows], 400), strict=True))
    assert {r["doc_id"]: tuple(r)[1:5] for r in suffixes.op6_repeated_bytes(spark, d).collect()} == want


# ---- 7: URLs


def test_url_rules_and_templates(spark):
    urls = {0: "https://a.example.com/en/71?x", 1: "http://EXAMPLE.com/en/8", 2: "http://x.net/de/1#t", 3: "http://www.example.net/de/81", 4: "no scheme", 5: None, 6: "http://com/fr/", 7: "ftp://h.org", 8: "http://notcom/en/1", 9: "http://h.io//", 10: "http://h.io/" + "a/" * 300}
    pages = spark.createDataFrame([(i, u, None, "z") for i, u in urls.items()], "page_id long, url string, bad int, host string")
    got = {r["page_id"]: r for r in urltree.judge_urls(pages).collect()}
    assert {i: (r["host"], r["rule"], r["verdict"]) for i, r in got.items() if i < 9} == {
        0: ("a.example.com", "example.com/en/7", "allow"), 1: ("example.com", "com/en/", "block"), 2: ("x.net", "net/de/", "allow"), 3: ("www.example.net", "example.net/de/8", "block"), 4: ("", None, "allow"), 5: ("", None, "allow"), 6: ("com", None, "allow"), 7: ("h.org", None, "allow"), 8: ("notcom", None, "allow"),
    }
    assert len(got) == 11 and urltree.judge_urls(pages.limit(0)).count() == 0
    site = [(i, f"http://shop.io/{'spam' if i % 4 == 0 else 'news'}/{i}", int(i % 4 == 0)) for i in range(200)]
    got = urltree.judge_urls(spark.createDataFrame(site, "page_id long, url string, bad int"))
    assert {(r["template"], r["verdict"]) for r in got.collect()} == {("/spam/*", "block"), ("/news/*", "allow")}
    mixed = [(i, f"http://shop.io/{'ab'[i % 2]}/{i}", int(i % 7 == 0)) for i in range(200)]
    assert {r["template"] for r in urltree.judge_urls(spark.createDataFrame(mixed, "page_id long, url string, bad int")).collect()} == {"/*/*"}


# ---- 8: token counts


def test_token_rollup(spark, tmp_path, odd):
    store = tokenrollup.RollupStore(spark, str(tmp_path / "s"))
    change = lambda rows: spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    first = [("insert", 1, "a", "en", "v1", 10, 40), ("insert", 2, "a", "de", "v1", 5, 20), ("insert", 3, None, None, "v1", 1, 2), ("insert", None, "a", "en", "v1", 2, 3)]
    assert store.commit("b1", change(first)) and not store.commit("b1", change(first))
    with pytest.raises(ValueError):
        store.commit("b1", change(first[:1]))
    assert store.commit("b2", change([("revise", 1, "b", "en", "v1", 12, 44), ("delete", 2, None, None, "v1", None, None), ("insert", 1, "a", "en", "v2", 7, 40), ("delete", 99, None, None, "v1", None, None)]))
    want = {("a", "en", "v1"): (1, 2, 3), ("b", "en", "v1"): (1, 12, 44), (None, None, "v1"): (1, 1, 2), ("a", "en", "v2"): (1, 7, 40)}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == want and store.ledger().count() == 4
    assert store.commit("empty", change([]).limit(0)) and store.commit("b3", change([("insert", 1, "b", "en", "v1", 12, 44)]))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == want and not store.commit("b1", change(first)) and len(store._held()) == 1
    assert store.commit("b5", change([("delete", 3, None, None, "v1", None, None)])) and {tuple(r)[:3] for r in store.totals().collect()} == want.keys() - {(None, None, "v1")}
    assert store.commit("b6", change(first[2:3])) and len(store._held()) == 3
    store.compact()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in store.totals().collect()} == want and len(store._held()) == 1
    (tmp_path / "s/ledger/batch=dead").mkdir()  # a writer that died before its marker
    assert store.ledger().count() == 4
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            store.commit(bad, change([]).limit(0))
    with pytest.raises(ValueError):
        store.commit("b4", change([("upsert", 1, "b", "en", "v1", 1, 1)]))
    counts = tokenrollup.token_counts(odd, "v1")
    assert counts.count() == odd.count() and counts.where("doc_id = 0").first()["n_tokens"] == 0


def test_token_counts_query(spark):
    import base64

    import tiktoken

    with open(tokenrollup.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=tokenrollup.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert enc.decode(enc.encode_ordinary("Round trip, 123 ümläut!")) == "Round trip, 123 ümläut!"
    want = collections.Counter()
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want[r["source"], r["lang"]] += len(enc.encode_ordinary(r["text"]))
    assert {(r["source"], r["lang"]): r["n_tokens"] for r in tokenrollup.op8_token_rollup(spark, "/root/testdata/sf0.001").collect()} == dict(want)


# ---- 10: mixing


def test_mixing(spark, odd):
    rng = random.Random(8)
    texts = [" ".join("w" for _ in range(rng.randint(1, 30))) for _ in range(900)]
    sources = [rng.choice("aaaabc") for _ in texts]
    docs = documents(spark, texts, sources)
    out = mixing.mix_sources(docs)
    got = out.collect()
    total, by = sum(len(t.split()) for t in texts), collections.defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * len(texts[r["doc_id"]].split()) and 0 <= r["copies"] <= 3
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6 and all(abs(by[s] - t) <= 30 and t <= 3 * n for s, (t, n) in targets.items())
    assert sorted(mixing.mix_sources(docs.repartition(5)).select("doc_id", "taken").collect()) == sorted(out.select("doc_id", "taken").collect())
    heavy = mixing.mix_sources(docs, importance=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).where("source = 'a'").groupBy((F.col("doc_id") % 2).alias("o")).agg(F.avg("copies").alias("c")).collect()
    assert {r["o"]: r["c"] for r in heavy}[0] > {r["o"]: r["c"] for r in heavy}[1]
    edge = mixing.mix_sources(odd)
    assert edge.count() == odd.count() and edge.where("text is null and size <> 0").count() == 0 and edge.where("source is null").count() == 5
    assert mixing.mix_sources(odd.limit(0)).count() == 0 and mixing.mix_sources(odd.where("size(split(text, 'q')) < 0 or text = ''")).count() >= 1


# ---- 4 and 9: classifiers


@pytest.fixture(scope="module")
def sf(spark):
    return "/root/testdata/sf0.01"


def held_out(spark, df, sf, label):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return df.where("held_out").join(labels, "doc_id").select("predicted", label, "score").toPandas()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # the smaller tables hold out 14 toxic rows, too few to bound a rate
    out = toxicity.op4_toxicity(spark, sf)
    x = held_out(spark, out, sf, "toxic")
    hit = ((x["predicted"] == 1) & (x["toxic"] == 1)).sum()
    assert hit / max(1, x["predicted"].sum()) >= 0.95 and hit / x["toxic"].sum() >= 0.85
    assert out.where("score is null or score < 0 or score > 1").count() == 0 and out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_deobfuscation(spark, sf):
    model = toxicity.char_model(spark.read.parquet(f"{sf}/documents.parquet"))
    restorer = toxicity.Restorer(model)
    for seen, meant in {"1d10t": "idiot", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiiiiot": "idiot", "m0r0n": "moron", "tr@sh": "trash", "p4th3tic": "pathetic", "cl0wn!!!": "clown", "stuuupid": "stupid", "d1sgust1ng": "disgusting"}.items():
        assert meant in restorer.words(f"the {seen} there"), seen
    assert restorer.words("Plain words, as they are.") == {"plain", "words", "as", "they", "are"} and restorer.words(None) == restorer.words("") == set()


def test_viterbi_takes_the_best_path():
    rng = np.random.default_rng(9)
    model = toxicity.CharModel(np.arange(toxicity.SIZE**3), rng.integers(0, 50, toxicity.SIZE**3))
    flat, table = model.flat(), toxicity.classes()

    def score(parts):
        total, a, b = 0.0, 0, 0
        for s, cost in parts:
            total += cost
            for c in s:
                z = int(table[ord(c)])
                if not (z == 0 and b == 0):
                    total += flat[(a * 64 + b) * 64 + z]
                    a, b = b, z
        return total + flat[(a * 64 + b) * 64]

    for seen in ("1d10t", "a.b.c", "s$5s", "b00k", "x1|y"):
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", seen)]
        ways = itertools.product(*(toxicity._options(c, n, 0 < k < len(runs) - 1) for k, (c, n) in enumerate(runs)))
        best = max(score(w) for w in ways)
        assert any(abs(score(w) - best) < 1e-9 for w in itertools.product(*(toxicity._options(c, n, 0 < k < len(runs) - 1) for k, (c, n) in enumerate(runs))) if "".join(s for s, _ in w) == toxicity.decode(seen, model))


def test_quality_on_held_out_rows(spark, sf):
    out = quality.op9_quality(spark, sf)
    x = held_out(spark, out, sf, "quality")
    assert (x["predicted"] == x["quality"]).mean() >= 0.93 and out.where("score is null or score < 0 or score > 1").count() == 0


def test_non_negative_risk_gradient():
    rng = np.random.default_rng(1)
    p, u, w = rng.normal(size=(40, 5)), rng.normal(size=(60, 5)), rng.normal(size=5)

    def risk(w, prior):
        loss = lambda z: np.logaddexp(0, -z).mean()
        neg = loss(-(u @ w)) - prior * loss(-(p @ w))
        return prior * loss(p @ w) + neg if neg >= 0 else -neg

    for prior in (0.3, 0.99):
        g = quality.pu_gradient(w, p, u, prior)
        for i in range(5):
            step = np.eye(5)[i] * 1e-6
            assert abs((risk(w + step, prior) - risk(w - step, prior)) / 2e-6 - g[i]) < 1e-4


def test_prior_estimate():
    rng = np.random.default_rng(2)
    for prior in (0.3, 0.7):
        pos, neg = rng.beta(8, 2, 20000), rng.beta(2, 8, 20000)
        unl = np.concatenate([pos[: int(20000 * prior)], neg[: int(20000 * (1 - prior))]])
        hist = lambda s: np.histogram(s, 400, (0, 1))[0]
        assert abs(quality.estimate_prior(hist(rng.beta(8, 2, 5000)), hist(unl)) - prior) < 0.05


def test_classifier_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, label int")
    some = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (6, None), (2, 0), (2, 1)], "doc_id long, label int")
    for labels in (none, some):
        tox = toxicity.with_scores(odd, toxicity.fit(odd, labels))
        assert tox.count() == odd.count() and tox.where("score is null or isnan(score)").count() == 0
        q, prior = quality.quality_scores(odd, labels)
        assert q.count() == odd.count() and q.where("score is null or isnan(score)").count() == 0 and 0 < prior < 1
    assert toxicity.with_scores(odd.limit(0), toxicity.fit(odd.limit(0), some)).count() == 0 and quality.quality_scores(odd.limit(0), some)[0].count() == 0


def test_sliced_join_is_the_join(spark):
    from colonnade.llm.slices import sliced_join

    keys = [1] * 3000 + [2] * 40 + list(range(10, 400)) + [None, None]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("k") * 2)
    got = sliced_join(rows, per_key, ["k"], "n", ["i"])
    assert got.columns == ["k", "i", "n", "x"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, keys.count(k), 2 * k) for i, k in enumerate(keys) if k is not None)
    assert sliced_join(rows.limit(0), per_key.limit(0), ["k"], "n", ["i"]).count() == 0


def test_line_dedup_of_a_frequent_chunk(spark):
    docs = spark.createDataFrame([(i, f"only {i}\nhere {i}\nalpha\nbeta\ngamma\ndelta\nepsilon\nzeta\neta\ntheta") for i in range(1500)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linechunks.dedup_lines(docs).collect()}
    assert len(got) == 1500 and got[0]["n_removed"] == 0
    assert all(got[i]["n_removed"] > 0 and got[i]["text"].startswith(f"only {i}\n") for i in range(1, 1500))


def passages_by_definition(texts):
    """Text by text: the lines left when all that stand in a pair of neighbouring lines seen earlier are gone."""
    seen, out = set(), []
    for t in texts:
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 1):
            if (lines[i], lines[i + 1]) in seen:
                gone |= {i, i + 1}
            seen.add((lines[i], lines[i + 1]))
        left = [x for i, x in enumerate(lines) if i not in gone]
        out.append(("\n".join(left), len(lines), len(gone)))
    return out


def test_every_repeated_passage_goes(spark, odd):
    rng = random.Random(5)
    passages = [[f"passage {p} line {i} " + "word " * 30 for i in range(2 + p % 7)] for p in range(40)]
    texts = ["\n".join(p) for p in passages]
    texts += ["\n".join([f"own {k} {rng.random()}", *p, f"end {k}"]) for k, p in enumerate(passages)]
    texts += ["a\na\na\na", "x\ny\nx\ny\nz", "", "solo", "solo", "\n\n\n", *texts[40:60]]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linechunks.dedup_passages(documents(spark, texts)).collect()}
    assert got == dict(enumerate(passages_by_definition(texts)))
    assert all(got[40 + k][2] == len(p) for k, p in enumerate(passages)) and all(got[i][0] == "" for i in range(86, 106))
    out = linechunks.dedup_passages(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed"] and out.count() == odd.count() and out.where("text is null and n_lines = 0").count() == 2
    assert out.where("doc_id = 3 and n_removed = 0").count() == 2 and linechunks.dedup_passages(odd.limit(0)).count() == 0


def test_passages_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = dict(zip([i for i, _ in rows], passages_by_definition([t for _, t in rows]), strict=True))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linechunks.dedup_passages(docs).collect()}
    assert got == want
    assert all(r["n_removed"] <= got[r["doc_id"]][2] for r in linechunks.dedup_lines(docs).collect())


def test_passages_are_found_by_content_defined_chunks(spark):
    rng = random.Random(6)
    texts = ["\n".join(f"line {rng.randrange(400)}" for _ in range(rng.choice((2, 3, 9, 40)))) for _ in range(60)]
    texts += texts[:30] + ["\n".join(["head", *t.split("\n"), "tail"]) for t in texts[:10]]

    def chunked(t):  # a border where the rolling hash of two lines is divisible by 3, unless the line before or after has one or the text ends
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        border = [i > 0 and (h[i - 1] % 1_000_003 * 257 + h[i]) % 1_000_003 % 3 == 0 for i in range(len(lines))]
        ends = [i for i in range(1, len(lines) - 2) if border[i] and not border[i - 1]] + [len(lines) - 1]
        return [(a, e + 1 - a) for a, e in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    docs = documents(spark, texts).selectExpr("doc_id as __d", "xxhash64(text) as __t", "false as __null", "text")
    rows, first = linechunks.passage_parts(docs, 2, 3)
    got = collections.Counter((r["__d"], r["idx"]["at"], r["idx"]["n"]) for r in rows.collect())
    want, seen = collections.Counter(), set()
    for d, t in enumerate(texts):
        cs, lines = chunked(t), t.split("\n")
        assert all(n >= 2 for _, n in cs) and sum(n for _, n in cs) == len(lines)
        want.update((d, a, n) for a, n in cs)
        want.update((d, a + n - 1, 2) for a, n in cs[:-1])
        for a, n in cs:
            if (part := tuple(lines[a : a + n])) not in seen:  # pairs inside a chunk are compared once for all its copies
                want.update((d, i, 2) for i in range(a, a + n - 1))
            seen.add(part)
    assert got == want and len(got) < sum(len(t.split("\n")) * 2 for t in texts) and first.count() > 100
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linechunks.dedup_passages(documents(spark, texts)).collect()}
    assert out == dict(enumerate(passages_by_definition(texts))) and all(out[i][0] == "" for i in range(60, 90))


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_by_definition(rows):
    """Smallest ids of the groups linked by exact similarity of 0.8 or more; rows (id, text), ids ascending."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in root if find(i) == i}


def test_similar_texts_are_those_of_the_definition(spark, odd):
    rng = random.Random(11)
    texts = []
    for n in [*range(1, 12), *[rng.randint(5, 900) for _ in range(90)]]:
        words = [f"w{rng.randint(0, 4000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(2):
            near = list(words)
            for i in rng.sample(range(n), rng.randint(0, max(1, n // 22))):
                near[i] = f"edit{rng.random()}"
            texts.append(" ".join(near) + " and one boilerplate line of seven words here" * (rng.random() < 0.2))
    js = [jaccard(a, b) for k in range(0, len(texts), 3) for a, b in itertools.combinations(texts[k : k + 3], 2)]
    assert sum(0.8 <= j < 0.9 for j in js) > 20 and sum(0.6 <= j < 0.8 for j in js) > 20
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert {r["doc_id"] for r in similar.one_of_similar(documents(spark, texts)).collect()} == kept_by_definition(rows)
    kept = similar.one_of_similar(odd)
    assert {r["doc_id"] for r in kept.collect()} >= {0, 2, 3, 5} and kept.where("doc_id = 3").count() == 1 and kept.columns == odd.columns
    assert similar.one_of_similar(odd.limit(0)).count() == 0


def test_meetings_are_pairs_within_the_radius():
    rng = np.random.default_rng(3)
    bits, half = 20, 2
    base = rng.integers(0, 1 << bits, 40, dtype=np.uint64)
    fps = np.concatenate([base, base[:20] ^ np.uint64(5), base[:10] ^ np.uint64(0x8421), base[:10] ^ np.uint64(0xF0F0F)])
    own = np.arange(len(fps), dtype=np.uint64)
    for limit in (1 << 22, 500):  # whole, and divided by further bits
        found = {(int(a), int(b)) for x, y in similar.meetings(fps, own, 0, 0, bits, half, limit) for a, b in zip(x, y, strict=True)}
        near = {(j, i) for i, j in itertools.combinations(range(len(fps)), 2) if int(fps[i] ^ fps[j]).bit_count() <= 4}
        assert found and found <= near
        words = [{int(f) ^ int(m) for m in simhash.ball_masks(bits, half)} for f in fps]
        stars = {(j, min(k for k in range(len(fps)) if w in words[k])) for j in range(len(fps)) for w in words[j]}
        assert found == {(a, b) for a, b in stars if a != b}
    byparts = {(int(a), int(b)) for lead in range(8) for x, y in similar.meetings(fps, own, lead, 3, bits, half) for a, b in zip(x, y, strict=True)}
    assert byparts == found


def test_dealing_copies_do_not_grow_with_the_texts(spark):
    """Fingerprints go to few groups each however many texts there are, and no pair that meets in one group of all is missed."""
    for n in (10**5, 10**6, 10**7, 10**8, 10**10):
        bits, _ = similar.tables_for(n)
        ways, width = similar.dealing(n, bits, 2, 400_000)
        assert len({*ways}) == len(ways) <= (5 if n <= 10**7 else 15) and n <= 400_000 << width * len(ways[0]) and all(p + width <= bits for w in ways for p in w)
    rng = np.random.default_rng(8)
    bits = 20
    base = rng.integers(0, 1 << bits, (60, 1), dtype=np.uint64)
    flip = lambda k: sum(1 << int(i) for i in rng.choice(bits, k, replace=False))
    fps = [*base, *([f ^ np.uint64(flip(k)) for f in row] for k in range(6) for row in base[:25])]
    rows = [(node, 100, bytes(similar.SMALL // 8), [int(f) for f in row]) for node, row in enumerate(fps)]
    classes = spark.createDataFrame(rows, "node long, size int, small binary, fps array<long>")
    whole, *parts = ({tuple(r) for r in similar.candidates(classes, bits, 4, len(rows), block).collect()} for block in (10**6, 30, 4))
    for block, found in zip((30, 4), parts, strict=True):
        assert len(similar.dealing(len(rows), bits, 2, block)[0]) in (5, 15) and whole <= found
        assert all(u < v and any((int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(fps[u], fps[v], strict=True)) for u, v in found)
    assert len(whole) > 100


def test_tables_reach_the_recall():
    for n in (1, 1000, 10**6, 10**9, 10**11):
        bits, tables = similar.tables_for(n)
        p = similar.within(bits, 4, np.arccos(1.6 / 1.8) / np.pi)
        assert 1 - (1 - p) ** tables >= 0.99 > 1 - (1 - p) ** (tables - 1) and bits <= 64
        assert n * similar.within(bits, 4, 0.5) < 30  # met by chance in a table


def test_recall_of_near_duplicates(spark):
    """Pairs just over the similarity asked for, as a share of those found; pairs below never."""
    rng = random.Random(5)
    texts = []
    for _ in range(400):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(60, 600))]
        near, n = list(words), len(words)
        while jaccard(" ".join(words), " ".join(near)) > 0.83:
            near[rng.randrange(n)] = f"e{rng.random()}"
        texts += [" ".join(words), " ".join(near)]
    true = {2 * k + 1 for k in range(400) if jaccard(*texts[2 * k : 2 * k + 2]) >= 0.8}
    gone = set(range(800)) - {r["doc_id"] for r in similar.one_of_similar(documents(spark, texts)).collect()}
    assert len(true) > 300 and gone <= true and len(gone) >= 0.97 * len(true)


def test_ordinary_disguises_open_a_lattice(spark, sf):
    restorer = toxicity.Restorer(toxicity.char_model(spark.read.parquet(f"{sf}/documents.parquet")))
    for seen, meant in {"1d107": "idiot", "idi07": "idiot", "idi0+": "idiot", "1053r": "loser", "id.iot": "idiot", "id-iot": "idiot", "i  d  i  o  t": "idiot", "i. d. i. o. t": "idiot", "i - d - i - o - t": "idiot", "iiddiioott": "idiot"}.items():
        assert meant in restorer.words(f"the {seen} there"), seen
    for seen in ("a55", "a$$", "a$$!"):  # opened; the language model decides how many letters a run stands for
        assert toxicity.HIDDEN.search(seen) and any(w.startswith("as") for w in restorer.words(f"the {seen} there")), seen
    assert "book" in restorer.words("a book.") and restorer.words("1 2 3 ... - - - ***") == set()
    for long in ("." * 50_000, "a " * 50_000, "- " * 50_000, "a.b-" * 20_000 + "!!"):  # no pattern runs away
        restorer.words(long)


def test_mixing_draws_all_eligible_where_they_are_too_few(spark):
    docs = documents(spark, ["w w w w w"] * 40, ["a"] * 20 + ["b"] * 20)
    got = mixing.mix_sources(docs, importance=F.when(F.col("doc_id") % 20 == 0, 1.0).otherwise(0.0)).collect()
    short = {r["source"] for r in got if r["target"] % r["source_size"] > 5}
    assert short and all(r["copies"] == r["target"] // r["source_size"] + (r["doc_id"] % 20 == 0) for r in got if r["source"] in short)


def test_room_rules_out_no_similar_pair():
    """A pair of similarity 0.8 or more never differs in more shingles than room says; one that differs in more is below 0.8."""
    a, b, o = (x.ravel() for x in np.meshgrid(*[np.arange(1, 61)] * 3))
    a, b, o = (x[(o <= a) & (o <= b)] for x in (a, b, o))
    assert (((a + b - 2 * o) <= similar.room(a, b)) == (5 * o >= 4 * (a + b - o))).all()


def test_small_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 700):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[n // 5 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
        maps = [np.bitwise_xor.reduce(np.frombuffer(similar.bitmap(s), np.uint64).reshape(-1, similar.SMALL // 64)) for s in (x, y)]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(x, y))


def decoded_by_definition(observed, model):
    """Viterbi over every run of characters."""
    log, table = model.flat(), toxicity.classes()
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", observed, re.S)]
    best = {(0, 0): (0.0, "")}
    for k, (c, n) in enumerate(runs):
        new = {}
        for s, cost in toxicity._options(c, n, 0 < k < len(runs) - 1):
            for (a, b), (score, path) in best.items():
                now, x, y = score + cost, a, b
                for z in (int(table[ord(ch)]) if ord(ch) < 1 << 16 else toxicity.OTHER for ch in s):
                    if not (z == 0 and y == 0):
                        now += log[(x * 64 + y) * 64 + z]
                        x, y = y, z
                if (x, y) not in new or now > new[x, y][0]:
                    new[x, y] = (now, path + s)
        best = new
    return max(best.items(), key=lambda e: (e[1][0] + log[(e[0][0] * 64 + e[0][1]) * 64], e[0]))[1][1]


def test_decoding_passes_over_letters_that_stand_for_themselves():
    rng = np.random.default_rng(4)
    model = toxicity.CharModel(np.arange(64**3), rng.integers(0, 50, 64**3))

    class Counted(list):
        seen = 0

        def __getitem__(self, i):
            Counted.seen += 1
            return super().__getitem__(i)

    some = random.Random(4)
    tokens = ["".join(some.choice("aabbeost01$.!-* ²éß😀,1") for _ in range(some.randint(1, 14))) for _ in range(3000)]
    tokens += ["committee", "übermorgen", "aab", "baa", "aabb", "a²²b", "x" * 200, "ab" * 100 + "cc"]
    assert [toxicity.decode(t, model) for t in tokens] == [decoded_by_definition(t, model) for t in tokens]
    model._flat = Counted(model.flat())
    toxicity.decode("representation" * 10 + "ss" + "representation" * 10, model)
    assert Counted.seen <= 12


def test_tokens_and_texts_open_lattices_by_definition():
    rng = random.Random(8)
    model = toxicity.CharModel(np.arange(64**3), np.ones(64**3))
    restorer = toxicity.Restorer(model, keep=50)
    for _ in range(3000):
        t = "".join(rng.choice("aabeost01$.,;:!-*²é") for _ in range(rng.randint(1, 9)))
        s = t.strip(toxicity.EDGES)
        own = [s] if s.isalpha() else []
        assert set(restorer.restored(t)) == set(own + toxicity.WORD.findall(toxicity.decode(t, model)) if toxicity.HIDDEN.search(t) else own or toxicity.WORD.findall(s)), t
        low = "".join(rng.choice("ab .-\n\té") for _ in range(rng.randint(3, 12)))
        one = [i for i, c in enumerate(low) if c not in toxicity.SEPARATORS]
        bare = [all(not 0 <= j < len(low) or low[j] in toxicity.SEPARATORS or ord(low[j]) <= 32 for j in (i - 1, i + 1)) for i in one]
        assert toxicity.spaced_out(low) == any(all(bare[k : k + 3]) for k in range(len(bare) - 2)), repr(low)
    assert len(restorer.tokens) <= 50
