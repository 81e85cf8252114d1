import random

import pytest
from pyspark.sql import functions as F

from colonnade.functions.prefix import global_last_before, global_row_number, global_running_sum
from colonnade.operators import compare, documents, graph, merge, translate, validate, versions
from colonnade.plans.evaluate import evaluate
from colonnade.plans.grammar import Refused
from colonnade.plans.model import TableDef
from colonnade.sources import csvtable, render, xlsx


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_prefix_functions(spark):
    data = [(i, (i * 7) % 31 if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(data, "i int, v int").repartition(5)
    assert rows(global_row_number(df, [F.col("i").asc()], "n").select("i", "n")) == sorted(((i, i + 1) for i in range(200)), key=repr)
    total, last, sums, before = 0, None, {}, {}
    for i, v in data:
        before[i] = last
        last = v if v is not None else last
        total += v or 0
        sums[i] = total
    assert dict(rows(global_running_sum(df, [F.col("i").asc()], "v", "s").select("i", "s"))) == sums
    assert dict(global_last_before(df, [F.col("i").asc()], "v", "b").select("i", "b").collect()) == before


def test_merge(spark):
    d = lambda x: spark.createDataFrame(x, "id string, qty string, unit string")
    base = d([("1", "10", "12"), ("2", "20", "6"), ("3", "8", "15"), ("4", "12", "10")])
    ours = d([("1", "25", "12"), ("2", "20", "6"), ("3", "8", "15"), ("5", "1", "1")])
    theirs = d([("1", "10", "12"), ("2", "20", "7"), ("4", "12", "10"), ("5", "1", "2")])
    merged, conflicts = merge.merge(base, ours, theirs, "id")
    assert rows(merged) == [("1", "25", "12"), ("2", "20", "7"), ("5", "1", "1")]
    assert rows(conflicts) == [("add/add", "5", "unit", None, "1", "2")]
    merged, conflicts = merge.merge(base, d([("1", "11", "12")]), d([("1", "12", "12")]), "id")
    assert rows(conflicts) == [("edit/edit", "1", "qty", "10", "11", "12")] and rows(merged) == [("1", "11", "12")]
    with pytest.raises(Refused):
        merge.merge_columns(["a", "b"], ["a", "c", "b"], ["a"])
    assert merge.merge_columns(["a", "b"], ["a", "b", "c"], ["a", "d", "b"]) == ["a", "b", "c", "d"]
    assert merge.merge_maps({"x": 1, "y": 1}, {"x": 2, "y": 2}, {"x": 1, "y": 3}) == ({"x": 2, "y": 2}, ["y"])
    o = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "id string, pos int")
    t = spark.createDataFrame([("a", 1), ("c", 2), ("d", 3)], "id string, pos int")
    assert [r["id"] for r in merge.merged_order(o, t, "id", "pos").orderBy("anchor", "sub").collect()] == ["a", "c", "b", "d"]


def test_disjoint_edits_never_conflict(spark):
    rng = random.Random(3)
    base = [(i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(60)]
    ours = [(i, a + 1 if i % 3 == 0 else a, b) for i, a, b in base]
    theirs = [(i, a, b + 1 if i % 2 == 0 else b) for i, a, b in base]
    merged, conflicts = merge.merge(*(spark.createDataFrame(x, "k int, a int, b int") for x in (base, ours, theirs)), "k")
    assert conflicts.count() == 0 and rows(merged) == sorted(((i, o[1], t[2]) for (i, *_), o, t in zip(base, ours, theirs, strict=True)), key=repr)


def test_identity_and_drift(spark):
    d = lambda x: spark.createDataFrame(x, "k string, v string, pos int")
    old = d([("a", "1", 1), ("b", "2", 2), ("b", "3", 3)])
    assert [r["okey"] for r in versions.occurrence_key(old, ["k"], ["pos"]).orderBy("pos").collect()] == ["a", "b", "b#2"]
    assert versions.diff_size(old, d([("a", "1", 1), ("b", "9", 2)]), ["k", "v"]).first().asDict() == {"added": 1, "added_bytes": 6, "removed": 2, "removed_bytes": 12}
    t = TableDef({"total": "qty * unit", "net": "total * 0.8"}, {"grand": "sum(total)"})
    assert versions.definition_drift(t, TableDef({"total": "unit * qty", "net": "total * 0.8"}, {"grand": "sum(total)"})) == []
    swapped = TableDef({"net": "qty * unit", "total": "net * 0.8"}, {"grand": "sum(total)"})
    assert versions.definition_drift(t, swapped) == [("grand", "total")]
    moves = spark.createDataFrame([("f", 1, 2), ("f", 2, 1), ("f", 3, 3), ("g", 1, 1)], "f string, a int, b int")
    assert rows(versions.reorder_distance(moves, ["f"], "a", "b")) == [("f", 1), ("g", 0)]


def test_refusals(spark):
    lines = spark.createDataFrame([("﻿x",), ("a\rb",), ("a​b",), ("fine",)], "line string")
    assert {r["defect"] for r in validate.byte_defects(lines).collect()} == {"bom", "lone-cr", "invisible"}
    names = spark.createDataFrame([("Café",), ("café",), ("tea",)], "n string")
    assert validate.fold_collisions(names, "n").count() == 1
    n, e, o = (spark.createDataFrame(x, s) for x, s in (([("a",), ("a",), ("b",)], "name string"), ([("a", "z")], "src string, dst string"), ([("q",)], "name string")))
    assert rows(validate.canvas_faults(n, e, o)) == [("duplicate-node", "a"), ("unknown-edge-end", "z"), ("unknown-override", "q")]
    md = spark.createDataFrame([(1, "# A\n# a\n[x]: u\n[x]: v\n[^1]: n")], "doc_id int, text string")
    assert {(r["kind"], r["name"]) for r in validate.markdown_duplicates(md).collect()} == {("heading", "a"), ("link", "x")}
    assert validate.recognise(["a := 1", "b := 2"], ("a",), "hint") == (["a := 1", "b := 2"], ["unknown declaration b"])
    assert validate.recognise(["b := 2"], (), "drop")[0] == [] and validate.recognise(["b := 2"], (), "preserve") == (["b := 2"], [])
    with pytest.raises(ValueError):
        validate.recognise(["b := 2"], (), "strict")


def test_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿sku,qty\r\na,1\r\n\r\nb,2,3\r\n".encode())
    files = spark.read.format("binaryFile").load(str(tmp_path / "m.csv")).select("path", "content")
    texts, said = csvtable.decode(files)
    assert texts.first()["text"].startswith("sku,qty\na,1") and {r["code"] for r in said.collect()} == {"bom-stripped", "crlf-normalised"}
    good, ragged = csvtable.read_csv(spark, str(tmp_path / "m.csv"), ["sku", "qty"])
    assert rows(good) == [("a", "1")] and ragged.count() == 1
    cells = {"": "empty", "007": "text", "1,234.50": "number", "1.234,50": "reject", "(45.00)": "number", "05/01/2026": "reject", "2026/01/05": "date", "-": "empty", "=SUM": "text", "1e3": "number"}
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    assert {r["x"]: r["k"] for r in df.select("x", csvtable.classify(F.col("x"))["kind"].alias("k")).collect()} == cells
    assert csvtable.import_rows(df, ["x"]).where("x = '-45.00'").count() == 1
    made = evaluate(spark.createDataFrame([("r1", "4", "0"), ("r2", "4", "2")], "id string, a string, b string"), TableDef({"q": "a / b"}))
    assert [r["q"] for r in csvtable.export_text(made, "id").orderBy("b").collect()] == ["#REF!(/0)", "2"]
    assert [r["line"] for r in render.markdown(made, "id").collect()][2:] == ["| 4 | 0 | #REF!(/0) |", "| 4 | 2 | 2.0 |"]
    assert render.html(made, "id").count() == 4


def test_documents(spark):
    text = "# One\nline\n\n```\n# not a heading\n\n```\n- a\n- b\n\n\n# Two\nend"
    assert "".join(documents.split_blocks(text)) == text and [b.strip()[:5] for b in documents.split_blocks(text) if b.strip()] == ["# One", "```\n#", "- a\n-", "# Two"]
    rng = random.Random(5)
    for _ in range(200):
        t = "".join(rng.choice(["\n", "#", "```\n", "word ", "~~~", "\n\n"]) for _ in range(30))
        assert "".join(documents.split_blocks(t)) == t
    quote, body = "the quick brown fox jumps over the lazy dog today", "intro words here. the quick brown fox jumps over the lazy dog today. and more text."
    assert documents.resolve(quote, "words here. ", ". and more", 18, body)[:2] == ("exact", 18)
    assert documents.resolve(quote, "", "", 18, body.replace("lazy", "sleepy"))[0] == "fuzzy" and documents.resolve(quote, "", "", 0, "nothing alike")[0] == "orphan"
    twice = f"{quote} AAAA {quote} BBBB"
    assert documents.resolve(quote, "AAAA ", " BBBB", 0, twice)[:2] == ("context", len(quote) + 6)
    assert documents.survival("a b c d", "x a b c d", 2, 5) == ("survived", 4) and documents.survival("a b c", "z z", 0, 3)[0] == "deleted"
    base, ours, theirs = ["a long first block", "second block text", "third"], ["a long first block edited", "second block text", "third"], ["a long first block", "second block text", "added block", "fourth thing entirely"]
    assert documents.merge_blocks(base, ours, theirs) == (["a long first block edited", "second block text", "added block", "fourth thing entirely"], [])
    assert documents.merge_blocks(["same block here"], ["same block here, ours"], ["same block here, theirs"])[1]
    files = spark.createDataFrame([("a", "{{ b#x }} {{ b#no }} {{ c#x }} {{ b#two }}"), ("b", "<!-- #x -->\nhello\nthere\n\n<!-- #two -->\nq\n\n<!-- #two -->\nr\n")], "file string, text string")
    got = {(r["target"], r["region"]): r["body"] or r["err"] for r in documents.transclusions(files).collect()}
    assert got == {("b", "x"): "hello\nthere", ("b", "no"): "no region no in b", ("c", "x"): "no such artifact: c", ("b", "two"): "region two declared 2x in b"}
    d = spark.createDataFrame([(1, "a\nb\na\nc"), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["n"], r["window"]) for r in documents.minimum_anchor(d).where("doc_id = 1").collect()} == {(0, 2), (1, 1), (2, 2), (3, 1)}
    chunks = documents.content_chunks(spark.createDataFrame([(1, "xyz abc " * 4000)], "doc_id long, text string"), 256, 1024, 4096)
    assert chunks.agg(F.sum("size")).first()[0] == 32000 and chunks.agg(F.max("size")).first()[0] <= 4096
    assert rows(documents.heading_survival(d.withColumn("text", F.lit("# A\n# B\n# B")), d.withColumn("text", F.lit("# B")))) == [(6, 3, 3)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "f")], "src string, dst string")
    assert rows(graph.on_cycles(e)) == [("a",), ("b",), ("c",), ("d",)]
    nodes = spark.createDataFrame([(x, x) for x in "abcdef"], "node string, content string")
    assert {r["node"]: r["err"] for r in graph.closure_hash(nodes, e).collect()} == {"a": "cycle", "b": "cycle", "c": "cycle", "d": "cycle", "e": None, "f": None}
    over = spark.createDataFrame([("e", 1, 2)], "name string, x int, y int")
    flat = graph.layers(spark.createDataFrame([("e", 1), ("f", 2)], "name string, place int"), e.where("src = 'e'"), over)
    assert rows(flat) == [("e", 0, 1, 2), ("f", 1, 100, 200)]


def test_reports(spark):
    k = spark.createDataFrame([(0, 10), (5, 10), (10, 10)], "k int, n int").select(compare.exact_interval("k", "n").alias("i")).select("i.*")
    assert [(round(a, 4), round(b, 4)) for a, b in rows(k)] == [(0.0, 0.3085), (0.1871, 0.8129), (0.6915, 1.0)]
    a, b, c = (spark.createDataFrame(x, "item int, label string") for x in ([(1, "x"), (2, "y"), (3, "x")], [(1, "x"), (2, "x"), (3, "y")], [(2, "y")]))
    assert rows(compare.agreement(a, b, c, "item", "label")) == [(1, "x", "agreed"), (2, "y", "adjudicated"), (3, None, "open")]
    s = spark.createDataFrame([(i, i % 3) for i in range(30)], "i int, g int")
    assert compare.stratified_sample(s, ["g"], "i", 4).count() == 12
    assert rows(compare.signatures(spark.createDataFrame([("r", "b"), ("r", "a"), ("s", "c")], "reason string, ex string"), "reason", "ex")) == [("r", 2, "a"), ("s", 1, "c")]


@pytest.mark.parametrize(
    ("formula", "kind", "named"),
    [
        ("=B5*$C5", "CLEAN", "qty * unit"), ("=SUM(D2:D9)", "AGGREGATE", "sum(total)"), ("=SUBTOTAL(109,T[total])", "AGGREGATE", "sum(total)"), ("=[@qty]+1", "CLEAN", "qty + 1"), ("=ROUND(B5,2)", "CLEAN-WIDE", "round(qty, 2)"),
        ('=SUMIF(A2:A9,"EU",D2:D9)', "AGGREGATE", 'sum(total where vendor = "EU")'), ("=COUNTIFS(A2:A9,A5)", "AGGREGATE", "count(vendor where vendor = @vendor)"), ("=B4*C5", "UNTRANSLATABLE", ""), ("=NOW()", "UNTRANSLATABLE", ""),
        ('=IF(A5="x",B5,0)', "CLEAN", 'if(vendor = "x", qty, 0)'), ("=XLOOKUP(A5,A2:A9,D2:D9)", "CLEAN", "lookup(self, vendor, total)"), ("=VLOOKUP(A5,A2:D9,4)", "UNTRANSLATABLE", ""), ("=LEFT(A5,1)", "NEEDS-HUMAN", ""), ("=Other!B5", "UNTRANSLATABLE", ""), ("=B5^2", "UNTRANSLATABLE", ""), ("=E5+1", "NEEDS-HUMAN", ""),
    ],
)
def test_translation(formula, kind, named):
    headers = {"A": "vendor", "B": "qty", "C": "unit", "D": "total", "E": "twin", "F": "twin"}
    assert translate.translate(formula, 5, headers, 2, 9, frozenset({"vendor"}))[:2] == (kind, named)


def test_translation_helpers():
    assert translate.column_letters(translate.column_number("AZ")) == "AZ" and translate.relative_form("=A1+$B2", 2, 2) == "=R[-1]C[-1]+R[0]C2"
    assert translate.shifted('=A1+$B$2&"A1"', 1, 1) == '=B2+$B$2&"A1"' and translate.surface("=SUM(a, b)*2") == "(a + b)*2"


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "t.xlsx")
    xlsx.write_workbook(path, ["item", "qty", "unit", "total"], [("a", 2, 3.5, 7.0), ("b & c", 4, 1.0, 4.0)], {"total": "t[[#This Row],[qty]]*t[[#This Row],[unit]]"})
    assert xlsx.table_range(open(path, "rb").read()) == [("table1", 2, 3, 1, 4)]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    cells = xlsx.read_cells(files)
    assert cells.where("row = 3 and col = 1").first()["value"] == "b & c" and cells.where("formula is not null").count() == 2
    where = xlsx.layout(cells)
    assert rows(where.drop("path")) == [("table", 1, 2, 3)]
    body, loss = xlsx.to_rows(cells, where)
    assert {(r["row"], r["name"]): r["value"] for r in body.collect()}[3, "item"] == "b & c" and loss.count() == 0
    days = spark.createDataFrame([(59.0,), (61.0,), (45000.5,)], "d double").select(xlsx.serial_date(F.col("d")).alias("s"))
    assert [r["s"] for r in days.collect()] == ["1900-02-28", "1900-03-01", "2023-03-15 12:00:00"]


def test_late_rows_are_evaluated_again(spark, tmp_path):
    from colonnade.streaming import keep_evaluated, latest

    t = TableDef({"total": "cumulative(v)"}, key="id", order="ts", partition=("g",))
    schema = "id int, g string, ts int, v double"
    for n, part in enumerate([[(1, "x", 1, 1.0), (2, "y", 1, 5.0)], [(3, "x", 3, 2.0)], [(4, "x", 2, 10.0)]]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_evaluated(stream, t, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = latest(spark.read.parquet(str(tmp_path / "out")), t)
    assert {r["id"]: r["total"] for r in got.collect()} == {1: 1.0, 2: 5.0, 4: 11.0, 3: 13.0}


def test_repeated_merge_keys_are_conflicts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    ours = base.union(spark.createDataFrame([(2, "c")], base.schema))
    _, conflicts = merge.merge(base, ours, base, "id")
    assert ("repeated key", "2", None, "1", "2", "1") in {tuple(r) for r in conflicts.collect()}
    assert merge.merge(base, base, base, "id")[1].count() == 0


def test_minted_ids_count_only_rows_that_repeat_key_and_content(spark):
    old = spark.createDataFrame([(1, "a", "old1")], "k long, v string, row_id string")
    new = spark.createDataFrame([(1, "a", None, 0), (2, "b", None, 1), (3, "b", None, 2), (3, "b", None, 3)], "k long, v string, row_id string, pos long")
    got = versions.carry_ids(old.withColumn("pos", F.col("k")), new, "row_id", ["k"], ["v"], "pos").orderBy("pos").collect()
    plain = [r["m"] for r in new.select("pos", versions.minted_id(["k", "v"]).alias("m")).orderBy("pos").collect()]
    assert [r["row_id"] for r in got] == ["old1", plain[1], plain[2], plain[3] + "_2"]


def test_blocks_leave_in_pieces(spark):
    """A worker hands blocks on after PIECE characters, not when a batch of texts is done."""
    import pyarrow as pa

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

        mapInPandas = mapInArrow  # noqa: N815

    texts = [f"{i}\n\n{'word ' * 30_000}\n" for i in range(40)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(42), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(documents.blocks(Docs())(iter([batch])))
    assert len(out) > 4 and max(sum(map(len, b.column(3).to_pylist())) for b in out) < 2 * documents.PIECE
    assert "".join(r for b in out for r in b.column(3).to_pylist()) == "".join(t or "" for t in texts) and {i for b in out for i in b.column(0).to_pylist()} == set(range(40))


def test_fuzzy_places_are_those_of_the_definition_with_few_comparisons(monkeypatch):
    import difflib

    def by_definition(quote, pos, text, fuzzy=0.5, margin=0.15):
        low, high = max(0, pos - documents.WINDOW), min(len(text), pos + len(quote) + documents.WINDOW)
        starts = [low + m.start() for m in documents.re.finditer(r"(?<!\w)\w", text[low:high])]
        scored = [(r, s) for s in starts if (r := difflib.SequenceMatcher(None, text[s : s + len(quote)], quote, autojunk=False).ratio()) >= fuzzy]
        if not scored:
            return "orphan", None, 0.0
        best = max(scored)
        others = [r for r, s in scored if abs(s - best[1]) >= len(quote) // 2]
        return ("fuzzy" if best[0] - max(others, default=0.0) >= margin else "ambiguous"), best[1], best[0]

    rng, calls, seen = random.Random(4), [0], set()

    class Counting(difflib.SequenceMatcher):
        def ratio(self):
            calls[0] += clear
            return super().ratio()

    for k in range(60):
        clear = k % 3 > 0 and k % 5 > 0  # one place is by far the best
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz\U0001d51e", k=rng.randint(2, 8))) for _ in range(400)]
        quote = " ".join(words[200:208])
        words[203] = words[203] + "this" if k % 3 else "".join(rng.choices("xyzq", k=40))
        if k % 5 == 0:
            words[100:108] = words[200:208]
        text = " ".join(words)
        want = by_definition(quote, text.index(words[200]), text) if quote not in text else None
        with monkeypatch.context() as m:
            m.setattr(documents.difflib, "SequenceMatcher", Counting)
            got = documents.resolve(quote, "", "", text.index(words[200]), text)
        if want:
            seen.add(got[0])
            assert got == want
    assert "fuzzy" in seen and len(seen) > 1 and calls[0] < 32 * 100  # of 32 texts of 400 places
