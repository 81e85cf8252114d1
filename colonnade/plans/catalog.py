"""Named queries over the Parquet tables of a folder, and SQL that gives the same rows.

Versions that merge, diff and identity operators need are derived from the tables by the keys, the same way
in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.values import date_key, number
from colonnade.operators import compare, documents, graph, merge, translate, validate, versions
from colonnade.plans.evaluate import evaluate, scalars, shown
from colonnade.plans.model import TableDef
from colonnade.sources import csvtable, tabletext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- computed columns and aggregates -------------------------------------------------------------------

CHAIN = TableDef({"disc": "l_extendedprice * (1 - l_discount)", "charge": "disc * (1 + l_tax)"}, {"total": "sum(charge)", "lines": "count(charge)"})
CHAIN_SQL = """SELECT round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS total, count(*)::DOUBLE AS lines FROM lineitem"""


@query(CHAIN_SQL)
def computed_chain(spark, d):
    return rounded(scalars(evaluate(table(spark, d, "lineitem"), CHAIN), CHAIN), 2, "total").select("total", "lines")


@query(CHAIN_SQL)
def computed_order_free(spark, d):
    turned = TableDef(dict(reversed(CHAIN.formulas.items())), CHAIN.aggregates)
    return rounded(scalars(evaluate(table(spark, d, "lineitem"), turned), turned), 2, "total").select("total", "lines")


@query("""SELECT CASE WHEN l_linenumber = 1 THEN '/0' END AS err, count(*) AS n, round(sum(CASE WHEN l_linenumber <> 1 THEN l_extendedprice / (l_linenumber - 1) END), 2) AS total FROM lineitem GROUP BY 1""")
def div_zero_ref(spark, d):
    t = TableDef({"share": "l_extendedprice / (l_linenumber - 1)"})
    return evaluate(table(spark, d, "lineitem"), t).groupBy(F.col("share__err").alias("err")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("share"), 2).alias("total"))


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN '#REF!(quality)' ELSE ((n_chars + 0.0) * quality)::DOUBLE::VARCHAR END AS weighted FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)""")
def blank_ref(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return shown(evaluate(docs, TableDef({"weighted": "n_chars * quality"}, key="doc_id"))).select("doc_id", "weighted")


@query("""SELECT sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::DOUBLE AS high, sum(CASE WHEN l_quantity <= l_linenumber * 5 THEN -l_quantity ELSE 2 * l_quantity END) AS mixed FROM lineitem""")
def if_numeric(spark, d):
    t = TableDef({"h": "if(l_discount > 0.05, 1, 0)", "m": "if(l_quantity <= l_linenumber * 5, -l_quantity, 2 * l_quantity)"}, {"high": "sum(h)", "mixed": "sum(m)"})
    return scalars(evaluate(table(spark, d, "lineitem"), t), t).select("high", "mixed")


@query("""SELECT sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END)::DOUBLE AS others FROM lineitem""")
def if_text_eq(spark, d):
    t = TableDef({"r": 'if(l_returnflag = "R", l_quantity, 0)', "o": 'if(l_returnflag <> "R", 1, 0)'}, {"returned": "sum(r)", "others": "sum(o)"})
    return scalars(evaluate(table(spark, d, "lineitem"), t), t).select("returned", "others")


@query("""SELECT p_partkey, '#REF!(cycle)' AS a, '#REF!(cycle)' AS b, '#REF!(cycle)' AS c, (p_size * 2)::DOUBLE::VARCHAR AS e FROM part""")
def cycle_ref(spark, d):
    t = TableDef({"a": "b + p_size", "b": "a * 2", "c": "a - 1", "e": "p_size * 2"}, key="p_partkey")
    return shown(evaluate(table(spark, d, "part").select("p_partkey", "p_size"), t)).select("p_partkey", "a", "b", "c", "e")


TREES = """| tag | species | plot | planted | stems | each | worth = stems * each | plot_worth = sum(worth where plot = @plot) | running = cumulative(worth) |
| --- | --- | --- | --- | --: | --: | --: | --: | --: |
| n3 | larch | north | 2025-11-9 | 14 | 2.75 |  |  |  |
| n12 | alder | river | 2025-3-28 | 60 | 0.4 |  |  |  |
| n1 | rowan | north | 2025-3-4 | 9 | 3.2 |  |  |  |
| n8 | willow | river | 2025-10-17 | 25 | 1.15 |  |  |  |
| n4 | hazel | slope | 2025-11-9 | 5 | 7.5 |  |  |  |
| n21 | birch | river | 2026-1-2 | 33 | 0.95 |  |  |  |
| n6 | oak | slope | 2025-9-30 | 2 | 48.25 |  |  |  |

key := tag
order := by(planted)
all := sum(worth)
kinds := count(species)
wet := sum(worth where plot = "river")
spread := max(worth) - min(worth) + count(species)
"""


@query("""WITH p(tag, plot, y, m, dd, stems, each) AS (VALUES ('n3','north',2025,11,9,14,2.75),('n12','river',2025,3,28,60,0.4),('n1','north',2025,3,4,9,3.2),('n8','river',2025,10,17,25,1.15),('n4','slope',2025,11,9,5,7.5),('n21','river',2026,1,2,33,0.95),('n6','slope',2025,9,30,2,48.25)),
l AS (SELECT *, (stems * each)::DOUBLE AS worth FROM p)
SELECT tag, round(worth, 2) AS worth, round(sum(worth) OVER (PARTITION BY plot), 2) AS plot_worth, round(sum(worth) OVER (ORDER BY y, m, dd, tag ROWS UNBOUNDED PRECEDING), 2) AS running, round(sum(worth) OVER (), 2) AS "all", count(*) OVER ()::DOUBLE AS kinds, round(sum(worth) FILTER (WHERE plot = 'river') OVER (), 2) AS wet, round(max(worth) OVER () - min(worth) OVER () + count(*) OVER (), 2) AS spread FROM l""")
def end_to_end_fixture(spark, d):
    columns, rows, t = tabletext.read_table(TREES)
    df = evaluate(tabletext.stored(spark, columns, rows, t), t)
    return rounded(df.join(F.broadcast(scalars(df, t))), 2, "worth", "plot_worth", "running", "all", "wet", "spread").select("tag", "worth", "plot_worth", "running", "all", "kinds", "wet", "spread")


@query("""SELECT sum(l_quantity) AS s, count(*)::DOUBLE AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 9) AS a FROM lineitem""")
def scalar_aggs(spark, d):
    t = TableDef({}, {"s": "sum(l_quantity)", "n": "count(l_quantity)", "lo": "min(l_extendedprice)", "hi": "max(l_extendedprice)", "a": "avg(l_discount)"})
    return rounded(scalars(table(spark, d, "lineitem"), t), 9, "a").select("s", "n", "lo", "hi", "a")


@query("""SELECT '#REF!(/0)' AS total, '#REF!(/0)' AS n, '#REF!(nope)' AS missing, count(*)::DOUBLE::VARCHAR AS good FROM part""")
def agg_poisoned(spark, d):
    t = TableDef({"r": "p_retailprice / (p_size - 25)"}, {"total": "sum(r)", "n": "count(r)", "missing": "sum(nope)", "good": "count(p_size)"}, key="p_partkey")
    return shown(scalars(evaluate(table(spark, d, "part"), t), t))


@query("""SELECT sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS o, max(l_tax) FILTER (WHERE l_returnflag = 'A') AS a, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') + max(l_tax) FILTER (WHERE l_returnflag = 'A') AS both FROM lineitem""")
def filtered_aggs(spark, d):
    t = TableDef({}, {"r": 'sum(l_quantity where l_returnflag = "R")', "o": 'count(l_quantity where l_linestatus = "O")', "a": 'max(l_tax where l_returnflag = "A")', "both": 'sum(l_quantity where l_returnflag = "R") + max(l_tax where l_returnflag = "A")'})
    return scalars(table(spark, d, "lineitem"), t).select("r", "o", "a", "both")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS total, count(*) OVER (PARTITION BY o_orderpriority)::DOUBLE AS n FROM orders""")
def group_agg_one(spark, d):
    t = TableDef({"total": "sum(o_totalprice where o_orderpriority = @o_orderpriority)", "n": "count(o_totalprice where o_orderpriority = @o_orderpriority)"}, key="o_orderkey")
    return rounded(evaluate(table(spark, d, "orders"), t), 2, "total").select("o_orderkey", "total", "n")


@query("""SELECT o_orderkey, round(max(o_totalprice) OVER w, 2) AS hi, round(avg(o_totalprice) OVER w, 4) AS a, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER (PARTITION BY o_orderpriority), 0.0), 2) AS finished FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus)""")
def group_agg_two(spark, d):
    by = "o_orderpriority = @o_orderpriority and o_orderstatus = @o_orderstatus"
    t = TableDef({"hi": f"max(o_totalprice where {by})", "a": f"avg(o_totalprice where {by})", "finished": 'sum(o_totalprice where o_orderpriority = @o_orderpriority and o_orderstatus = "F")'}, key="o_orderkey")
    return rounded(rounded(evaluate(table(spark, d, "orders"), t), 2, "hi", "finished"), 4, "a").select("o_orderkey", "hi", "a", "finished")


@query("""SELECT n.n_nationkey, coalesce((SELECT sum(m.n_regionkey) FROM nation m WHERE m.n_regionkey = n.n_nationkey), 0)::DOUBLE AS s, (SELECT count(*) FROM nation m WHERE m.n_regionkey = n.n_nationkey)::DOUBLE AS k FROM nation n""")
def group_agg_cross(spark, d):
    t = TableDef({"s": "sum(n_regionkey where n_regionkey = @n_nationkey)", "k": "count(n_regionkey where n_regionkey = @n_nationkey)"}, key="n_nationkey")
    return evaluate(table(spark, d, "nation"), t).select("n_nationkey", "s", "k")


@query("""SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def lookup_hit(spark, d):
    t = TableDef({"nation": "lookup(nation, s_nationkey, n_name)"}, key="s_suppkey")
    return evaluate(table(spark, d, "supplier"), t, {"nation": (table(spark, d, "nation"), "n_nationkey")}).select("s_suppkey", "nation")


@query("""SELECT c_custkey, coalesce(n_name, '#REF!(nation[' || k || '])') AS nation, '#REF!(ghost)' AS g, '#REF!(nation#zzz)' AS z FROM (SELECT *, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1000 ELSE 0 END AS k FROM customer) LEFT JOIN nation ON k = n_nationkey""")
def lookup_miss(spark, d):
    t = TableDef({"nation": "lookup(nation, k, n_name)", "g": "lookup(ghost, k, n_name)", "z": "lookup(nation, k, zzz)"}, key="c_custkey")
    c = table(spark, d, "customer").withColumn("k", F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 1000).otherwise(0))
    return shown(evaluate(c, t, {"nation": (table(spark, d, "nation"), "n_nationkey")})).select("c_custkey", "nation", "g", "z")


@query("""SELECT s_suppkey, r_name AS region, (n_regionkey * 10)::DOUBLE AS tens FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def lookup_chain(spark, d):
    nation = evaluate(table(spark, d, "nation"), TableDef({"region": "lookup(region, n_regionkey, r_name)"}, key="n_nationkey"), {"region": (table(spark, d, "region"), "r_regionkey")})
    t = TableDef({"region": "lookup(nation, s_nationkey, region)", "rk": "lookup(nation, s_nationkey, n_regionkey)", "tens": "rk * 10"}, key="s_suppkey")
    return evaluate(table(spark, d, "supplier"), t, {"nation": (nation, "n_nationkey")}).select("s_suppkey", "region", "tens")


# ---- declared order -------------------------------------------------------------------------------------

ROW_SQL = """SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS total, lag(o_totalprice) OVER w AS before, round(o_totalprice - lag(o_totalprice) OVER w, 4) AS step FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)"""
ROWS = TableDef({"total": "cumulative(o_totalprice)", "before": "prior(o_totalprice)", "step": "delta(o_totalprice)"}, key="o_orderkey", order="o_orderdate")


def _row_relative(orders: DataFrame) -> DataFrame:
    return rounded(rounded(evaluate(orders, ROWS), 2, "total"), 4, "step").select("o_orderkey", "total", "before", "step")


@query(ROW_SQL)
def row_relative(spark, d):
    return _row_relative(table(spark, d, "orders"))


@query(ROW_SQL)
def order_invariance(spark, d):
    return _row_relative(table(spark, d, "orders").repartition(7, F.xxhash64("o_orderkey")))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'v' END AS err, CASE WHEN event_id % 10 <> 3 THEN round(sum(CASE WHEN event_id % 10 <> 3 THEN value END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) END AS total,
CASE WHEN event_id % 10 <> 3 THEN last_value(CASE WHEN event_id % 10 <> 3 THEN value END IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS before FROM events""")
def rowrel_bad_rows(spark, d):
    t = TableDef({"total": "cumulative(v)", "before": "prior(v)"}, key="event_id", order="ts")
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 10 != 3, F.col("value")))
    return rounded(evaluate(e, t), 2, "total").select("event_id", F.col("total__err").alias("err"), "total", "before")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events""")
def rowrel_partitioned(spark, d):
    t = TableDef({"total": "cumulative(value)"}, key="event_id", order="ts", partition=("user_id",))
    return rounded(evaluate(table(spark, d, "events"), t), 4, "total").select("event_id", "total")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey)::DOUBLE AS place FROM orders""")
def typed_date_order(spark, d):
    o = table(spark, d, "orders")
    text = F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    t = TableDef({"place": "cumulative(one)"}, key="o_orderkey", order="day")
    return evaluate(o.select("o_orderkey", text.alias("day"), F.lit(1).alias("one")), t).select("o_orderkey", "place")


SPELLINGS = ("007", "-0", "1e3", "1_000", "1,000", "(500)", "+5", ".5", "5.", "0x10", "NaN", "inf", "5d", " 5 ", "12.50", "-3", "٣", "2026-2-1", "2024-13-45", "2024-01/05", "", "abc")


@query("WITH s(s) AS (VALUES " + ",".join(f"('{s}')" for s in SPELLINGS) + r""") SELECT s, CASE WHEN regexp_full_match(s, '-?[0-9]+(\.[0-9]+)?') THEN s::DOUBLE END AS v, CASE WHEN regexp_full_match(s, '[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}') THEN string_split(s, '-')[1]::INT * 10000 + string_split(s, '-')[2]::INT * 100 + string_split(s, '-')[3]::INT END::DOUBLE AS day FROM s""")
def number_lexer(spark, d):
    s = spark.createDataFrame([(x,) for x in SPELLINGS], "s string")
    k = date_key(F.col("s"))
    return s.select("s", number(F.col("s")).alias("v"), (k["y"] * 10000 + k["m"] * 100 + k["d"]).cast("double").alias("day"))


# ---- refusals -------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def dup_key(spark, d):
    return validate.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT c_custkey, 4 + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS n_cells FROM customer WHERE c_custkey % 11 = 0""")
def field_count(spark, d):
    c = table(spark, d, "customer")
    line = F.concat(tabletext.canonical(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]), F.when(F.col("c_custkey") % 11 == 0, " extra |").otherwise(""))
    return validate.field_counts(c.select("c_custkey", line.alias("line")), 4).select("c_custkey", "n_cells")


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 13 = 0""")
def conflict_marker(spark, d):
    line = F.concat(F.when(F.col("c_custkey") % 26 == 0, "<<<<<<< a").when(F.col("c_custkey") % 13 == 0, "=======").otherwise("| "), "c_name")
    return validate.conflict_markers(table(spark, d, "customer").select("c_custkey", line.alias("line"))).select("c_custkey")


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'date' WHEN o_orderkey % 5 = 1 THEN 'text' ELSE 'number' END AS kind, count(*) AS n FROM orders GROUP BY 1""")
def mixed_order_type(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, F.date_format("o_orderdate", "yyyy/M/d")).when(k % 5 == 1, F.col("o_orderpriority")).otherwise(k.cast("string"))
    return validate.order_kinds(table(spark, d, "orders").select(text.alias("x")), "x")


@query("""WITH n AS (SELECT n_name AS n FROM nation UNION ALL SELECT lower(n_name) || chr(8205) FROM nation WHERE n_nationkey % 3 = 0) SELECT lower(replace(n, chr(8205), '')) AS folded, list_sort(list(DISTINCT n)) AS spellings FROM n GROUP BY 1 HAVING count(DISTINCT n) > 1""")
def fold_collision(spark, d):
    n = table(spark, d, "nation")
    return validate.fold_collisions(n.select("n_name").union(n.where("n_nationkey % 3 = 0").select(F.concat(F.lower("n_name"), F.lit("\u200d")))), "n_name")


@query("""SELECT c_custkey, '| ' || c_custkey || ' | ' || trim(c_name) || ' | ' || c_nationkey || ' | ' || trim(c_mktsegment) || ' |' AS line FROM customer""")
def canon_rows(spark, d):
    return table(spark, d, "customer").select("c_custkey", tabletext.canonical(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).alias("line"))


@query("""WITH p AS (SELECT unnest(['ok/a.csv', '../x', '/abs', 'a//b', '', 'a/.git/config', 'dir/', 'a/../b', 'fine.md']) AS path) SELECT path FROM p WHERE path = '' OR path LIKE '/%' OR path LIKE '%//%' OR path LIKE '%/' OR regexp_matches(path, '(^|/)\\.{1,2}(/|$)') OR regexp_matches(path, '(^|/)\\.git(/|$)')""".replace("\\\\", "\\"))
def unsafe_paths(spark, d):
    names = ["ok/a.csv", "../x", "/abs", "a//b", "", "a/.git/config", "dir/", "a/../b", "fine.md"]
    return validate.unsafe_paths(spark.createDataFrame([(n,) for n in names], "path string"), "path")


# ---- CSV cells ------------------------------------------------------------------------------------------

#: The same patterns as in sources/csvtable.py, for SQL.
CELL_SQL = r"""CASE WHEN s = '' THEN 'empty' WHEN regexp_full_match(s, '0\d+') THEN 'text' WHEN regexp_full_match(s, '-?\d+(\.\d+)?([eE][+-]?\d+)?') OR regexp_full_match(s, '-?\d{1,3}(,\d{3})+(\.\d+)?') THEN 'number'
WHEN regexp_full_match(s, '-?\d{1,3}(\.\d{3})+(,\d+)?|-?\d+,\d+') THEN 'reject' WHEN regexp_full_match(s, '\(\s*[\d,]+(\.\d+)?\s*\)') THEN 'number' WHEN regexp_full_match(s, '\d{2}/\d{2}/\d{4}') THEN 'reject'
WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|[A-Z][a-z]{2} \d{1,2} \d{4}|\d{1,2}-[A-Z][a-z]{2}-\d{2}') THEN 'date' WHEN s = '-' THEN 'empty' ELSE 'text' END"""


@query(rf"""WITH t AS (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS s FROM documents) SELECT {CELL_SQL} AS kind, count(*) AS n FROM t GROUP BY 1""")
def csv_classify(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("s"))
    return words.groupBy(csvtable.classify(F.col("s"))["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '(' || o_custkey || ')' WHEN 2 THEN '0' || o_custkey WHEN 3 THEN '=A1' WHEN 4 THEN '-' WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_custkey::VARCHAR END AS x FROM orders)
SELECT CASE o_orderkey % 7 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'WARN' WHEN 2 THEN 'NOTE' WHEN 3 THEN 'WARN' WHEN 4 THEN 'WARN' ELSE 'NOTE' END AS severity,
CASE o_orderkey % 7 WHEN 0 THEN 'ambiguous-date' WHEN 1 THEN 'accounting-negative' WHEN 2 THEN 'leading-zero' WHEN 3 THEN 'formula-looking-cell' WHEN 4 THEN 'excel-dash-null' ELSE 'date' END AS code, count(*) AS n FROM c WHERE o_orderkey % 7 < 6 GROUP BY ALL""")
def csv_report(spark, d):
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    x = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.concat(F.lit("("), c, F.lit(")"))).when(k == 2, F.concat(F.lit("0"), c)).when(k == 3, "=A1").when(k == 4, "-").when(k == 5, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(c)
    rows = table(spark, d, "orders").select("o_orderkey", x.alias("x"))
    return csvtable.profile(rows, ["x"], "o_orderkey").groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


# ---- merge and versions ---------------------------------------------------------------------------------


def _sides(spark: SparkSession, d: str, clash: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders as base; each side edits, deletes and adds by the key; with clash also what the other side touched."""
    base = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("cust"))
    k = F.col("k")
    new = lambda n, v: base.where(k % 40 == n).select((k + 10_000_000).alias("k"), F.lit(v).alias("status"), "priority", "cust")
    ours = base.where(k % 50 != 1).withColumn("status", F.when(k % 10 == 2, "ours").otherwise(F.col("status"))).union(new(3, "new"))
    theirs = base.where(k % 50 != 7).withColumn("priority", F.when(k % 10 == 2, "theirs").otherwise(F.col("priority"))).union(new(4, "new"))
    if clash:
        theirs = theirs.withColumn("status", F.when(k % 30 == 2, "theirs").when(k % 50 == 1, "kept").otherwise(F.col("status"))).union(new(3, "other"))
        ours = ours.withColumn("cust", F.when(k % 50 == 7, F.lit(0)).otherwise(F.col("cust")))
    return base, ours, theirs


def _sides_sql(clash: bool) -> str:
    t_status = "CASE WHEN k % 30 = 2 THEN 'theirs' WHEN k % 50 = 1 THEN 'kept' ELSE status END" if clash else "status"
    o_cust = "CASE WHEN k % 50 = 7 THEN 0 ELSE cust END" if clash else "cust"
    extra = "UNION ALL SELECT k + 10000000, 'other', priority, cust FROM b WHERE k % 40 = 3" if clash else ""
    return f"""b AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS cust FROM orders),
o0 AS (SELECT k, CASE WHEN k % 10 = 2 THEN 'ours' ELSE status END AS status, priority, cust FROM b WHERE k % 50 <> 1 UNION ALL SELECT k + 10000000, 'new', priority, cust FROM b WHERE k % 40 = 3),
t0 AS (SELECT k, status, CASE WHEN k % 10 = 2 THEN 'theirs' ELSE priority END AS priority, cust FROM b WHERE k % 50 <> 7 UNION ALL SELECT k + 10000000, 'new', priority, cust FROM b WHERE k % 40 = 4),
o AS (SELECT k, status, priority, {o_cust} AS cust FROM o0), t AS (SELECT k, {t_status} AS status, priority, cust FROM t0 {extra}),
j AS (SELECT coalesce(b.k, o.k, t.k) AS k, b.k IS NOT NULL AS ib, o.k IS NOT NULL AS io, t.k IS NOT NULL AS it, {", ".join(f"{s}.{c} AS {s}_{c}" for s in "bot" for c in ("status", "priority", "cust"))} FROM b FULL JOIN o ON b.k = o.k FULL JOIN t ON coalesce(b.k, o.k) = t.k)"""


def _same_sql(a: str, b: str) -> str:
    return "(" + " AND ".join(f"{a}_{c} IS NOT DISTINCT FROM {b}_{c}" for c in ("status", "priority", "cust")) + ")"


def _merged_sql(clash: bool) -> str:
    cell = lambda c: f"CASE WHEN ib AND io AND it THEN CASE WHEN b_{c} IS NOT DISTINCT FROM o_{c} THEN t_{c} ELSE o_{c} END WHEN io THEN o_{c} ELSE t_{c} END AS {c}"
    return f"WITH {_sides_sql(clash)} SELECT k, {', '.join(map(cell, ('status', 'priority', 'cust')))} FROM j WHERE NOT (ib AND NOT io) AND NOT (ib AND io AND NOT it AND {_same_sql('b', 'o')})"


@query(_merged_sql(False))
def merge_clean(spark, d):
    return merge.merge(*_sides(spark, d, False), "k")[0]


@query(_merged_sql(True))
def merge_kept_rows(spark, d):
    return merge.merge(*_sides(spark, d, True), "k")[0]


@query("WITH " + _sides_sql(True) + " " + " UNION ALL ".join(f"SELECT 'edit/edit' AS kind, k::VARCHAR AS key, '{c}' AS \"column\", b_{c}::VARCHAR AS base, o_{c}::VARCHAR AS ours, t_{c}::VARCHAR AS theirs FROM j WHERE ib AND io AND it AND o_{c} IS DISTINCT FROM t_{c} AND b_{c} IS DISTINCT FROM o_{c} AND b_{c} IS DISTINCT FROM t_{c}" for c in ("status", "priority", "cust"))
       + f" UNION ALL SELECT 'modify/delete', k::VARCHAR, NULL, NULL, NULL, NULL FROM j WHERE ib AND io AND NOT it AND NOT {_same_sql('b', 'o')} UNION ALL SELECT 'delete/modify', k::VARCHAR, NULL, NULL, NULL, NULL FROM j WHERE ib AND NOT io AND it AND NOT {_same_sql('b', 't')} UNION ALL "
       + " UNION ALL ".join(f"SELECT 'add/add', k::VARCHAR, '{c}', b_{c}::VARCHAR, o_{c}::VARCHAR, t_{c}::VARCHAR FROM j WHERE NOT ib AND io AND it AND o_{c} IS DISTINCT FROM t_{c}" for c in ("status", "priority", "cust")))
def merge_conflicts(spark, d):
    return merge.merge(*_sides(spark, d, True), "k")[1]


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier), n AS (SELECT s_suppkey, s_name || '!' AS s_name, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_suppkey) AS pos FROM supplier WHERE s_suppkey % 5 <> 0),
h AS (SELECT 'natural' AS scheme, count(*) AS kept FROM b JOIN n ON b.s_suppkey = n.s_suppkey UNION ALL SELECT 'opaque', count(*) FROM b JOIN n ON b.s_suppkey = n.s_suppkey UNION ALL SELECT 'position', count(*) FROM b JOIN n ON b.pos = n.pos UNION ALL SELECT 'content', 0) SELECT * FROM h""")
def merge_identity_ablation(spark, d):
    from colonnade.functions.prefix import global_row_number

    s = table(spark, d, "supplier")
    old = global_row_number(s, [F.col("s_suppkey").asc()], "pos")
    new = global_row_number(s.where("s_suppkey % 5 <> 0").withColumn("s_name", F.concat("s_name", F.lit("!"))), [F.col("s_suppkey").asc()], "pos")
    out = None
    for scheme in ("natural", "content", "opaque", "position"):
        a, b = (merge.with_identity(x, scheme, ["s_suppkey"], "pos").select("row_id") for x in (old, new))
        part = a.join(b, "row_id").agg(F.lit(scheme).alias("scheme"), F.count(F.lit(1)).alias("kept")).select("scheme", "kept")
        out = part if out is None else out.union(part)
    return out


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """part in two versions: names edited, some rows gone, some added."""
    k = F.col("p_partkey")
    v1 = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    v2 = v1.where(k % 20 != 0).withColumn("p_name", F.when(k % 6 == 0, F.concat("p_name", F.lit(" II"))).otherwise(F.col("p_name")))
    return v1, v2.union(v1.where(k % 20 == 1).select(k + 1_000_000, F.concat("p_name", F.lit(" new")), "p_brand", "p_size"))


PARTS_SQL = """v1 AS (SELECT p_partkey, p_name, p_brand, p_size FROM part), v2 AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' II' ELSE p_name END AS p_name, p_brand, p_size FROM v1 WHERE p_partkey % 20 <> 0 UNION ALL SELECT p_partkey + 1000000, p_name || ' new', p_brand, p_size FROM v1 WHERE p_partkey % 20 = 1)"""
LINE_SQL = "concat_ws(' | ', p_partkey::VARCHAR, p_name, p_brand, p_size::VARCHAR)"


@query(f"""WITH {PARTS_SQL}, o AS (SELECT {LINE_SQL} AS l FROM v1), n AS (SELECT {LINE_SQL} AS l FROM v2), a AS (SELECT l FROM n EXCEPT ALL SELECT l FROM o), r AS (SELECT l FROM o EXCEPT ALL SELECT l FROM n)
SELECT (SELECT count(*) FROM a) AS added, (SELECT coalesce(sum(strlen(l) + 1), 0)::BIGINT FROM a) AS added_bytes, (SELECT count(*) FROM r) AS removed, (SELECT coalesce(sum(strlen(l) + 1), 0)::BIGINT FROM r) AS removed_bytes""")
def diff_size(spark, d):
    return versions.diff_size(*_parts(spark, d), ["p_partkey", "p_name", "p_brand", "p_size"])


@query(f"""WITH {PARTS_SQL} SELECT 'expected' AS side, * FROM (SELECT * FROM v1 EXCEPT ALL SELECT * FROM v2) UNION ALL SELECT 'observed', * FROM (SELECT * FROM v2 EXCEPT ALL SELECT * FROM v1)""")
def set_diff(spark, d):
    v1, v2 = _parts(spark, d)
    side = lambda a, b, s: a.exceptAll(b).select(F.lit(s).alias("side"), "*")
    return side(v1, v2, "expected").union(side(v2, v1, "observed"))


@query(f"""WITH {PARTS_SQL} SELECT p_partkey, p_name, CASE WHEN p_partkey > 1000000 THEN 'minted' WHEN p_partkey % 6 <> 0 AND p_partkey % 4 = 0 THEN 'carried' ELSE 'key' END AS found_by,
CASE WHEN p_partkey > 1000000 THEN 'r_' || substr(sha1(concat_ws(chr(31), p_partkey::VARCHAR, p_name, p_brand, p_size::VARCHAR)), 1, 10) ELSE 'id' || p_partkey END AS row_id FROM v2""")
def id_carriage(spark, d):
    v1, v2 = _parts(spark, d)
    k = F.col("p_partkey")
    name = F.concat(F.lit("id"), k.cast("string"))
    new = v2.withColumn("row_id", F.when((k % 6 != 0) & (k % 4 == 0) & (k < 1_000_000), name))
    carried = versions.carry_ids(v1.withColumn("row_id", name).withColumn("pos", k), new.withColumn("pos", k), "row_id", ["p_partkey"], ["p_name", "p_brand", "p_size"], "pos")
    return carried.select("p_partkey", "p_name", "found_by", "row_id")


@query("""SELECT c_custkey, 'r_' || substr(sha1(concat_ws(chr(31), c_name, c_mktsegment)), 1, 10) AS row_id, sha256(concat_ws(chr(31), c_custkey::VARCHAR, c_name)) AS sig FROM customer""")
def mint_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", versions.minted_id(["c_name", "c_mktsegment"]).alias("row_id"), versions.signature(["c_custkey", "c_name"]).alias("sig"))


@query("""SELECT okey, count(*) AS n, sum(l_quantity) AS q FROM (SELECT *, l_orderkey::VARCHAR || '|' || l_linenumber || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS okey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS r FROM lineitem)) GROUP BY 1""")
def occurrence_key(spark, d):
    rows = versions.occurrence_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])
    return rows.groupBy("okey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


@query(f"""WITH {PARTS_SQL}, a AS (SELECT p_partkey AS old_id, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS n, p_name, p_brand, p_size FROM v1), b AS (SELECT p_partkey AS new_id, row_number() OVER (PARTITION BY p_name, p_brand, p_size ORDER BY p_partkey) AS n, p_name, p_brand, p_size FROM v2) SELECT old_id, new_id FROM a JOIN b USING (n, p_name, p_brand, p_size)""")
def witness_exact(spark, d):
    return versions.witness_exact(*_parts(spark, d), "p_partkey", ["p_name", "p_brand", "p_size"])


@query()
def witness_overlap(spark, d):
    return versions.witness_overlap(*_parts(spark, d), "p_partkey", ["p_name", "p_brand", "p_size"])


@query("""SELECT 's_nationkey' AS name, 's_suppkey2' AS source UNION ALL SELECT 's_suppkey2', 's_nationkey'""")
def literal_permutation(spark, d):
    old = table(spark, d, "supplier").withColumn("s_suppkey2", F.col("s_suppkey") * 3)
    new = old.withColumns({"s_nationkey": F.col("s_suppkey2"), "s_suppkey2": F.col("s_nationkey"), "s_acctbal": F.col("s_acctbal") + 1})
    return versions.moved_columns(old, new, ["s_name", "s_nationkey", "s_suppkey2", "s_acctbal"], "s_suppkey")


@query("""SELECT 'gross' AS reference, 'total' AS name""")
def drift_definitions(spark, d):
    old = TableDef({"total": "qty * unit", "net": "total * 0.8", "gross": "total + 1"})
    new = TableDef({"net": "qty * unit", "total": "net * 0.8", "gross": "total + 1"})
    return spark.createDataFrame(versions.definition_drift(old, new), "reference string, name string")


# ---- documents ------------------------------------------------------------------------------------------

LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents)"
KIND_SQL = r"CASE WHEN starts_with(raw, '```') OR starts_with(raw, '~~~') THEN 'code' WHEN starts_with(raw, '#') THEN 'heading' WHEN regexp_matches(raw, '^\s*([-*+]|\d+[.)])\s') THEN 'list' WHEN starts_with(raw, '|') THEN 'table' WHEN starts_with(raw, '<') THEN 'html' ELSE 'prose' END"


@query(f"WITH {LINES_SQL} SELECT {KIND_SQL} AS kind, count(*) AS n FROM l GROUP BY 1")
def block_types(spark, d):
    lines = documents.line_blocks(table(spark, d, "documents"))
    return lines.groupBy(documents.block_kind(F.col("raw")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINES_SQL}, k AS (SELECT *, {KIND_SQL} AS kind, count(*) OVER (PARTITION BY doc_id, raw) AS a, count(*) OVER (PARTITION BY raw) AS b FROM l WHERE length(raw) >= 20) SELECT kind, count(*)::BIGINT AS blocks, sum((a > 1)::INT)::BIGINT AS repeated_in_doc, sum((b > 1)::INT)::BIGINT AS repeated_in_corpus FROM k GROUP BY 1""")
def block_uniqueness(spark, d):
    return documents.uniqueness(documents.line_blocks(table(spark, d, "documents")), 20)


@query(f"""WITH {LINES_SQL}, k AS (SELECT doc_id, raw, count(*) AS k FROM l GROUP BY ALL) SELECT doc_id, sum(k)::BIGINT AS lines, sum((k = 1)::INT)::BIGINT AS unique_lines FROM k GROUP BY 1""")
def line_uniqueness(spark, d):
    return documents.unique_line_share(table(spark, d, "documents"))


@query("""SELECT item_id AS anchor_id, doc_id, (instr(d.text, b.text) - 1)::BIGINT AS pos FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0""")
def anchor_exact(spark, d):
    anchors = table(spark, d, "benchmark").select(F.col("item_id").alias("anchor_id"), F.col("text").alias("quote"))
    return documents.exact_anchors(anchors, table(spark, d, "documents"))


@query()
def anchor_resolved(spark, d):
    """Each text's middle as a quote, looked for in a version of the text whose words were edited."""
    docs = table(spark, d, "documents").where("length(text) >= 40")
    half = (F.length("text") / 2).cast("int")
    part = lambda a, n: F.substring("text", a, n)
    pairs = docs.select(F.col("doc_id").alias("anchor_id"), "doc_id", part(half, F.lit(36)).alias("quote"), part(F.greatest(half - 64, F.lit(1)), F.least(F.lit(64), half - 1)).alias("prefix"), part(half + 36, F.lit(64)).alias("suffix"), (half - 1).alias("pos"), F.regexp_replace("text", "the", "this").alias("text"))
    return documents.resolve_anchors(pairs)


@query()
def cdc_store(spark, d):
    return documents.store_size(documents.content_chunks(table(spark, d, "documents"), 256, 1024, 8192))


@query()
def block_split(spark, d):
    return documents.blocks(table(spark, d, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("raw")).alias("bytes"))


# ---- graphs ---------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def refs_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def _edges(spark: SparkSession, d: str, loops: bool = False) -> DataFrame:
    """Every supplier needs that of half its number; with loops every 9th also the one after it, which needs it."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    e = s.where("s_suppkey > 1").select(k.alias("src"), F.floor(k / 2).alias("dst"))
    return e.union(s.where("s_suppkey % 9 = 4").select(F.floor(k / 2), k)) if loops else e


EDGES_SQL = "e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1)"
LOOPS_SQL = "e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT s_suppkey // 2, s_suppkey FROM supplier WHERE s_suppkey % 9 = 4)"


@query(f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT * FROM r")
def closure_reach(spark, d):
    return graph.reach(_edges(spark, d))


@query(f"WITH RECURSIVE {LOOPS_SQL}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src), c AS (SELECT src AS node FROM r WHERE src = dst) SELECT node FROM c UNION SELECT src FROM r WHERE dst IN (SELECT node FROM c)")
def cycle_detect(spark, d):
    return graph.on_cycles(_edges(spark, d, True))


@query("""WITH RECURSIVE h AS (SELECT s_suppkey AS node, sha256(sha256(s_name)) AS hash FROM supplier WHERE s_suppkey <= 1 UNION ALL SELECT s_suppkey, sha256(sha256(s_name) || hash) FROM supplier JOIN h ON s_suppkey // 2 = h.node AND s_suppkey > 1) SELECT node, hash, NULL::VARCHAR AS err FROM h""")
def closure_hashes(spark, d):
    return graph.closure_hash(table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("content")), _edges(spark, d))


@query("""SELECT n AS name, depth, (100 + (row_number() OVER (PARTITION BY depth ORDER BY n) - 1) * 160)::INT AS x, (80 + depth * 120)::INT AS y FROM (SELECT s_suppkey AS n, CASE WHEN s_suppkey < 1 THEN 0 ELSE floor(log2(s_suppkey))::INT END AS depth FROM supplier)""")
def layering(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_suppkey").alias("place"))
    return graph.layers(nodes, _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("""SELECT n_nationkey::VARCHAR AS file, n_name || ' in ' || r_name || ', ' || '#REF!(region#x' || n_nationkey || ')' AS rendered FROM nation JOIN region ON n_regionkey = r_regionkey""")
def substituted(spark, d):
    n = table(spark, d, "nation")
    text = F.concat("n_name", F.lit(" in {{ region#"), "n_regionkey", F.lit(" }}, {{region#x"), "n_nationkey", F.lit("}}"))
    values = table(spark, d, "region").select(F.lit("region").alias("target"), F.col("r_regionkey").cast("string").alias("name"), F.col("r_name").alias("value"), F.lit(None).cast("string").alias("err"))
    return graph.substitute(n.select(F.col("n_nationkey").cast("string").alias("file"), text.alias("text")), values)


# ---- comparing and reporting ----------------------------------------------------------------------------


@query("""WITH c AS (SELECT l_extendedprice AS b, CASE l_linenumber WHEN 1 THEN l_extendedprice WHEN 2 THEN l_extendedprice * (1 + 2e-16) WHEN 3 THEN l_extendedprice * (1 + 1e-6) ELSE 0.0 END AS a FROM lineitem) SELECT a = b AS exact, abs(a - b) <= abs(b) * 1e-14 * 0.5000001 OR a = b AS digits15, count(*) AS n FROM c GROUP BY ALL""")
def compare_sigdigits(spark, d):
    b, n = F.col("l_extendedprice"), F.col("l_linenumber")
    a = F.when(n == 1, b).when(n == 2, b * F.lit(1 + 2e-16)).when(n == 3, b * F.lit(1 + 1e-6)).otherwise(0.0)
    return table(spark, d, "lineitem").select(a.alias("a"), b.alias("b")).groupBy((F.col("a") == F.col("b")).alias("exact"), compare.same_digits(F.col("a"), F.col("b"), 15).alias("digits15")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount = 0 THEN 'full-price' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS stage, count(*) AS n, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1""")
def ladder_counts(spark, d):
    stages = [("small", F.col("l_quantity") < 5), ("full-price", F.col("l_discount") == 0), ("returned", F.col("l_returnflag") == "R")]
    return compare.rollup(compare.ladder(table(spark, d, "lineitem"), stages), ["stage"], "l_quantity")


@query("""SELECT cls, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 1 THEN 'agrees:exact' WHEN 2 THEN 'differs:error-for-number' WHEN 3 THEN 'differs:refused' WHEN 4 THEN 'agrees:text' WHEN 5 THEN 'agrees:refused-for-error' WHEN 6 THEN 'differs:other' ELSE 'skipped:unparseable' END AS cls FROM lineitem) GROUP BY 1""")
def compare_ladder(spark, d):
    n, x = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    kind = F.when(n == 4, "text").when(n == 5, "error").otherwise("number")
    status = F.when(n.isin(3, 5), "refused").otherwise("ok")
    got = F.when(n == 6, (F.col("l_quantity") + 1).cast("string")).otherwise(x)
    cls = compare.compare_class(kind, F.when(n > 6, "n/a").otherwise(x), status, got, F.when(n == 2, "qty"))
    return table(spark, d, "lineitem").groupBy(cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT n_regionkey AS shard, CASE WHEN n_nationkey = 7 THEN 'b' ELSE 'a' END AS settings FROM nation WHERE n_regionkey <> 2) SELECT 'duplicate' AS fault, shard::BIGINT AS shard FROM s GROUP BY shard HAVING count(*) > 1 UNION ALL SELECT 'missing', 2 UNION ALL SELECT DISTINCT 'mixed-settings', shard FROM s WHERE settings <> (SELECT min(settings) FROM s)""")
def shard_guards(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 2")
    return compare.shard_faults(n.select(F.col("n_regionkey").cast("long").alias("shard"), F.when(F.col("n_nationkey") == 7, "b").otherwise("a").alias("settings")), 5)


@query("""WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) AS i, count(*) OVER () AS n FROM orders) SELECT (SELECT count(*) FROM orders) AS n, (SELECT median(o_totalprice) FROM orders) AS median, (SELECT min(o_totalprice) FROM r WHERE i = (n * 0.9)::DOUBLE // 1 + 1) AS p90, (SELECT round(sum(o_totalprice) / sum(o_custkey), 6) FROM orders) AS ratio""")
def pooled_report(spark, d):
    return rounded(compare.pooled(table(spark, d, "orders"), "o_totalprice", "o_custkey"), 6, "ratio")


@query("""WITH l AS (SELECT lang, avg(quality) AS share FROM labels JOIN documents USING (doc_id) GROUP BY 1), s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1) SELECT round(sum(share * size) / sum(size), 9) AS estimate FROM l JOIN s USING (lang)""")
def stratified_estimate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    return rounded(compare.stratified_estimate(table(spark, d, "labels").join(docs, "doc_id"), "lang", F.col("quality") == 1, sizes), 9, "estimate")


@query("""SELECT gap, count(*) FILTER (WHERE depth >= gap + 1) AS files FROM (SELECT c_custkey, count(*) AS depth FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), (SELECT unnest([1, 2, 5, 10]) AS gap) GROUP BY 1""")
def depth_by_gap(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")
    return compare.depth_by_gap(o, "c_custkey", [1, 2, 5, 10])


@query()
def formula_translate(spark, d):
    """One formula for each part, over a layout of four columns."""
    k, r = F.col("p_partkey"), (F.col("p_partkey") + 1).cast("string")
    f = F.when(k % 5 == 0, F.concat(F.lit("=B"), r, F.lit("*C"), r)).when(k % 5 == 1, F.lit("=SUM(D2:D999)")).when(k % 5 == 2, F.concat(F.lit("=IF(B"), r, F.lit(">10,C"), r, F.lit(",0)"))).when(k % 5 == 3, F.lit("=NOW()")).otherwise(F.concat(F.lit('=SUMIF(A2:A999,A'), r, F.lit(",D2:D999)")))
    out = table(spark, d, "part").select("p_partkey", translate.translated(f, (k + 1).cast("int"), {"A": "vendor", "B": "qty", "C": "unit", "D": "total"}, 2, 999).alias("t"))
    return out.select("p_partkey", "t.kind", "t.named", "t.reason")


# ---- reports and names ----------------------------------------------------------------------------------


@query("""SELECT count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_shipdate) AS l_shipdate, count(DISTINCT l_returnflag) AS l_returnflag FROM lineitem""")
def distinct_counts(spark, d):
    return compare.distinct_counts(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")


@query("""SELECT l_quantity, l_discount, l_returnflag, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2, 3""")
def distinct_facts(spark, d):
    return compare.distinct_facts(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"], "l_orderkey")


@query("""SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_size LIMIT 25""")
def top_combinations(spark, d):
    return compare.top(table(spark, d, "part"), ["p_brand", "p_size"], 25)


@query("""SELECT l_suppkey, count(*) AS versions, count(*) FILTER (WHERE l_returnflag = 'R') AS refused, count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS refusal_rate,
round(sum(l_linenumber) FILTER (WHERE l_returnflag <> 'R') / nullif(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0), 9) AS carriage FROM lineitem GROUP BY 1""")
def ledger_summary(spark, d):
    return rounded(compare.ledger_summary(table(spark, d, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R", "l_linenumber", "l_quantity"), 9, "carriage")


@query("""WITH b AS (SELECT p_partkey, p_brand, trim(regexp_replace(lower(split_part(p_name, ' ', 1) || ' !' || (p_size % 3)), '[^a-z0-9]+', '_', 'g'), '_') AS bare FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, bare ORDER BY p_partkey) AS n, list(bare) OVER (PARTITION BY p_brand) AS taken FROM b)
SELECT p_partkey, CASE WHEN n = 1 THEN bare WHEN list_contains(taken, bare || '_' || n) THEN bare || '__' || n ELSE bare || '_' || n END AS legal FROM n""")
def legal_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.substring_index("p_name", " ", 1), F.lit(" !"), (F.col("p_size") % 3).cast("string")).alias("name"))
    return versions.legal_names(p, ["p_brand"], "name", "p_partkey").select("p_partkey", "legal")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN '#REF!(nation[' || c_nationkey || '] x 2)' ELSE n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def lookup_repeated_key(spark, d):
    n = table(spark, d, "nation")
    twice = n.union(n.where("n_nationkey % 2 = 0"))
    t = TableDef({"nation": "lookup(nation, c_nationkey, n_name)"}, key="c_custkey")
    return shown(evaluate(table(spark, d, "customer"), t, {"nation": (twice, "n_nationkey")})).select("c_custkey", "nation")
