import pytest

from colonnade.plans.evaluate import evaluate, scalars, shown
from colonnade.plans.grammar import Refused, parse
from colonnade.plans.model import TableDef
from colonnade.sources import tabletext as tt

STOCK = """| tag | thing | count | each | worth = count * each |
| --- | --- | --: | --: | --: |
| k1 | lamp | 7 | 9.00 |  |
| k4 | rope | 3 | 4.50 |  |
| k9 | tarp | 2 | 31.25 |  |

key := tag
whole := sum(worth)
"""
LEDGER = """| id | date | amount | balance = cumulative(amount) | move = delta(amount) | was = prior(amount) |
| --- | --: | --: | --: | --: | --: |
| a | 3 | -50 |  |  |  |
| b | 1 | 100 |  |  |  |
| c | 2 | 70 |  |  |  |

key := id
order := by(date)
final := max(balance)
low := min(balance)
"""


def run(spark, text, **tables):
    columns, rows, table = tt.read_table(text)
    df = evaluate(tt.stored(spark, columns, rows, table), table, tables)
    return df, shown(scalars(df, table)).first() if table.aggregates else None


def test_stock(spark):
    assert run(spark, STOCK)[1]["whole"] == "139.0"
    assert run(spark, STOCK.replace("| each |", "| price |"))[1]["whole"] == "#REF!(each)"
    assert run(spark, STOCK.replace("sum(worth)", "sum(gone)"))[1]["whole"] == "#REF!(gone)"


def test_sums_of_aggregates(spark):
    more = STOCK + 'gap := max(worth) - min(worth)\nodd := -count(thing) + sum(worth where thing = "a - b") + sum(count where thing = "lamp")\nbad := sum(worth) - sum(gone)\n'
    agg = run(spark, more)[1]
    assert (agg["gap"], agg["odd"], agg["bad"]) == ("49.5", "4.0", "#REF!(gone)")
    for text in ("sum(worth) * 2", "sum(worth) - 3", "sum(worth) -", "sum(worth) min(worth)"):
        with pytest.raises(Refused):
            TableDef({}, {"x": text}).scalars()


def test_running_totals_follow_the_declared_order(spark):
    df, agg = run(spark, LEDGER)
    assert {r["id"]: (r["balance"], r["move"], r["was"]) for r in df.collect()} == {"b": (100, None, None), "c": (170, -30, 100), "a": (120, -120, 70)}
    assert (agg["final"], agg["low"]) == ("170.0", "100.0")


def test_bad_rows_are_skipped_by_running_totals(spark):
    df, agg = run(spark, LEDGER.replace("| 70 |", "| n/a |"))
    assert {r["id"]: r["balance"] for r in shown(df).collect()} == {"b": "100.0", "c": "#REF!(amount)", "a": "50.0"}
    assert {r["id"]: r["was"] for r in df.collect()}["a"] == 100 and agg["final"] == "#REF!(amount)"


def test_group_aggregates(spark):
    text = """| no | hall | guide | seats | in_hall = sum(seats where hall = @hall) | with_guide = sum(seats where hall = @hall and guide = @guide) |
| --- | --- | --- | --- | --- | --- |
| 7 | west | kim | 12 |  |  |
| 3 | east | kim | 35 |  |  |
| 5 | west | lou | 8 |  |  |
| 6 | west | kim | 21 |  |  |
| 2 | east | pat | 4 |  |  |

key := no
west := sum(seats where hall = "west")
"""
    df, agg = run(spark, text)
    assert {r["no"]: (r["in_hall"], r["with_guide"]) for r in df.collect()} == {"7": (41, 33), "3": (39, 35), "5": (41, 8), "6": (41, 33), "2": (39, 4)}
    assert agg["west"] == "41.0"


def test_lookup(spark):
    boats = spark.createDataFrame([("b7", "Petrel"), ("b2", "Heron"), ("b5", "Tern"), ("b5", "Gull")], "code string, boat string")
    text = """| trip | code | miles | name = lookup(boats, code, boat) | w2 = lookup(boats, code, crew) | w3 = lookup(none, code, boat) |
| --- | --- | --- | --- | --- | --- |
| 1 | b2 | 40 |  |  |  |
| 2 | b8 | 15 |  |  |  |
| 3 | b5 | 6 |  |  |  |

key := trip
far := sum(miles)
"""
    df, agg = run(spark, text, boats=(boats, "code"))
    assert {r["trip"]: (r["name"], r["w2"], r["w3"]) for r in shown(df).collect()} == {"1": ("Heron", "#REF!(boats#crew)", "#REF!(none)"), "2": ("#REF!(boats[b8])", "#REF!(boats#crew)", "#REF!(none)"), "3": ("#REF!(boats[b5] x 2)", "#REF!(boats#crew)", "#REF!(none)")}
    assert agg["far"] == "61.0"
    numbers = evaluate(spark.createDataFrame([(1.0,), (2.0,)], "k double"), TableDef({"v": "lookup(t, k, v)"}), {"t": (spark.createDataFrame([(1, "x")], "id int, v string"), "id")})
    assert {r["k"]: r["v"] for r in shown(numbers).collect()} == {1.0: "x", 2.0: "#REF!(t[2.0])"}


def test_errors_keep_their_origin(spark):
    d = spark.createDataFrame([("1", "4", "0"), ("2", None, "2"), ("3", "1e3", "2"), ("4", "6", "3")], "id string, a string, b string")
    t = TableDef({"z": "y + 1", "y": "x * 2", "x": "a / b", "p": "q + 1", "q": "p + 1", "r": "q * 2", "i": 'if(b = "0", 1, x)', "n": "-a - -2", "u": "ghost + a"}, key="id")
    got = {r["id"]: r for r in shown(evaluate(d, t)).collect()}
    assert [got[k]["z"] for k in "1234"] == ["#REF!(/0)", "#REF!(a)", "#REF!(a)", "5.0"]
    assert {got[k][c] for k in "1234" for c in "pqr"} == {"#REF!(cycle)"}
    assert got["1"]["i"] == "1.0" and got["4"]["i"] == "2.0" and got["4"]["n"] == "-4.0" and got["4"]["u"] == "#REF!(ghost)"


@pytest.mark.parametrize("text", ["a ^ 2", "a % b", "a // b", "a ** b", "a & b", "a = b", "cumulative(a) * 2", "now()", "round(a)", "a +", "if(a, 1, 2)", 'if(a < "x", 1, 2)', "(a", "1_000 + a", "5.", "sum(a) + 1"])
def test_refused_formulas(text):
    with pytest.raises(Refused):
        parse(text)


@pytest.mark.parametrize(
    ("change", "why"),
    [
        (lambda t: t + "<<<<<<< ours\n", "conflict"), (lambda t: t.replace("| thing |", "| tag |"), "duplicate column"), (lambda t: t + "key := thing\n", "duplicate declaration"), (lambda t: t.replace("| k1 |", "| k4 |"), "duplicate row key"),
        (lambda t: t.replace("| tarp |", "| tarp | x |"), "field count"), (lambda t: t.replace("worth)", "worth"), "malformed"), (lambda t: t.replace("sum(", "median("), "unknown aggregate"), (lambda t: "no table", "no table"),
        (lambda t: t.replace("31.25 |  |", "31.25 | 7 |"), "value in computed"), (lambda t: t.replace("count * each", "cumulative(count)"), "without an order"), (lambda t: t.replace("key := tag", "order := by(count)").replace("count * each", "prior(count)"), "needs a key"),
        (lambda t: t.replace("count * each", "prior(count)") + "order := by(worth)\n", "computed"), (lambda t: t.replace("| 7 |", "| 2026-1-2 |") + "order := by(count)\n", "mixed"), (lambda t: t + "order := by(zzz)\n", "unknown order"),
    ],
)
def test_refused_tables(change, why):
    with pytest.raises(Refused, match=why):
        tt.read_table(change(STOCK))


def test_text_round_trip_and_edit(spark, tmp_path):
    columns, rows, table = tt.read_table(STOCK)
    df = tt.stored(spark, columns, rows, table)
    text = "\n".join(r["line"] for r in tt.render(df, table, ("count", "each")).collect())
    assert tt.read_table(text)[:2] == (columns, rows)
    (tmp_path / "t.tbl").write_text(STOCK)
    assert tt.scan_rows(spark, str(tmp_path / "t.tbl"), columns).count() == 3
    assert tt.set_cell(df, table, "k1", "count", "8").where("tag = 'k1'").first()["count"] == "8"
    for bad in (("k4", "worth"), ("k4", "zzz")):
        with pytest.raises(Refused):
            tt.set_cell(df, table, bad[0], bad[1], "1")
