"""Formulas to one lazy DataFrame, and declared aggregates to one row.

Computed columns are scheduled by what they read, not by where they stand. All plain formulas that are ready
go into one projection; group aggregates, lookups and row-relative columns follow when what they read is
there. A column c is a double (text for a lookup) beside ``c__err``, the name of what broke it, null when
nothing did. Members of a cycle and all that reads them get the error ``cycle``.

Group aggregates are a partial aggregate joined back on the group's columns: a group with a third of all rows
is summed map-side, and the join can be split. Row-relative columns over a whole table use range partitions
with offsets; no plan has a window over one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions.prefix import _ranged
from colonnade.functions.values import Pair, arithmetic, date_key, error_text, none, number, order_kind
from colonnade.plans.grammar import Agg, If, Lookup, Name, Num, Op, Refused, RowRel, Text, names
from colonnade.plans.model import TableDef


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def _pair(df: DataFrame, name: str) -> Pair:
    """A column as a number: blank and text cells are broken references to it, never 0."""
    if name not in df.columns:
        return Pair(F.lit(None).cast("double"), F.lit(name))
    value = number(F.col(name)) if _is_text(df, name) else F.col(name).cast("double")
    own = F.when(value.isNull(), name)
    return Pair(value, F.coalesce(f"{name}__err", own) if f"{name}__err" in df.columns else own)


def _cell(df: DataFrame, name: str) -> Pair:
    """A column as trimmed text; blank is broken."""
    if name not in df.columns:
        return Pair(none(), F.lit(name))
    text = F.trim(F.col(name).cast("string"))
    own = F.when(F.coalesce(text, F.lit("")) == "", name)
    return Pair(text, F.coalesce(f"{name}__err", own) if f"{name}__err" in df.columns else own)


def lower(tree, df: DataFrame) -> Pair:
    """The tree of a plain formula over df's columns."""
    if isinstance(tree, Num):
        return Pair(F.lit(float(tree.text)), none())
    if isinstance(tree, Name):
        return _pair(df, tree.name)
    if isinstance(tree, Op):
        parts = [lower(a, df) for a in tree.args]
        return Pair.of(-parts[0].value, none(), parts[0]) if tree.sign == "neg" else arithmetic(tree.sign, *parts)
    if isinstance(tree, If):
        left, right = (_cell(df, tree.left.name), Pair(F.lit(tree.right.text), none())) if isinstance(tree.right, Text) else (lower(tree.left, df), lower(tree.right, df))
        a, b = left.value, right.value
        test = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree.sign]
        then, other = lower(tree.then, df), lower(tree.other, df)
        chosen = F.when(test, then.err).otherwise(other.err)  # the other branch isn't read
        return Pair.of(F.when(test, then.value).otherwise(other.value), chosen, left, right)
    raise Refused(f"not a plain formula: {tree}")


def order_fields(df: DataFrame, order: str, key: str | None) -> list[Column]:
    """Sort columns of the declared order: numbers, dates or text, then the key. Text columns are of one kind (see validate)."""
    if key is None:
        raise Refused("an order needs a key to break ties")
    if order not in df.columns:
        raise Refused(f"unknown order column {order}")
    c = F.col(order)
    typed = [number(c), date_key(c), c] if _is_text(df, order) else [c]
    return [*typed, F.col(key)]


def typed_order(df: DataFrame, order: str, key: str | None) -> list[Column]:
    return [c.asc_nulls_first() for c in order_fields(df, order, key)]


def _poisoned(fn: str, pair: Pair, blank: Column, rank: Column, where: Column, stored: bool) -> list[Column]:
    """The value of one function and the first error in order. Blank cells are skipped; count counts rows, so stored text does not break it."""
    if fn == "count" and stored:
        return [F.count(F.when(where, 1)).cast("double"), F.max(none())]
    use = where & ~blank
    v = F.when(use, pair.value)
    first = F.min_by(F.when(use, pair.err), F.when(use & pair.err.isNotNull(), rank))
    parts = {"sum": F.coalesce(F.sum(v), F.lit(0.0)), "count": F.count(F.when(where, 1)).cast("double"), "min": F.min(v), "max": F.max(v), "avg": F.try_divide(F.sum(v), F.count(v))}
    return [parts[fn], first]


def _blank(df: DataFrame, name: str) -> Column:
    """Stored cells without content. A computed column has none: its blanks are errors."""
    if f"{name}__err" in df.columns or name not in df.columns:
        return F.lit(False)
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""


def _rank(df: DataFrame, table: TableDef) -> Column:
    if table.key and table.order:
        return F.struct(*(F.coalesce(number(F.col(table.order)), F.lit(0.0)).alias("a"), F.col(table.order).cast("string").alias("b"), F.col(table.key).cast("string").alias("c")))
    return F.struct(F.col(table.key).cast("string").alias("c")) if table.key else F.struct(F.lit(0).alias("c"))


def _matches(literal: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(True)
    for p, text in literal:
        out = out & F.coalesce(F.col(p).cast("string") == text, F.lit(False))
    return out


def _finish(value: Column, err: Column, fn: str) -> tuple[Column, Column]:
    err = F.coalesce(err, F.when(value.isNull(), "empty"))
    return F.when(err.isNull(), value), err


def group_aggregate(df: DataFrame, name: str, tree: Agg, table: TableDef) -> DataFrame:
    unknown = next((c for c in [tree.column, *(p for p, _ in tree.literal), *(c for s in tree.same for c in s)] if c not in df.columns), None)
    if unknown:
        return df.withColumns({name: F.lit(None).cast("double"), f"{name}__err": F.lit(unknown)})
    value, err = _poisoned(tree.fn, _pair(df, tree.column), _blank(df, tree.column), _rank(df, table), F.lit(True), False)
    keys = [F.col(p).cast("string").alias(f"__p{i}") for i, (p, _) in enumerate(tree.same)]
    groups = df.where(_matches(tree.literal)).groupBy(*keys).agg(value.alias("__v"), err.alias("__e"))
    on = F.lit(True)
    for i, (_, q) in enumerate(tree.same):
        on = on & df[q].cast("string").eqNullSafe(groups[f"__p{i}"])
    joined = df.join(groups, on, "left") if keys else df.join(F.broadcast(groups))
    zero = F.lit(0.0) if tree.fn in ("sum", "count") else F.lit(None).cast("double")
    v, e = _finish(F.coalesce("__v", zero), F.col("__e"), tree.fn)
    return joined.withColumns({name: v, f"{name}__err": e}).drop("__v", "__e", *(f"__p{i}" for i in range(len(keys))))


def look_up(df: DataFrame, name: str, tree: Lookup, tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """tables: name -> (rows, declared key). A key that the target repeats is a broken reference; numeric keys meet as numbers."""

    def broken(what: str) -> DataFrame:
        return df.withColumns({name: none(), f"{name}__err": F.lit(what)})

    if tree.table not in tables:
        return broken(tree.table)
    target, key = tables[tree.table]
    if key is None or tree.value not in target.columns:
        return broken(f"{tree.table}#{tree.value if key is not None else 'key'}")
    if tree.key not in df.columns:
        return broken(tree.key)
    numeric = all(isinstance(d.schema[c].dataType, T.NumericType) for d, c in ((df, tree.key), (target, key)))
    as_key = lambda c: F.col(c).cast("double" if numeric else "string")
    has_err = f"{tree.value}__err" in target.columns
    cells = F.struct(F.col(tree.value).cast("string").alias("v"), (F.col(f"{tree.value}__err") if has_err else none()).alias("e"))
    # one row for each key: the join needs the target dealt by it anyway
    right = target.where(F.col(key).isNotNull()).groupBy(as_key(key).alias("__k")).agg(F.first(cells).alias("__c"), F.count(F.lit(1)).alias("__n"))
    own = _cell(df, tree.key)
    joined = df.withColumn("__q", as_key(tree.key)).join(right, F.col("__q") == F.col("__k"), "left")
    shown_key = F.col(tree.key).cast("string")
    miss = F.when(F.col("__k").isNull(), F.format_string(f"{tree.table}[%s]", shown_key)).when(F.col("__n") > 1, F.format_string(f"{tree.table}[%s] x %d", shown_key, F.col("__n")))
    err = F.coalesce(own.err, miss, F.col("__c.e"))
    return joined.withColumns({name: F.when(err.isNull(), F.col("__c.v")), f"{name}__err": err}).drop("__q", "__k", "__c", "__n")


def row_relative(df: DataFrame, columns: dict[str, RowRel], table: TableDef) -> DataFrame:
    """cumulative: running sum that skips bad rows; prior: the last good value before; delta: the difference to it."""
    if table.order is None:
        raise Refused("row-relative columns need a declared order")
    if table.order in table.formulas:
        raise Refused("the order column can't be computed")
    order = typed_order(df, table.order, table.key)
    pairs = {n: _pair(df, t.column) for n, t in columns.items()}
    df = df.withColumns({f"__v_{n}": p.value for n, p in pairs.items()} | {f"{n}__err": p.err for n, p in pairs.items()})
    if table.partition:
        part, base = [F.col(p) for p in table.partition], df
    else:
        base = _ranged(df, order, None)
        part = [F.col("__part")]
    w = Window.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumns({f"__s_{n}": F.coalesce(F.sum(f"__v_{n}").over(upto), F.lit(0.0)) for n in columns} | {f"__b_{n}": F.last(f"__v_{n}", ignorenulls=True).over(before) for n in columns})
    if not table.partition:
        last = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order_fields(df, table.order, table.key))))
        sums = base.groupBy("__part").agg(*(F.sum(f"__v_{n}").alias(f"s_{n}") for n in columns), *(F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), last)).alias(f"l_{n}") for n in columns))
        earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = F.broadcast(sums.select("__part", *(F.coalesce(F.sum(f"s_{n}").over(earlier), F.lit(0.0)).alias(f"so_{n}") for n in columns), *(F.last(f"l_{n}", ignorenulls=True).over(earlier).alias(f"lo_{n}") for n in columns)))
        out = out.join(offsets, "__part").withColumns({f"__s_{n}": F.col(f"__s_{n}") + F.col(f"so_{n}") for n in columns} | {f"__b_{n}": F.coalesce(f"__b_{n}", f"lo_{n}") for n in columns})
    ok = {n: F.col(f"{n}__err").isNull() for n in columns}
    value = {"cumulative": lambda n: F.col(f"__s_{n}"), "prior": lambda n: F.col(f"__b_{n}"), "delta": lambda n: F.col(f"__v_{n}") - F.col(f"__b_{n}")}
    out = out.withColumns({n: F.when(ok[n], value[t.fn](n)) for n, t in columns.items()})
    kept = [c for c in df.columns if not c.startswith("__v_")]
    return out.select(*kept, *(n for n in columns if n not in kept))


def evaluate(df: DataFrame, table: TableDef, tables: dict[str, tuple[DataFrame, str | None]] | None = None) -> DataFrame:
    """df with all computed columns of the definition, each with its ``__err``."""
    trees = table.trees()
    for name, tree in trees.items():
        if isinstance(tree, RowRel) and table.order is None:
            raise Refused(f"{name}: row-relative columns need a declared order")
    df = df.drop(*trees)
    waiting = dict(trees)
    while waiting:
        ready = {n: t for n, t in waiting.items() if not (names(t) & waiting.keys())}
        if not ready:
            df = df.withColumns({c: e for n in waiting for c, e in ((n, F.lit(None).cast("double")), (f"{n}__err", F.lit("cycle")))})
            break
        plain = {n: lower(t, df) for n, t in ready.items() if isinstance(t, (Num, Name, Op, If))}
        if plain:
            df = df.withColumns({c: e for n, p in plain.items() for c, e in ((n, F.when(p.err.isNull(), p.value)), (f"{n}__err", p.err))})
        for n, t in ready.items():
            if isinstance(t, Agg):
                df = group_aggregate(df, n, t, table)
            elif isinstance(t, Lookup):
                df = look_up(df, n, t, tables or {})
        relative = {n: t for n, t in ready.items() if isinstance(t, RowRel)}
        if relative:
            df = row_relative(df, relative, table)
        for n in ready:
            del waiting[n]
    return df


def scalars(df: DataFrame, table: TableDef) -> DataFrame:
    """One row: each declared value (a sum of aggregates with signs) and its ``__err``; an aggregate over any error is that error, a sum the first of its terms'."""
    columns = []
    for name, terms in table.scalars().items():
        parts = []
        for sign, tree in terms:
            if tree.same:
                raise Refused(f"{name}: @ has no row here")
            missing = next((c for c in (tree.column, *(p for p, _ in tree.literal)) if c not in df.columns), None)
            if missing:
                parts.append((F.lit(None).cast("double"), F.lit(missing)))
                continue
            value, err = _poisoned(tree.fn, _pair(df, tree.column), _blank(df, tree.column), _rank(df, table), _matches(tree.literal), f"{tree.column}__err" not in df.columns)
            v, e = _finish(value, err, tree.fn)
            parts.append((-v if sign < 0 else v, e))
        total = parts[0][0]
        for v, _ in parts[1:]:
            total = total + v
        err = F.coalesce(*(e for _, e in parts)) if len(parts) > 1 else parts[0][1]
        columns += [total.alias(name), err.alias(f"{name}__err")]
    return df.agg(*columns)


def shown(df: DataFrame) -> DataFrame:
    """The text view: a computed cell is its value or its error value."""
    pairs = [c for c in df.columns if f"{c}__err" in df.columns]
    return df.select(*(F.coalesce(F.when(F.col(f"{c}__err").isNotNull(), error_text(F.col(f"{c}__err"))), F.col(c).cast("string")).alias(c) if c in pairs else F.col(c) for c in df.columns if not (c.endswith("__err") and c[:-5] in pairs)))


__all__ = ["evaluate", "scalars", "shown", "lower", "row_relative", "group_aggregate", "look_up", "typed_order", "order_kind"]
