"""Keyed three-way merge. Conflicts are rows, never marks in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions.prefix import global_last_before
from colonnade.plans.grammar import Refused

CONFLICT = "kind string, key string, column string, base string, ours string, theirs string"


def merge_columns(base: list[str], ours: list[str], theirs: list[str]) -> list[str]:
    """Union in our order, without what one side deleted; adding on one side and removing on the other could be a rename and is refused."""
    added = [c for c in ours if c not in base], [c for c in theirs if c not in base]
    removed = [c for c in base if c not in ours], [c for c in base if c not in theirs]
    if (added[0] and removed[1]) or (added[1] and removed[0]):
        raise Refused(f"columns added {added} and removed {removed} on opposite sides: a rename can't be told apart")
    gone = {*removed[0], *removed[1]}
    return [c for c in dict.fromkeys([*ours, *theirs]) if c not in gone]


def lattice(b: Column, o: Column, t: Column) -> tuple[Column, Column]:
    """(merged cell, whether both sides changed it differently; ours is kept then)."""
    clash = ~o.eqNullSafe(t) & ~b.eqNullSafe(o) & ~b.eqNullSafe(t)
    return F.when(b.eqNullSafe(o), t).otherwise(o), clash


def aligned(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    columns = [c for c in merge_columns(base.columns, ours.columns, theirs.columns) if c != key]

    def side(df: DataFrame, tag: str) -> DataFrame:
        cells = [(F.col(c) if c in df.columns else F.lit(None)).alias(f"{tag}_{c}") for c in columns]
        return df.select(F.col(key), *cells, F.lit(True).alias(f"in_{tag}"))

    joined = side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    return joined.withColumns({f"in_{s}": F.coalesce(f"in_{s}", F.lit(False)) for s in "bot"}), columns


def _same(columns: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}_{c}").eqNullSafe(F.col(f"{b}_{c}"))
    return out


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged rows, rows of CONFLICT). A key that stands more than once on a side is a conflict ``repeated key`` (its rows of all sides meet in pairs); what was merged should not be used then."""
    rows, columns = aligned(base, ours, theirs, key)
    b, o, t = F.col("in_b"), F.col("in_o"), F.col("in_t")
    cells = {c: lattice(F.col(f"b_{c}"), F.col(f"o_{c}"), F.col(f"t_{c}")) for c in columns}
    drop = (b & ~t & o & _same(columns, "b", "o")) | (b & ~o)
    value = lambda c: F.when(b & o & t, cells[c][0]).when(o, F.col(f"o_{c}")).otherwise(F.col(f"t_{c}"))
    merged = rows.where(~drop).select(F.col(key), *(value(c).alias(c) for c in columns))

    def record(kind: str, when: Column, column: str | None) -> Column:
        of = lambda s: F.col(f"{s}_{column}").cast("string") if column else F.lit(None).cast("string")
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.lit(column).cast("string").alias("column"), of("b").alias("base"), of("o").alias("ours"), of("t").alias("theirs")))

    found = [record("edit/edit", b & o & t & cells[c][1], c) for c in columns]
    found += [record("modify/delete", b & o & ~t & ~_same(columns, "b", "o"), None), record("delete/modify", b & ~o & t & ~_same(columns, "b", "t"), None)]
    found += [record("add/add", ~b & o & t & ~F.col(f"o_{c}").eqNullSafe(F.col(f"t_{c}")), c) for c in columns]
    conflicts = rows.select(F.explode(F.array_compact(F.array(*found))).alias("c")).select("c.*")
    sides = (F.lit(1).alias("base"), F.lit(1).alias("ours"), F.lit(1).alias("theirs"))
    tagged = [df.select(F.col(key), *(c if i == at else F.lit(0).alias(n) for i, (c, n) in enumerate(zip(sides, ("base", "ours", "theirs"), strict=True)))) for at, df in enumerate((base, ours, theirs))]
    counts = tagged[0].unionAll(tagged[1]).unionAll(tagged[2]).groupBy(key).agg(*(F.sum(n).alias(n) for n in ("base", "ours", "theirs"))).where("greatest(base, ours, theirs) > 1")
    repeated = counts.select(F.lit("repeated key").alias("kind"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("column"), *(F.col(n).cast("string").alias(n) for n in ("base", "ours", "theirs")))
    return merged, conflicts.unionByName(repeated)


def merge_maps(base: dict, ours: dict, theirs: dict) -> tuple[dict, list[str]]:
    """The same lattice for declarations; (merged, names both sides changed)."""
    out, clashes = {}, []
    for name in dict.fromkeys([*ours, *theirs]):
        b, o, t = base.get(name), ours.get(name), theirs.get(name)
        if o != t and b != o and b != t:
            clashes.append(name)
        picked = t if b == o else o
        if picked is not None:
            out[name] = picked
    return out, clashes


def with_identity(df: DataFrame, scheme: str, key: list[str], position: str) -> DataFrame:
    """Adds row_id by one of four schemes: natural key, content hash, opaque id (the column given as key), position."""
    content = [c for c in df.columns if c != position]
    ids = {
        "natural": F.concat_ws("|", *(F.col(k).cast("string") for k in key)),
        "content": F.sha1(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content)).cast("binary")),
        "opaque": F.col(key[0]).cast("string"),
        "position": F.col(position).cast("string"),
    }
    if scheme not in ids:
        raise Refused(f"unknown identity scheme {scheme}")
    return df.withColumn("row_id", ids[scheme])


def merged_order(ours: DataFrame, theirs: DataFrame, key: str, position: str) -> DataFrame:
    """Positions for a text view: our rows keep theirs, a row only they have follows the nearest row before it that we have too."""
    mine = ours.select(key, F.col(position).cast("double").alias("mine"))
    placed = theirs.select(key, F.col(position).alias("pos")).join(mine, key, "left")
    parts = global_last_before(placed, [F.col("pos").asc(), F.col(key).asc()], "mine", "anchor")
    new = parts.where("mine is null").select(key, F.coalesce("anchor", F.lit(-1.0)).alias("mine"), F.col("pos").cast("double").alias("sub"))
    return mine.withColumn("sub", F.lit(-1.0)).unionByName(new).select(key, F.col("mine").alias("anchor"), "sub")
