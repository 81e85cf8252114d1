"""What happened between two versions of a table: identity, carried ids, drift, size of the change."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.plans.grammar import names, parse
from colonnade.plans.model import TableDef


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def signature(columns: list[str]) -> Column:
    """Content hash of a row's cells; a null cell is a blank one."""
    return F.sha2(F.concat_ws("\x1f", *map(_text, columns)).cast("binary"), 256)


def minted_id(columns: list[str], prefix: str = "r_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\x1f", *map(_text, columns)).cast("binary")), 1, 10))


def legal_names(df: DataFrame, scope: list[str], name: str, position: str, out: str = "legal") -> DataFrame:
    """Adds a legal identifier for each name of a scope: lower case, other characters as one underscore, a letter in front.

    Names of a scope that come out alike, by position the first keeps the bare form, the others get _2, _3 and so on; a suffixed
    form that is itself another's bare form gets a further underscore. An empty or null name is ``c``.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    bare = F.when(bare == "", "c").when(bare.rlike("^[0-9]"), F.concat(F.lit("c_"), bare)).otherwise(bare)
    n = F.row_number().over(Window.partitionBy(*scope, "__bare").orderBy(position))
    taken = F.collect_set("__bare").over(Window.partitionBy(*scope))  # the names of one table's header, few
    numbered = F.concat("__bare", F.lit("_"), F.col("__n").cast("string"))
    held = df.withColumn("__bare", bare).withColumn("__n", n).withColumn("__taken", taken)
    picked = F.when(F.col("__n") == 1, F.col("__bare")).when(F.array_contains("__taken", numbered), F.concat("__bare", F.lit("__"), F.col("__n").cast("string"))).otherwise(numbered)
    return held.withColumn(out, picked).drop("__bare", "__n", "__taken")


def occurrence_key(df: DataFrame, key: list[str], position: list[str], name: str = "okey") -> DataFrame:
    """k, then k#2, k#3 for repeats, in the order of position."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*position))
    plain = F.concat_ws("|", *map(_text, key))
    return df.withColumn(name, F.when(n == 1, plain).otherwise(F.concat(plain, F.lit("#"), n.cast("string"))))


def carry_ids(old: DataFrame, new: DataFrame, row_id: str, key: list[str], content: list[str], position: str) -> DataFrame:
    """new with row_id and how it was found: a carried id that was there before, the declared key, exact content, or minted.

    Each old row gives its id once: repeats of key or content pair off in their order. Minted ids are hashes of key and content; rows
    that repeat both get _2, _3 and so on, while rows that only share their content have different ids without that.
    """
    def ranked(df: DataFrame, by: list[Column], tag: str) -> DataFrame:
        return df.withColumn(tag, F.row_number().over(Window.partitionBy(*by).orderBy(position)))

    keyed = F.concat_ws("\x1f", *map(_text, key))
    sig = signature(content)
    was = ranked(ranked(old.select(F.col(row_id).alias("old_id"), keyed.alias("k"), sig.alias("s"), F.col(position)), [F.col("k")], "kn"), [F.col("s")], "sn")
    now = ranked(ranked(ranked(new.withColumns({"k": keyed, "s": sig}), [F.col("k")], "kn"), [F.col("s")], "sn"), [F.col("k"), F.col("s")], "ksn")
    by_id = was.select(F.col("old_id").alias("id1"))
    step = now.join(by_id, F.col(row_id) == F.col("id1"), "left")
    taken = step.where("id1 is not null").select(F.col("id1").alias("used"))
    free = was.join(taken, F.col("old_id") == F.col("used"), "left_anti")
    step = step.join(free.select(F.col("old_id").alias("id2"), F.col("k").alias("k2"), F.col("kn").alias("kn2")), (F.col("id1").isNull()) & (F.col("k") == F.col("k2")) & (F.col("kn") == F.col("kn2")), "left")
    used = step.where("id2 is not null").select(F.col("id2").alias("used"))
    rest = free.join(used, F.col("old_id") == F.col("used"), "left_anti")
    step = step.join(rest.select(F.col("old_id").alias("id3"), F.col("s").alias("s3"), F.col("sn").alias("sn3")), (F.coalesce("id1", "id2").isNull()) & (F.col("s") == F.col("s3")) & (F.col("sn") == F.col("sn3")), "left")
    mint = F.concat(minted_id([*key, *content]), F.when(F.col("ksn") > 1, F.concat(F.lit("_"), F.col("ksn").cast("string"))).otherwise(F.lit("")))
    how = F.when(F.col("id1").isNotNull(), "carried").when(F.col("id2").isNotNull(), "key").when(F.col("id3").isNotNull(), "content").otherwise("minted")
    return step.select(*(c for c in new.columns if c != row_id), F.coalesce("id1", "id2", "id3", mint).alias(row_id), how.alias("found_by"))


def stable_order(old: DataFrame, new: DataFrame, row_id: str, position: str, name: str = "place") -> DataFrame:
    """Sort columns for a re-import: rows that were there keep their order, new ones follow by id."""
    was = old.select(F.col(row_id), F.col(position).alias("__was"))
    return new.join(was, row_id, "left").withColumn(name, F.struct(F.col("__was").isNull().alias("new"), F.coalesce(F.col("__was").cast("long"), F.lit(0)).alias("was"), F.col(row_id).cast("string").alias("id"))).drop("__was")


def witness_exact(old: DataFrame, new: DataFrame, row_id: str, content: list[str]) -> DataFrame:
    """(old_id, new_id) of rows with equal content, repeats paired off by id: a multiset match."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        d = df.select(F.col(row_id).alias(tag), signature(content).alias("s"))
        return d.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(tag)))

    return side(old, "old_id").join(side(new, "new_id"), ["s", "n"]).select("old_id", "new_id")


def witness_overlap(old: DataFrame, new: DataFrame, row_id: str, content: list[str], common: int = 400, least: float = 0.5) -> DataFrame:
    """(old_id, new_id, overlap) by shared cell values; values of ``common`` or more rows tell nothing and are left out of the candidate search.

    One-to-one by mutual best match: both rows hold each other best (ties: smaller id).
    """
    def values(df: DataFrame, tag: str) -> DataFrame:
        cells = F.array_distinct(F.filter(F.array(*map(_text, content)), lambda x: F.trim(x) != ""))
        return df.select(F.col(row_id).alias(tag), cells.alias(f"{tag}_cells"))

    a, b = values(old, "old_id"), values(new, "new_id")
    ea, eb = a.select("old_id", F.explode("old_id_cells").alias("v")), b.select("new_id", F.explode("new_id_cells").alias("v"))
    rare = lambda e: e.groupBy("v").count().where(F.col("count") < common).select("v")
    pairs = ea.join(rare(ea), "v").join(eb.join(rare(eb), "v"), "v").select("old_id", "new_id").distinct()
    scored = pairs.join(a, "old_id").join(b, "new_id").select("old_id", "new_id", jaccard(F.col("old_id_cells"), F.col("new_id_cells")).alias("overlap")).where(F.col("overlap") >= least)
    best_old = F.row_number().over(Window.partitionBy("old_id").orderBy(F.desc("overlap"), "new_id"))
    best_new = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("overlap"), "old_id"))
    return scored.withColumns({"o": best_old, "n": best_new}).where("o = 1 and n = 1").select("old_id", "new_id", "overlap")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def diff_size(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """added, removed: rows; added_bytes, removed_bytes: of their lines with line ends."""
    line = F.concat_ws(" | ", *map(_text, columns))
    o, n = old.select(line.alias("l")), new.select(line.alias("l"))
    count = lambda a, b, t: a.exceptAll(b).agg(F.count("l").alias(t), F.coalesce(F.sum(F.octet_length("l") + 1), F.lit(0)).alias(f"{t}_bytes"))
    return count(n, o, "added").join(F.broadcast(count(o, n, "removed")))


def column_fingerprints(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row (name, fp) per column: an order-free fingerprint of its (key, value) pairs."""
    sums = df.agg(*(F.sum(F.xxhash64(F.col(key).cast("string"), _text(c)).cast("decimal(38,0)")).alias(c) for c in columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("fp")) for c in columns))).alias("x")).select("x.*")


def moved_columns(old: DataFrame, new: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(name, source): stored columns that now hold the data another column held; an edit of the data moves nothing."""
    o, n = column_fingerprints(old, columns, key), column_fingerprints(new, columns, key)
    changed = n.join(o.withColumnRenamed("fp", "was"), "name").where("fp <> was").select("name", "fp")
    return changed.join(o.select(F.col("name").alias("source"), "fp"), "fp").select("name", "source")


def _renamed(formula: str, rename: dict[str, str]) -> str:
    return re.sub(r"(?<![\"\w])[^\W\d]\w*", lambda m: rename.get(m[0], m[0]), formula)


def definition_drift(old: TableDef, new: TableDef) -> list[tuple[str, str]]:
    """(reference, name): texts that did not change, but a name in them took over another column's definition."""
    rename: dict[str, str] = {}
    grown = True
    while grown:
        grown = False
        for a, f in old.formulas.items():
            match = next((b for b, g in new.formulas.items() if a != b and b not in rename.values() and _renamed(f, rename) == g), None) if a not in rename else None
            if match:
                rename[a], grown = match, True
    taken = {b for a, b in rename.items() if b in old.formulas and _renamed(old.formulas[b], rename) != new.formulas[b]}
    texts = [(n, f, new.formulas.get(n)) for n, f in old.formulas.items()] + [(n, f, new.aggregates.get(n)) for n, f in old.aggregates.items()]
    read = lambda n, f: names(parse(f)) if n in old.formulas else {c for _, a in old.scalars()[n] for c in (a.column, *(p for p, _ in a.literal))}
    return sorted((n, x) for n, f, g in texts if f == g for x in read(n, f) & taken)


def reorder_distance(df: DataFrame, group: list[str], old_position: str, new_position: str) -> DataFrame:
    """Per group: rows in both versions less the longest run of them that kept its order."""
    kept = [f.name for f in df.select(*group).schema]

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        tails: list = []
        for x in pdf.sort_values(new_position)[old_position]:
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        return pd.DataFrame([[*(pdf[g].iloc[0] for g in kept), len(pdf) - len(tails)]], columns=[*kept, "distance"])

    return df.groupBy(*group).applyInPandas(distance, df.select(*group).schema.add("distance", "long"))
