"""Artifact graphs: reachability, cycles, closure hashes, layers. Loops run on the executors, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions.shared import cut


def reach(edges: DataFrame) -> DataFrame:
    """(src, dst) of all pairs joined by a way; semi-naive: each round extends only what the last one found."""
    e = cut(edges.select("src", "dst").distinct())
    every, new = e, e
    while True:
        step = new.toDF("src", "mid").join(e.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
        new = cut(step.join(every.toDF("s", "d"), (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left_anti"))
        if new.isEmpty():
            return every
        every = cut(every.toDF("src", "dst").union(new.toDF("src", "dst")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach a cycle or lie on one (column node): what is left when nodes without open dependencies go, round by round."""
    left = cut(edges.select("src", "dst").distinct())
    n = left.count()
    while True:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        now = left.count()
        if now == n:
            return left.select(F.col("src").alias("node")).distinct()
        n = now


def closure_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node, content); edges (src needs dst). (node, hash, err): SHA-256 of the content and the sorted hashes of what it needs; ``cycle`` for nodes that reach one."""
    e = cut(edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    own = nodes.select("node", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("c"))
    need = e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("src", "node")
    open_nodes = own.join(need, "node", "left").select("node", "c", F.coalesce("n", F.lit(0)).alias("n"))
    done = cut(open_nodes.where("n = 0").select("node", F.sha2(F.col("c").cast("binary"), 256).alias("hash")))
    waiting = cut(open_nodes.where("n > 0"))
    while True:
        have = e.join(done, e["dst"] == done["node"]).groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_list("hash")), "").alias("deps"))
        ready = cut(waiting.join(have, (waiting["node"] == have["src"]) & (waiting["n"] == have["k"])).select("node", F.sha2(F.concat("c", "deps").cast("binary"), 256).alias("hash")))
        if ready.isEmpty():
            break
        done = cut(done.union(ready))
        waiting = cut(waiting.join(ready, "node", "left_anti"))
    return done.select("node", "hash", F.lit(None).cast("string").alias("err")).union(waiting.select("node", F.lit(None).cast("string"), F.lit("cycle")))


def layers(nodes: DataFrame, edges: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """nodes (name, place), edges (src, dst) without cycles. (name, depth, x, y): depth is the longest way from a source; nodes of a depth stand side by side by place; overrides (name, x, y) win."""
    e = cut(edges.select("src", "dst").distinct().where("src <> dst"))
    depth = cut(nodes.select("name", F.lit(0).alias("depth")))
    for _ in range(nodes.count()):
        pushed = e.join(depth, e["src"] == depth["name"]).groupBy(F.col("dst").alias("name")).agg((F.max("depth") + 1).alias("d"))
        new = cut(depth.join(pushed, "name", "left").select("name", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth")))
        if new.exceptAll(depth).isEmpty():
            break
        depth = new
    i = F.row_number().over(Window.partitionBy("depth").orderBy("place", "name")) - 1
    out = nodes.join(depth, "name").withColumns({"x": (100 + i * 160).cast("int"), "y": (80 + F.col("depth") * 120).cast("int")}).select("name", "depth", "x", "y")
    if overrides is None:
        return out
    o = overrides.select("name", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return out.join(o, "name", "left").select("name", "depth", F.coalesce("ox", "x").alias("x"), F.coalesce("oy", "y").alias("y"))


def substitute(templates: DataFrame, values: DataFrame) -> DataFrame:
    """templates (file, text) with {{ file#name }} replaced by values (target, name, value, err); errors and unknown names are spelled out. (file, rendered)."""
    pattern = r"\{\{\s*([^\s#}]+)#([\w-]+)\s*\}\}"
    parts = templates.select("file", F.posexplode(F.split(F.regexp_replace("text", pattern, "\x00\x01$1#$2\x00"), "\x00", -1)).alias("n", "part"))
    ref = F.when(F.col("part").startswith("\x01"), F.substring("part", 2, 1 << 30))
    named = values.select(F.concat_ws("#", "target", "name").alias("ref"), F.coalesce(F.concat(F.lit("#REF!("), "err", F.lit(")")), F.col("value").cast("string")).alias("v"), F.lit(True).alias("known"))
    joined = parts.withColumn("ref", ref).join(named, "ref", "left")
    shown = F.when(F.col("ref").isNull(), F.col("part")).when(F.col("known"), F.col("v")).otherwise(F.concat(F.lit("#REF!("), "ref", F.lit(")")))
    return joined.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("s")))), lambda x: x["s"]), "").alias("rendered"))
