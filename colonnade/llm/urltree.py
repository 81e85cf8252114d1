"""URL filters from a path-template tree, with DataFrame functions only.

Every host has a tree of path segments. Level by level, a node whose children are mostly different
(distinct children of its pages above ``variable``) gets the wildcard ``*`` in place of all of them.
Of the literal branches that are left, each whose labelled share of bad pages does not differ from its
node's by more than ``z`` standard errors is merged into ``*`` too: only branches that behave differently
stay apart. The template of a page is its path after that. Its purity is the smoothed share of bad among its
labelled pages, (bad + strength * prior) / (labelled + strength), prior being the share over all labelled
pages (0 without any); templates of purity ``reject`` or more are blocked. Rules given by hand come before the method.

Segments after ``depth`` count as one. A level is one partial aggregate on (host, template, segment) and one
join back on that key, so a host with a third of all pages is counted map-side and spread by its segments;
branches meet their node in slices where it has very many (:mod:`slices`). Branches, nodes and the rows
(without html) are checkpointed at each level.

Defined cases: a null url or one without ``://`` has empty host and path (one template of its own); a null
label is unlabelled; repeated rows count as often as they occur; an empty table gives an empty result; other
columns pass through, those named like a result column are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.shared import cut
from colonnade.llm.slices import sliced_join

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
ADDED = ("host", "path", "rule", "template", "purity", "verdict")
#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # a longer one stands before
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _segments(path: Column, depth: int) -> Column:
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", depth)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, depth: int = 4, variable: float = 0.3, z: float = 1.96, strength: float = 10.0, reject: float = 0.5) -> DataFrame:
    """pages (url, and bad: 1, 0 or null where unlabelled) with host, path, rule, template, purity and verdict."""
    own = [c for c in pages.columns if c not in (*ADDED, "bad")]
    rows = pages.select(*own, F.col("bad").cast("long").alias("__bad"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = cut(rows.withColumn("__s", _segments(F.col("path"), depth)).withColumn("template", F.lit("")))
    count = (F.sum("n"), F.sum("l"), F.sum("b"))
    for level in range(depth):
        seg = F.get("__s", F.lit(level))
        at = rows.withColumn("__seg", seg)
        branch = cut(at.where("__seg is not null").groupBy("host", "template", "__seg").agg(F.count(F.lit(1)).alias("n"), F.count("__bad").alias("l"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("b")))
        node = cut(branch.groupBy("host", "template").agg(*(c.alias(a) for c, a in zip(count, ("nn", "nl", "nb"), strict=True)), F.count(F.lit(1)).alias("k")))
        p = (F.col("nb") + 1.0) / (F.col("nl") + 2.0)
        apart = F.abs((F.col("b") - F.col("l") * p)) > F.lit(z) * F.sqrt(F.col("l") * p * (F.lit(1.0) - p))
        named = sliced_join(branch, node, ["host", "template"], "k", ["__seg"]).where((F.col("k") <= F.lit(variable) * F.col("nn")) & (F.col("l") > 0) & apart).select("host", "template", "__seg", F.lit(True).alias("__lit"))
        # a level reads its rows three times: without a cut the plan would grow threefold with each
        rows = cut(at.join(named, ["host", "template", "__seg"], "left").withColumn("template", F.when(F.col("__seg").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("__lit"), F.col("__seg")).otherwise(F.lit("*"))))).drop("__lit", "__seg"))
    groups = rows.groupBy("host", "template").agg(F.count("__bad").alias("l"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("b"))
    prior = rows.agg(F.coalesce(F.try_divide(F.sum("__bad").cast("double"), F.count("__bad")), F.lit(0.0)).alias("prior"))
    # a table of its own size, known before the join: small ones go to the pages, large ones are dealt and can be split
    pure = cut(groups.join(F.broadcast(prior)).select("host", "template", ((F.col("b") + F.lit(strength) * F.col("prior")) / (F.col("l") + F.lit(strength))).alias("purity")))
    rule = ruled(rules, F.col("host"), F.col("path"))
    out = rows.join(pure, ["host", "template"]).withColumn("__r", rule)
    method = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select(*own, "host", "path", F.col("__r.rule").alias("rule"), "template", "purity", F.coalesce("__r.verdict", method).alias("verdict"))


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with bad: a page shows the document whose number ends its path, bad if that is of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id is not null").groupBy("doc_id").agg(F.greatest(F.lit(1) - F.min("quality"), F.max("toxic")).alias("bad"))
    shown = F.expr("try_cast(nullif(regexp_extract(regexp_extract(url, '(?s)://([^?#]*)', 1), '([0-9]+)[^/0-9]*/?$', 1), '') as bigint)")
    return pages.withColumn("__doc", shown).join(labels, F.col("__doc") == labels["doc_id"], "left").select("page_id", "url", "bad")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(labelled_pages(spark, sf_dir)).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def _sql(depth: int = 4) -> str:
    rest = f"list_concat(list_slice(s0, 1, {depth - 1}), CASE WHEN len(s0) >= {depth} THEN [array_to_string(list_slice(s0, {depth}, len(s0)), '/')] ELSE [] END)"
    steps = []
    for k in range(depth):
        steps.append(f"""
b{k} AS (SELECT host, template, s[{k + 1}] AS seg, count(*) AS n, count(bad) AS l, coalesce(sum(bad), 0) AS b FROM t{k} WHERE len(s) > {k} GROUP BY ALL),
n{k} AS (SELECT host, template, sum(n) AS nn, (sum(b) + 1.0::DOUBLE) / (sum(l) + 2.0::DOUBLE) AS p, count(*) AS k FROM b{k} GROUP BY ALL),
m{k} AS (SELECT host, template, seg FROM b{k} JOIN n{k} USING (host, template) WHERE k <= 0.3::DOUBLE * nn AND l > 0 AND abs(b - l * p) > 1.96::DOUBLE * sqrt(l * p * (1.0::DOUBLE - p))),
t{k + 1} AS (SELECT t.* REPLACE (CASE WHEN len(s) <= {k} THEN t.template ELSE t.template || '/' || CASE WHEN m.seg IS NULL THEN '*' ELSE m.seg END END AS template)
  FROM t{k} t LEFT JOIN m{k} m ON t.host = m.host AND t.template = m.template AND t.s[{k + 1}] = m.seg),""")
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    by_length = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{of(h, p, v)}'" for h, p, v in by_length) + " END"
    return rf"""
WITH lab AS (SELECT doc_id AS doc, greatest(1 - min(quality), max(toxic)) AS bad FROM labels GROUP BY 1),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
  try_cast(nullif(regexp_extract(regexp_extract(url, '(?s)://([^?#]*)', 1), '([0-9]+)[^/0-9]*/?$', 1), '') AS BIGINT) AS doc FROM pages),
v AS (SELECT u.*, bad, CASE WHEN path = '' THEN [] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS s0 FROM u LEFT JOIN lab USING (doc)),
t0 AS (SELECT page_id, host, path, bad, '' AS template, {rest} AS s FROM v),{"".join(steps)}
prior AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(count(bad), 0), 0.0::DOUBLE) AS prior FROM t0),
g AS (SELECT host, template, (coalesce(sum(bad), 0) + 10.0::DOUBLE * (SELECT prior FROM prior)) / (count(bad) + 10.0::DOUBLE) AS purity FROM t{depth} GROUP BY ALL)
SELECT page_id, host, path, {case(lambda h, p, v: h + p)} AS rule, coalesce({case(lambda h, p, v: v)}, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM t{depth} JOIN g USING (host, template)
"""


QUERIES = {"op7_url_filter": op7_url_filter}
SQL = {"op7_url_filter": _sql()}
