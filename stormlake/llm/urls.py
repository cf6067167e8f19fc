"""URL filters as a sort-merge range join, in DataFrame expressions only.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's. A
url is looked up at each of its host's suffixes that may have rules, under the canonical key of reversed host
labels and path; there a rule is the interval of keys that begin with its own. Intervals of one host are nested
or apart, so a sorted sweep over openings, urls and closings keeps the open rules as a stack: the running number
of open intervals is the stack's height, and what lies at its top is the last rule that was opened at that
height. Both are window functions over one sort, so no stack is ever built as an array. Among suffixes the longest rule
(host and path) wins, then the longer host.

A host suffix like ``com`` may hold most urls: suffixes of more than HOT_URLS urls, and of more than a share of
1 / MOST_HOT of them all, are broadcast with a number of salts (at most MOST_HOT rows) before anything is
shuffled by suffix; their urls are dealt over the salts and their rules copied to each, at most one copy for ten urls.

Defined cases: a null url, or one without ``://``, has empty host and path; only A-Z of a host are lowered;
ports stay part of the host; equal rules with both verdicts block; without a fitting rule the verdict is the
default (allow) and the rule null; repeated pages keep their rows; an empty rule table allows all; very long urls
are one key like others, compared byte by byte; columns of pages other than page_id and url, and of rules other than host, path
and verdict, are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Urls of a suffix, and of one salt of it, up to which it isn't dealt out; suffixes that are broadcast, at most.
HOT_URLS, MOST_HOT = 1000, 10_000
#: Rows of one copy of a page from which its copies are made by several tasks.
MANY_COPIES = 10_000
DEFAULT = "allow"
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of rules that the driver knows, as literals."""
    names = ("host", "path", "verdict")
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, rule, strict=True)]) for rule in rules]).cast("array<struct<host: string, path: string, verdict: string>>")
    return spark.range(1).select(F.inline(rows)) if rules else spark.range(0).select(*[F.lit("").alias(n) for n in names])


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _canonical(host: Column, path: Column) -> Column:
    """Bytes, so that X'FF', which no text has, ends the interval of the keys with this prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(" "), path).cast("binary")


def _salted_suffixes(levels: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels with their salt, without hot suffixes that have no rule; rules copied to each salt of their suffix."""
    rules = own.groupBy("suffix").agg(F.count("*").alias("rules"))
    urls = levels.groupBy("suffix").agg(F.count("*").alias("urls"))
    total = levels.count()
    hot = urls.filter(F.col("urls") > max(HOT_URLS, total // MOST_HOT)).join(rules, "suffix", "left")
    salts = F.ceil(F.col("urls") / F.greatest(F.lit(HOT_URLS), 10 * F.col("rules"))).cast("int")
    hot = hot.select("suffix", F.coalesce(salts, F.lit(0)).alias("salts"))
    if (few := rules.limit(MOST_HOT + 1)).count() <= MOST_HOT:
        levels = levels.join(F.broadcast(few.select("suffix")), "suffix", "left_semi")
    levels = levels.join(F.broadcast(hot), "suffix", "left").filter("salts IS NULL OR salts > 0")
    levels = levels.withColumn("salt", F.pmod(F.xxhash64("page_id", "host", "path"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    copied = own.join(F.broadcast(hot), "suffix", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.greatest("salts", F.lit(1)), F.lit(1)) - 1))).drop("salts")
    return levels, copied


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page."""
    host, path = host_and_path(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    own = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    own = own.withColumns({"key": _canonical(F.col("suffix"), F.col("rule_path")), "rule": F.struct((F.length("suffix") + F.length("rule_path")).alias("length"), F.length("suffix").alias("host_length"), F.concat("suffix", "rule_path").alias("rule"), "verdict")})
    deepest = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()[0]
    labels = "split(host, '\\\\.')"
    suffixes = F.expr(f"transform(sequence(1, least({max(1, deepest)}, size({labels}))), n -> array_join(slice({labels}, size({labels}) - n + 1, n), '.'))")
    levels = rows.select("page_id", "host", "path", F.explode(suffixes).alias("suffix"))
    levels, opened = _salted_suffixes(levels, own.select("suffix", "key", "rule"))
    # kinds at one key: a rule opens, urls, a rule closes
    events = opened.withColumn("event", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.lit(1).alias("step"), "key"), F.struct(F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.concat("key", F.lit(b"\xff")).alias("key")))))
    events = events.select("suffix", "salt", "event.kind", "event.step", "event.key", F.when(F.col("event.kind") == 0, F.col("rule")).alias("rule"))
    urls = levels.select("suffix", "salt", F.lit(1).alias("kind"), F.lit(0).alias("step"), _canonical(F.col("suffix"), F.col("path")).alias("key"), F.struct("page_id", "host", "path").alias("page"))
    sweep = Window.partitionBy("suffix", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.unionByName(urls, allowMissingColumns=True).withColumn("height", F.sum("step").over(sweep))
    top = Window.partitionBy("suffix", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.filter("kind < 2").withColumn("hit", F.last("rule", ignorenulls=True).over(top)).filter("kind = 1 AND height > 0")
    hits = swept.select("page.*", "hit")
    judged = rows.unionByName(hits, allowMissingColumns=True).groupBy("page_id", "host", "path").agg(F.sum("n").alias("n"), F.max("hit").alias("hit"))
    judged = judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), "n")
    once = judged.filter(F.col("n") <= MANY_COPIES).withColumn("again", F.explode(F.expr("array_repeat(0, cast(n as int))")))
    many = judged.filter(F.col("n") > MANY_COPIES).withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {MANY_COPIES})"))).repartition("page_id", "host", "path", "part")
    many = many.withColumn("again", F.explode(F.expr(f"array_repeat(0, cast(least({MANY_COPIES}, n - part * {MANY_COPIES}) as int))"))).drop("part")
    return once.unionByName(many).drop("n", "again")


ORACLE = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (SELECT n, max_by(h || p, length(h || p) * 10000 + length(h)) AS rule, max_by(verdict, length(h || p) * 10000 + length(h)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (n)
"""
