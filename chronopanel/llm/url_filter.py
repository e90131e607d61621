"""Operator 6, URL filters: a sort-merge range join over reversed-host keys, in DataFrame functions only.

``www.example.com`` becomes the key ``com.example.www.``; a rule for a host is a prefix of the keys it covers, that is an
interval of keys, and such intervals nest or are apart.  Bounds of intervals and the distinct keys are sorted together
over range partitions, and a sweep keeps the stack of open intervals: its depth is a running sum of openings less
closings, and the interval open at a depth is the last one opened there.  What a partition leaves open or closes of
what was open is a row, and the rows of all partitions, taken in order, give each one the stack it starts with.

The first sweep tells the rules' hosts that cover a page's host.  For each of them the page's path goes through a
second sweep, over the keys of that host and its rules' paths, where the innermost open interval is the longest path that
fits.  The longest of the rules found is the page's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, lookup, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or other strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(F.substr(url, F.instr(url, "://") + 3), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each with a dot behind it; nothing for an empty host, which covers all keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))).cast("binary")


def prefix_key(host: Column, path: Column) -> Column:
    """The key of a path under a rule's host."""
    return F.concat(host_key(host), F.unhex(F.lit("00")), path.cast("binary"))


def sweep(rules: DataFrame, points: DataFrame) -> DataFrame:
    """(key, stack) for each distinct key of ``points``: the rules of which ``key`` is a prefix of it, shortest first.

    rules: key (binary, distinct), rule (anything).  UTF-8 has no byte ff, so a key with one behind it lies after all keys
    that the key is a prefix of and before all others."""
    none = F.lit(None).cast(rules.schema["rule"].dataType)
    events = (
        rules.select(F.col("key").alias("pos"), F.lit(0).alias("kind"), "rule", F.lit(1).alias("step"))
        .union(rules.select(F.concat("key", F.unhex(F.lit("ff"))), F.lit(0), none, F.lit(-1)))
        .union(points.select("key", F.lit(1), none, F.lit(0)))
    )
    events = cut(events.repartitionByRange("pos", "kind").withColumn("part", F.spark_partition_id()), "events")
    order = Window.partitionBy("part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("level", F.sum("step").over(order)).withColumn("lowest", F.least(F.lit(0), F.min("level").over(Window.partitionBy("part"))))
    swept = cut(swept, "swept")
    # what each partition closes of the stack it starts with, and what it leaves open
    ends = swept.groupBy("part").agg((-F.min("lowest")).cast("int").alias("closes"), F.sum("step").alias("final"))
    opened = swept.where("step = 1").groupBy("part", "level").agg(F.max_by("rule", "pos").alias("rule"), F.min("lowest").alias("lowest"))
    left = opened.join(ends, "part").where("level > lowest and level <= final").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("level", "rule"))).alias("left"))
    kind = rules.schema["rule"].dataType.simpleString()
    rows = ends.join(left, "part", "left").select(F.struct("part", "closes", F.coalesce(F.expr("transform(left, x -> x.rule)"), F.expr(f"cast(array() as array<{kind}>)")).alias("opens")).alias("row"))
    # one row a partition, so a short array; the fold is over partitions, not over rules
    begins = rows.agg(F.sort_array(F.collect_list("row")).alias("rows")).select(F.explode(F.expr(f"""
        aggregate(rows, named_struct('stack', cast(array() as array<{kind}>), 'all', cast(array() as array<struct<part:int,begins:array<{kind}>>>)),
          (s, x) -> named_struct('stack', concat(slice(s.stack, 1, greatest(0, size(s.stack) - x.closes)), x.opens), 'all', concat(s.all, array(struct(x.part as part, s.stack as begins)))),
          s -> s.all)""")).alias("x")).select("x.*")
    begins = cut(begins, "begins")
    held = swept.join(F.broadcast(begins), "part").withColumn("depth", (F.size("begins") + F.col("level")).cast("int"))  # one row a partition
    held = held.withColumn("given", F.size("begins"))
    deepest = held.agg(F.max("depth")).first()[0] or 0
    levels = [
        F.coalesce(F.last(F.when((F.col("step") == 1) & (F.col("depth") == d), F.col("rule")), ignorenulls=True).over(order), F.get("begins", F.lit(d - 1)))
        for d in range(1, deepest + 1)
    ]
    stack = F.slice(F.array(*levels), F.lit(1), F.col("depth")) if levels else F.expr(f"cast(array() as array<{kind}>)")
    return held.withColumn("stack", stack).where("kind = 1").select(F.col("pos").alias("key"), "stack")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per input row.

    rules: host, path, verdict; a rule fits its host and subdomains where the path starts with the rule's, and the
    longest (host and path together, then host) wins.  A rule without a host fits every url; null hosts and paths of rules
    are empty ones.  Equal rules with different verdicts: ``block``.  Null urls and those without ``://`` have an empty host
    and path.  Repeated rows and those without an id each give a row; urls of any length are whole; an empty table gives no
    rows, without rules every page has the default; other columns are ignored.  Work is on distinct hosts and paths.
    """
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    flat = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts_of_rules = flat.select(host_key(F.col("host")).alias("key"), F.col("host").alias("rule")).distinct()
    entry = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.char_length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict")
    paths_of_rules = flat.select(prefix_key(F.col("host"), F.col("path")).alias("key"), entry.alias("rule"))
    distinct = cut(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("paths"))
    stacks = cut(sweep(hosts_of_rules, hosts.select(host_key(F.col("host")).alias("key"))).where("size(stack) > 0"), "stacks")
    covered = cut(hosts.withColumn("key", host_key(F.col("host"))).join(stacks, "key").select("host", "paths", "stack"), "covered")
    asked = lookup(distinct, covered, ["host"], "paths").select("host", "path", F.explode("stack").alias("rule_host"))
    asked = cut(asked.select("host", "path", prefix_key(F.col("rule_host"), F.col("path")).alias("key")), "asked")
    fits = cut(sweep(paths_of_rules, asked.select("key").distinct()).where("size(stack) > 0").select("key", F.expr("get(stack, size(stack) - 1)").alias("best")), "fits")
    count = asked.groupBy("key").agg(F.count("*").alias("n"))
    best = lookup(asked, cut(fits.join(count, "key"), "counted"), ["key"], "n").groupBy("host", "path").agg(F.max("best").alias("best"))
    judged = lookup(urls, cut(distinct.join(best, ["host", "path"], "left"), "judged"), ["host", "path"], "n")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge_urls`` of all pages by RULES: see there for nulls, repeats, ties, empty and long urls and columns."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


OP6_SQL = """
WITH rules(rhost, rpath, verdict) AS (VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')),
cuts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cuts),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
