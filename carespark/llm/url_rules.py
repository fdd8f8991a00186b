"""URL rules as a sort-merge range join.

A rule allows or blocks a host with all subdomains, from a path on. Keys are
the host's labels in reverse order, a slash and the path, so a rule's urls lie
between its key and its key followed by the largest byte. Such intervals nest
or are apart: sorted, their starts and ends are pushes and pops of a stack.
Running counts of the two give the depth of the stack, and the rule on top is
the last one that started at that depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import write_shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column | str) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without."""
    rest = _rest(F.col(url) if isinstance(url, str) else url)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column | str) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    rest = _rest(F.col(url) if isinstance(url, str) else url)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(labels: Column, path: Column) -> Column:
    """Sort key of reversed labels and a path, as bytes."""
    return F.concat(F.array_join(labels, "."), F.lit("/"), path).cast("binary")


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def url_keys(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per url and parent domain of as many labels as some rule's host has: (host, path, key).

    The numbers of labels travel as one broadcast row; a host of any length
    makes no more keys than there are such numbers.
    """
    counts = rules.agg(F.collect_set(F.size(reversed_labels(F.col("host")))).alias("counts"))
    labelled = urls.select("host", "path", reversed_labels(F.col("host")).alias("labels")).crossJoin(F.broadcast(counts))
    own = F.filter("counts", lambda n: n <= F.size("labels"))
    return labelled.select("host", "path", F.explode(F.transform(own, lambda n: canonical(F.slice("labels", 1, n), F.col("path")))).alias("key"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of `pages` (page_id, url).

    `rules` has (verdict, host, path). A rule fits its host and all subdomains
    where the url's path starts with the rule's; the longest (host and path
    together, then host) wins; of equal rules a block wins. Without a rule the
    verdict is `default` and the rule null. Null urls and urls without `://`
    have empty host and path. Repeated rows give repeated results.

    Distinct urls are judged, so a url that fills a third of the table is one
    row in the sweep. Their keys are range-partitioned and written; each
    partition is swept with the rules that reach into it.
    """
    split = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    counted = split.groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    distinct = counted.select("host", "path").distinct()
    keys = write_shared(
        url_keys(distinct, rules).repartitionByRange("key", "host", "path").withColumn("part", F.spark_partition_id())
    )
    spans = keys.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    known = rules.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(
        F.max("verdict").alias("verdict")  # block follows allow
    )
    start = canonical(reversed_labels(F.col("rule_host")), F.col("rule_path"))
    bounds = known.withColumn("start", start).withColumn("end", F.concat(start, F.lit(b"\xff")))
    # one row per partition of the keys: their number is that of the session's shuffle partitions
    reached = bounds.join(F.broadcast(spans), (F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low")))
    rule = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"), "verdict",
    )
    no_url = [F.lit(None).cast("string").alias(c) for c in ("host", "path")]
    pushes = reached.select("part", F.col("start").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), rule.alias("rule"), *no_url)
    pops = reached.select("part", F.col("end").alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).alias("rule"), *no_url)
    asked = keys.select("part", "key", F.lit(1).alias("kind"), F.lit(0).alias("step"), F.lit(None).alias("rule"), "host", "path")
    events = asked.unionByName(pushes).unionByName(pops)
    order = ["key", "kind"]
    depth = F.sum("step").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    level = Window.partitionBy("part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        events.withColumn("depth", depth)
        .where((F.col("kind") < 2) & (F.col("depth") > 0))
        .withColumn("top", F.last("rule", ignorenulls=True).over(level))
        .where(F.col("kind") == 1)
    )
    size = F.col("top.size").cast("long") * (1 << 31) + F.col("top.host_size")
    best = swept.groupBy("host", "path").agg(F.max_by("top", size).alias("top"))
    return (
        counted.join(best, ["host", "path"], "left")
        .select(
            "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("again"),
        )
        .drop("again")
    )
