"""URL rules by a sorted sweep over reversed-host keys, with DataFrame operations only.

A host is turned round label by label and closed with a dot (``www.example.com``
becomes ``com.example.www.``). A rule's host and all its subdomains are then one
interval of keys, from the rule's key up to the same key with ``/``, the
character after the dot, in place of the last dot. Rule intervals are nested or
disjoint. Each interval's two ends carry the stack of rules that are active from
there on. Ends and URLs are sorted together, and one pass hands the last stack
seen to each URL.

URLs are dealt by their top label and, within it, by a hash into slices of
bounded size, so a host with a third of all URLs is no hot group. A label's rule
ends are repeated once a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _top(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def _rule_ends(rules: DataFrame) -> DataFrame:
    """(key, stack): both ends of each rule host's interval and the rules active after it, longest first."""
    rule = F.struct(
        F.size(F.split("host", r"\.")).alias("depth"),
        F.length("path").alias("path_length"),
        "host",
        "path",
        "verdict",
    )
    hosts = (
        rules.filter((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .select(host_key(F.col("host")).alias("key"), rule.alias("rule"))
        .distinct()
    )
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    prefix = F.expr("concat(array_join(slice(labels, 1, n), '.'), '.')")
    stacks = (
        hosts.select("key")
        .distinct()
        .withColumn("labels", labels)
        .withColumn("n", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .select(F.col("key").alias("own"), prefix.alias("key"))
        .join(hosts, "key")
        .groupBy("own")
        .agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack"))
    )
    own_depth = F.size(F.split("own", r"\.")) - 1
    opened = stacks.select(F.col("own").alias("key"), "stack")
    closed = stacks.select(
        F.concat(F.expr("left(own, length(own) - 1)"), F.lit("/")).alias("key"),
        F.filter("stack", lambda r: r["depth"] < own_depth).alias("stack"),
    )
    return opened.unionByName(closed).withColumn("top", F.regexp_extract("key", r"^([^./]*)", 1))


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    *,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    slice_rows: int = 16_384,
) -> DataFrame:
    """Return ``key``, host, path, rule and verdict of every URL.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains
    if the URL's path starts with its path. Of the rules that fit, the one with
    most host labels wins, then the one with the longest path; if two differ in
    the verdict alone, the larger verdict wins. Without a rule: rule null,
    verdict ``default``.

    Null URLs, empty ones and those without ``://`` have an empty host and path
    and fit no rule. Repeated rows are each judged; null keys are kept; other
    columns of ``urls`` are not read. Rules without a host, a path or a verdict
    fit nothing. No URLs: no rows; no rules: every verdict is the default.
    """
    page = urls.select(
        F.col(key).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    page = page.withColumn("key", host_key(F.col("host"))).withColumn("top", _top(F.col("key")))
    slices = page.groupBy("top").agg(F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias("slices"))
    ends = (
        _rule_ends(rules)
        .join(slices, "top")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("top", "slice", "key", "stack", F.lit(False).alias("is_url"))
    )
    dealt = page.join(slices, "top").withColumn(
        "slice", F.pmod(F.xxhash64("id", "key", "path"), F.col("slices")).cast("int")
    )
    sweep = Window.partitionBy("top", "slice").orderBy("key", "is_url")
    active = (
        dealt.withColumn("is_url", F.lit(True))
        .unionByName(ends, allowMissingColumns=True)
        .withColumn("stack", F.last("stack", ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("is_url")
    )
    best = F.get(F.filter("stack", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    return active.withColumn("best", best).select(
        F.col("id").alias(key),
        "host",
        "path",
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
