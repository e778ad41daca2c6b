"""Look-up feeds at rest: resolutions, geography, breaches, host vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.rules import HOME_COUNTRY
from tidewatch.session import look_up


def resolve(names: DataFrame, resolutions: DataFrame, name: str = "name") -> DataFrame:
    """Add ``ip``, null where the name does not resolve. One row per name is kept."""
    lookup = resolutions.groupBy(F.col("name").alias(name)).agg(F.min("ip").alias("ip"))
    return names.join(lookup, name, "left")


def home_asn(df: DataFrame, ip_geo: DataFrame) -> DataFrame:
    """Add ``asn`` of the row's ip if the ip lies in the home country; null and hot ips go round the shuffle by ip."""
    lookup = (
        ip_geo.filter(F.col("country") == HOME_COUNTRY)
        .groupBy("ip")
        .agg(F.min(F.coalesce("asn", F.lit(""))).alias("asn"))
    )
    return look_up(df, lookup, "ip")


def breach_counts(breaches: DataFrame) -> DataFrame:
    """``(domain, breach_count, account_count)`` from account → breach-list JSON maps.

    A domain may span several payload rows; each is summed before the shuffle.
    """
    values = F.map_values(F.from_json("payload", "map<string,variant>"))
    size_of = F.transform(
        values,
        lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(1)),
    )
    per_row = breaches.select(
        "domain",
        F.size(values).alias("accounts"),
        F.aggregate(size_of, F.lit(0), lambda a, x: a + x).alias("listed"),
    ).filter(F.col("accounts").isNotNull())
    return per_row.groupBy("domain").agg(
        F.sum("accounts").cast("long").alias("breach_count"), F.sum("listed").cast("long").alias("account_count")
    )


def host_vulnerabilities(host_vulns: DataFrame, max_ports: int | None = None, max_vulns: int | None = None) -> DataFrame:
    """Ports, vulnerability count, vulnerabilities (all, or the first so many), organisation."""

    def first(name: str, most: int | None) -> Column:
        return F.col(name) if most is None else F.slice(name, 1, most).alias(name)

    return host_vulns.select(
        "ip",
        first("open_ports", max_ports),
        F.coalesce(F.size("vulns"), F.lit(0)).alias("vuln_count"),
        first("vulns", max_vulns),
        "org",
    )
