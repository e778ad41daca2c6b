"""List filters and due-lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions.text import search
from tidewatch.session import as_of_column


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def domain_filter(
    domains: DataFrame,
    *,
    term: str | None = None,
    status: str | None = None,
    sector: str | None = None,
    tld: str | None = None,
    min_score: int = 0,
) -> DataFrame:
    tests = []
    if term:
        tests.append(search(F.col("domain"), term))
    if status:
        tests.append(F.col("status") == status.upper())
    if sector:
        tests.append(F.col("sector") == sector.upper())
    if tld:
        tests.append(F.col("tld") == tld.lower())
    if min_score:
        tests.append(F.col("iocs_score") >= min_score)
    return domains.filter(_all(tests))


def with_findings(domains: DataFrame, findings: DataFrame, has_findings: bool | None) -> DataFrame:
    """Domains that have (or lack) findings; applied before paging, so totals agree.

    Finding keys are made distinct first: partial aggregation turns a domain
    with very many findings into one row per task before the shuffle.
    """
    if has_findings is None:
        return domains
    owners = findings.select("domain_id").distinct()
    return domains.join(owners, "domain_id", "left_semi" if has_findings else "left_anti")


def finding_filter(
    findings: DataFrame,
    *,
    severity: str | None = None,
    status: str | None = None,
    entity_type: str | None = None,
    domain_id: object = None,
    dark_web: bool | None = None,
) -> DataFrame:
    tests = []
    if severity:
        tests.append(F.col("severity") == severity.upper())
    if status:
        tests.append(F.col("status") == status.upper())
    if entity_type:
        tests.append(F.col("entity_type") == entity_type.upper())
    if domain_id is not None:
        tests.append(F.col("domain_id") == F.lit(domain_id))
    if dark_web is True:
        tests.append(F.col("dark_web_confirmed"))
    return findings.filter(_all(tests))


def search_findings(findings: DataFrame, domains: DataFrame, term: str) -> DataFrame:
    """Findings whose url, type or domain name contains the term, with the domain name.

    Domains are searched on their own side, so findings meet only the matching
    ones before most of them are dropped.
    """
    matched = domains.filter(search(F.col("domain"), term)).select("domain_id", F.lit(True).alias("_named"))
    hit = search(F.col("url"), term) | search(F.col("finding_type"), term) | F.col("_named").isNotNull()
    rows = findings.join(matched, "domain_id", "left").filter(hit).drop("_named")
    return rows.join(domains.select("domain_id", "domain"), "domain_id")


def job_filter(jobs: DataFrame, status: str | None = None, domain: str | None = None) -> DataFrame:
    tests = []
    if status:
        tests.append(F.col("status") == status.upper())
    if domain:
        tests.append(search(F.col("domain_name"), domain))
    return jobs.filter(_all(tests))


def audit_filter(logs: DataFrame, event_type: str | None = None, actor: str | None = None) -> DataFrame:
    tests = []
    if event_type:
        tests.append(search(F.col("event_type"), event_type))
    if actor:
        tests.append(search(F.col("actor"), actor))
    return logs.filter(_all(tests))


def disclosure_filter(events: DataFrame, status: str | None = None) -> DataFrame:
    return events.filter(F.col("send_status") == status.upper()) if status else events


def due_by_time(domains: DataFrame, as_of: str, batch: int | None = None) -> DataFrame:
    """ACTIVE domains whose next scan is due, all, or the ``batch`` longest waiting."""
    due = domains.filter((F.col("status") == "ACTIVE") & (F.col("next_scan_due_at") <= as_of_column(as_of)))
    return due if batch is None else due.orderBy("next_scan_due_at", "domain_id").limit(batch)


def rescan_ttl(sector: Column) -> Column:
    picks = [F.when(sector == s, F.lit(d)) for s, d in rules.RESCAN_TTL_DAYS.items()]
    return F.coalesce(*picks, F.lit(rules.RESCAN_TTL_DEFAULT))


def due_by_ttl(domains: DataFrame, as_of: str) -> DataFrame:
    """ACTIVE, qualifying domains with ``due``: never scanned or whole-day age at least the sector's TTL."""
    seconds = F.unix_timestamp(as_of_column(as_of)) - F.unix_timestamp("last_scanned_at")
    age = F.floor(seconds / 86400)
    due = F.col("last_scanned_at").isNull() | (age >= rescan_ttl(F.col("sector")))
    known = domains.filter((F.col("status") == "ACTIVE") & (F.col("iocs_score") >= rules.SCORE_THRESHOLD))
    return known.withColumn("due", due)
