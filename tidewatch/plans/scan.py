"""The domain scan: captures to new findings, jobs, audit rows and fresher domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.content_scan import DEFAULT_RULES, evidence_card, scan_content
from tidewatch.operators.corpus import page_features
from tidewatch.operators.findings import audit_created, save_findings
from tidewatch.operators.path_scan import scan_paths
from tidewatch.operators.transitions import finish_scans, scanned_domains
from tidewatch.rules import ContentRule
from tidewatch.sources.captures import best_capture, home_captures


@dataclass(frozen=True)
class ScanRun:
    """``findings``, ``jobs`` and ``audit`` are rows to append; ``domains`` is the inventory after the scan."""

    findings: DataFrame
    quarantined: DataFrame
    jobs: DataFrame
    domains: DataFrame
    audit: DataFrame


def scan_candidates(captures: DataFrame, salt: str, rules: Sequence[ContentRule] = DEFAULT_RULES) -> DataFrame:
    """Exposed files of every capture at a rule path, and content findings of each domain's best home page.

    Bodies are not shuffled: home pages are ranked without their text, and the
    few hits of captures that lose are dropped afterwards.
    """
    paths = scan_paths(captures.select("domain", "url", "path", "status", "content_type", "body", "body_bytes"))
    files = paths.withColumns(
        {"value_hash": F.lit(None).cast("string"), "value_count_estimate": F.lit(1)}
    )
    homes = home_captures(captures)
    ranked = best_capture(homes.drop("body", "headers")).select("domain", "url", "fetched_at")
    read = homes.select("domain", "url", "path", "status", "content_type", "body_bytes", "fetched_at", "body")
    hits = scan_content(read, "body", key="url", salt=salt, rules=rules, with_context=True)
    # A capture without a time is a capture as well.
    best = ranked.withColumnsRenamed({c: f"_{c}" for c in ranked.columns})
    same = (hits["domain"] == best["_domain"]) & (hits["url"] == best["_url"]) & hits["fetched_at"].eqNullSafe(best["_fetched_at"])
    pages = evidence_card(hits.join(best, same, "left_semi"))
    wanted = (
        "domain", "url", F.col("path").alias("url_path"), F.col("status").alias("http_status"), "finding_type",
        "entity_type", "severity", "confidence", "value_hash", "value_count_estimate", "context_snippet_safe",
        "content_type", F.col("body_bytes").alias("file_size_bytes"),
    )
    return files.select(*wanted).unionByName(pages.select(*wanted))


def fresh_features(captures: DataFrame) -> DataFrame:
    """``(domain, vendor, content_hash)`` of each domain's best home page."""
    return best_capture(page_features(home_captures(captures))).select("domain", "vendor", "content_hash")


def scan_domains(
    captures: DataFrame,
    domains: DataFrame,
    findings: DataFrame,
    *,
    as_of: str,
    salt: str,
    rules: Sequence[ContentRule] = DEFAULT_RULES,
    requested: DataFrame | None = None,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> ScanRun:
    """One scan over captures at rest, against the inventory and the findings of the ledger.

    A domain counts as reachable if any of its captures has a status below 500; others that have
    captures or are ``requested`` (domain) get a SKIPPED job and become INACTIVE. Domains without
    captures that were not requested were not scanned and stay as they are. Findings of domains that the inventory lacks
    are quarantined. ``cut`` may write candidates and features to the shared
    folder and read them back, so that bodies are read once.
    """
    features = cut(fresh_features(captures))
    named = domains.select("domain", "domain_id", F.col("vendor_fingerprint").alias("_vendor"))
    vendor = F.coalesce("vendor", "_vendor").alias("vendor_fingerprint")
    candidates = cut(scan_candidates(captures, salt, rules))
    placed = candidates.join(named.join(features.select("domain", "vendor"), "domain", "left"), "domain", "left")
    columns = [c for c in placed.columns if c not in ("vendor", "_vendor")]
    rows, bad = save_findings(placed.select(*columns, vendor), findings, as_of)
    rows = cut(rows)

    seen = captures.groupBy("domain").agg(
        F.count_distinct("path").cast("int").alias("urls_checked"),
        F.coalesce(F.max(F.col("status") < 500), F.lit(False)).alias("reachable"),
    )
    if requested is not None:
        asked = requested.select("domain").distinct()
        seen = asked.join(seen, "domain", "full").select(
            "domain", F.coalesce("urls_checked", F.lit(0)).alias("urls_checked"), F.coalesce("reachable", F.lit(False)).alias("reachable")
        )
    found = rows.groupBy("domain_id").agg(F.count("*").cast("int").alias("findings_count"))
    results = named.join(seen, "domain").join(found, "domain_id", "left").select(
        "domain_id", "reachable", F.lit(None).cast("string").alias("error"), "urls_checked",
        F.coalesce("findings_count", F.lit(0)).alias("findings_count"), F.lit(None).cast("int").alias("duration_ms"),
    )
    finished = finish_scans(results, as_of)
    job_id = F.sha2(F.concat_ws("|", F.col("domain_id").cast("string"), F.lit(as_of), F.lit("SCAN")), 256)
    jobs = finished.join(named.select("domain_id", F.col("domain").alias("domain_name")), "domain_id").withColumn("job_id", job_id)

    known = domains.join(features.select("domain", "vendor", F.col("content_hash").alias("_hash")), "domain", "left")
    newer = {"vendor_fingerprint": F.coalesce("vendor", "vendor_fingerprint"), "baseline_hash": F.coalesce("_hash", "baseline_hash")}
    refreshed = known.select(*[newer[c].alias(c) if c in newer else F.col(c) for c in domains.columns])
    return ScanRun(rows, bad, jobs, scanned_domains(refreshed, finished, as_of), audit_created(rows, as_of))
