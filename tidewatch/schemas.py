"""Explicit schemas and allowed values of the ledger and input tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations, in declaration order. Order matters for severity.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
FINDING_STATUSES = ("NEW", "CONFIRMED", "DISCLOSED", "RESOLVED", "FALSE_POSITIVE", "ESCALATED")
SCAN_STATUSES = ("PENDING", "RUNNING", "COMPLETED", "FAILED", "SKIPPED")
DOMAIN_STATUSES = ("PENDING", "ACTIVE", "INACTIVE", "BLOCKED", "WHITELISTED")
ENTITY_TYPES = (
    "AADHAAR", "PAN", "VOTER_ID", "PASSPORT", "DRIVING_LICENSE", "BANK_ACCOUNT", "CREDIT_CARD",
    "PHONE_NUMBER", "EMAIL", "UPI_ID", "ABHA_ID",
    "ENV_FILE", "PRIVATE_KEY", "API_KEY", "AWS_KEY", "STRIPE_KEY", "SECRET_FIELD", "AWS_CREDS",
    "AWS_CONFIG", "AZURE_CREDS",
    "GIT_REPO", "DATABASE_DUMP", "CONFIG_FILE", "SOURCE_CODE", "ADMIN_PANEL", "OPEN_DIRECTORY",
    "CLOUD_STORAGE", "CLOUD_METADATA", "KUBE_CONFIG", "SPRING_BOOT", "MEMORY_DUMP",
    "SHELL_HISTORY", "SESSION_DATA", "CI_CONFIG",
    "OTHER",
)

CLOSED_STATUSES = ("RESOLVED", "FALSE_POSITIVE")
RISK_OPEN_STATUSES = ("NEW", "CONFIRMED", "ESCALATED")
REVIEW_STATUSES = ("CONFIRMED", "FALSE_POSITIVE", "RESOLVED", "ESCALATED")
RESCANNABLE_JOB_STATUSES = ("FAILED", "SKIPPED", "COMPLETED")

CONFIDENCE = T.DecimalType(4, 3)

# Table schemas as DDL, which every Spark reader takes.


DOMAINS = (
    "domain_id string, domain string, tld string, iocs_score short, status string, "
    "ip_address string, asn string, hosting_provider string, cdn_detected string, "
    "country_code string, signal_whois_in boolean, signal_ip_in boolean, "
    "signal_payment_gw boolean, signal_gst_number boolean, signal_lang_in boolean, "
    "signal_registry boolean, last_scanned_at timestamp, next_scan_due_at timestamp, "
    "scan_count int, baseline_hash string, discovered_via string, sector string, "
    "vendor_fingerprint string, contact_email string, notes string, "
    "created_at timestamp, updated_at timestamp"
)

FINDINGS = (
    "finding_id string, domain_id string, url string, url_path string, http_status short, "
    "entity_type string, finding_type string, value_hash string, value_count_estimate int, "
    "severity string, heuristic_confidence decimal(4,3), ml_confidence decimal(4,3), "
    "final_confidence decimal(4,3), status string, dark_web_confirmed boolean, "
    "vendor_fingerprint string, context_snippet_safe string, file_size_bytes long, "
    "content_type string, disclosed_at timestamp, disclosure_sla_due timestamp, "
    "acknowledged_at timestamp, resolved_at timestamp, escalation_level short, "
    "detected_by string, reviewed_by string, reviewed_at timestamp, "
    "false_positive_reason string, created_at timestamp, updated_at timestamp"
)

SCAN_JOBS = (
    "job_id string, domain_id string, domain_name string, job_type string, status string, "
    "task_id string, urls_checked int, findings_count int, errors_count int, "
    "duration_ms int, queued_at timestamp, started_at timestamp, completed_at timestamp, "
    "error_message string, created_at timestamp"
)

AUDIT_LOGS = (
    "id long, event_type string, actor string, target_type string, target_id string, "
    "details string, ip_address string, event_at timestamp"
)

DISCLOSURE_EVENTS = (
    "event_id string, finding_id string, recipient_email string, recipient_type string, "
    "subject string, sent_at timestamp, send_status string, error_message string, "
    "ack_token string, acknowledged_at timestamp, created_at timestamp"
)

CAPTURES = (
    "domain string, url string, path string, scheme string, status int, "
    "headers map<string,string>, content_type string, body string, body_bytes long, "
    "fetched_at timestamp"
)
CT_ENTRIES = ("entry_id long, name_value string")
FEED_NAMES = ("source string, root string, payload string")
RESOLUTIONS = ("name string, ip string")
IP_GEO = ("ip string, asn string, country string")
BREACHES = ("domain string, payload string")
HOST_VULNS = ("ip string, open_ports array<int>, vulns array<string>, org string")
CONTACT_FILES = ("domain string, priority int, status int, body string")

LEDGER = {
    "domains": DOMAINS,
    "findings": FINDINGS,
    "scan_jobs": SCAN_JOBS,
    "audit_logs": AUDIT_LOGS,
    "disclosure_events": DISCLOSURE_EVENTS,
}


def severity_rank(severity: Column, unknown: int = 9) -> Column:
    """0 for CRITICAL … 4 for INFO; anything else sorts last."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(position > 0, position.cast("int") - 1).otherwise(F.lit(unknown))


def is_open(status: Column) -> Column:
    """Open in the ledger sense: neither resolved nor a false positive."""
    return ~status.isin(*CLOSED_STATUSES)


def is_risk_open(status: Column) -> Column:
    """Open in the risk-scoring sense, where a disclosed finding no longer counts."""
    return status.isin(*RISK_OPEN_STATUSES)
