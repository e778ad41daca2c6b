"""State changes of the ledger: reviews, acknowledgements, rescans, contacts, scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import next_scan_at, sla_due, strip
from tidewatch.operators.findings import audit
from tidewatch.schemas import RESCANNABLE_JOB_STATUSES, REVIEW_STATUSES, SEVERITIES
from tidewatch.session import as_of_column


def overlay(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Table with the rows of ``changed`` replaced by their new version."""
    return table.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True)


# --------------------------------------------------------------------------
# Reviews
# --------------------------------------------------------------------------


def _order(changes: DataFrame, *tie: str) -> list[str]:
    """Columns that order changes: ``changed_at``, then ``sequence``, where they are given; then content."""
    return [*[c for c in ("changed_at", "sequence") if c in changes.columns], *tie]


def split_reviews(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantined)`` rows of ``(finding_id, new_status, new_severity, reason, analyst)``.

    The rows may also have ``changed_at`` and ``sequence``, which order them.
    """
    status_ok = F.coalesce(F.upper("new_status").isin(*REVIEW_STATUSES), F.lit(False))
    severity_ok = F.col("new_severity").isNull() | F.upper("new_severity").isin(*SEVERITIES)
    good = status_ok & severity_ok
    return changes.filter(good), changes.filter(~good)


def _reviews(changes: DataFrame) -> tuple[DataFrame, list[str]]:
    """Valid changes, and the columns that order them."""
    valid, _ = split_reviews(changes)
    named = valid.withColumns(
        {"s": F.upper("new_status"), "v": F.upper("new_severity"), "who": F.coalesce("analyst", F.lit("ANALYST"))}
    )
    order = _order(named, "s", "v", "reason", "who")
    return named.select("finding_id", *order), order


def apply_reviews(findings: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """Changed findings only, after all their valid changes in order: the last status and the last severity given."""
    now = as_of_column(as_of)
    reviews, order = _reviews(changes)
    one = reviews.withColumn("at", F.struct(*order)).groupBy("finding_id").agg(
        F.max_by(F.struct("s", "reason", "who"), "at").alias("ch"),
        F.max_by("v", F.when(F.col("v").isNotNull(), F.col("at"))).alias("v"),
        F.max(F.col("s") == "RESOLVED").alias("was_resolved"),
        F.max_by("reason", F.when(F.col("s") == "FALSE_POSITIVE", F.col("at"))).alias("fp_reason"),
    )
    joined = findings.join(one, "finding_id")
    new = {
        "status": F.col("ch.s"),
        "severity": F.coalesce("v", "severity"),
        "disclosure_sla_due": F.when(F.col("v").isNotNull(), sla_due(now, F.col("v"))).otherwise(
            F.col("disclosure_sla_due")
        ),
    }
    before = {
        "resolved_at": F.when(F.col("was_resolved"), now),
        "false_positive_reason": F.col("fp_reason"),
    }
    for name, value in before.items():
        new[name] = F.coalesce(value, name) if name in findings.columns else value
    untouched = [c for c in findings.columns if c not in new and c not in ("reviewed_by", "reviewed_at", "updated_at")]
    return joined.select(
        *untouched,
        *[c.alias(n) for n, c in new.items()],
        F.col("ch.who").alias("reviewed_by"),
        now.alias("reviewed_at"),
        now.alias("updated_at"),
        F.col("severity").alias("old_severity"),
        F.col("ch.reason").alias("reason"),
    )


def review_steps(findings: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per valid change, with the severity before and after it; for ``audit_reviews``."""
    reviews, order = _reviews(changes)
    by_time = Window.partitionBy("finding_id").orderBy(*order)
    last = F.last("v", ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    reviewed = reviews.filter(F.col("finding_id").isNotNull()).select("finding_id", "s", "v", "reason", "who", last.alias("_last"))
    # Changes are sorted once, without their order twice in a row, and meet the findings in that order. Of an id that
    # comes more than once, the change is applied to its first row; the others stand after it.
    row = F.row_number().over(Window.partitionBy("finding_id").orderBy("severity"))
    known = findings.filter(F.col("finding_id").isNotNull()).select("finding_id", "severity", row.alias("_row"))
    old = F.coalesce(F.when(F.col("_row") > 1, F.col("v")), "_last", "severity")
    steps = reviewed.join(known, "finding_id").withColumn("old_severity", old)
    return steps.select(
        "finding_id", F.col("s").alias("status"), "old_severity", F.coalesce("v", "old_severity").alias("severity"),
        "reason", F.col("who").alias("reviewed_by"),
    )


def audit_reviews(reviewed: DataFrame, as_of: str) -> DataFrame:
    return audit(
        reviewed, "FINDING_STATUS_UPDATED", F.col("reviewed_by"), "finding", "finding_id", as_of,
        new_status=F.col("status"), old_severity=F.col("old_severity"), new_severity=F.col("severity"),
        reason=F.col("reason"),
    )


# --------------------------------------------------------------------------
# Acknowledgements
# --------------------------------------------------------------------------


def acknowledge_events(events: DataFrame, acks: DataFrame, as_of: str) -> DataFrame:
    """Events named by a token, with ``was_acknowledged``; the first use sets the time."""
    tokens = acks.select("ack_token").filter(F.col("ack_token").isNotNull()).distinct()
    hit = events.join(tokens, "ack_token", "left_semi")
    return hit.select(
        *[c for c in events.columns if c != "acknowledged_at"],
        F.coalesce("acknowledged_at", as_of_column(as_of)).alias("acknowledged_at"),
        F.col("acknowledged_at").isNotNull().alias("was_acknowledged"),
    )


def acknowledge_findings(findings: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Findings of newly acknowledged events, with the time set."""
    new = (
        acknowledged.filter(~F.col("was_acknowledged"))
        .groupBy("finding_id").agg(F.min("acknowledged_at").alias("_at"))
    )
    return findings.join(new, "finding_id").select(
        *[c for c in findings.columns if c != "acknowledged_at"], F.col("_at").alias("acknowledged_at")
    )


def audit_acknowledged(acknowledged: DataFrame, findings: DataFrame, as_of: str) -> DataFrame:
    rows = acknowledged.filter(~F.col("was_acknowledged")).join(findings.select("finding_id", "finding_type"), "finding_id")
    return audit(
        rows, "DISCLOSURE_ACKNOWLEDGED", "ORG", "finding", "finding_id", as_of,
        token=F.concat(F.substring("ack_token", 1, 8), F.lit("...")),
        recipient=F.col("recipient_email"), finding_type=F.col("finding_type"),
    )


def ack_chain(events: DataFrame, findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Token → event → finding → domain."""
    return (
        events.filter(F.col("ack_token").isNotNull()).select("ack_token", "event_id", "finding_id")
        .join(findings.select("finding_id", "domain_id", "finding_type"), "finding_id")
        .join(domains.select("domain_id", "domain"), "domain_id")
        .select("ack_token", "event_id", "finding_id", "finding_type", "domain")
    )


# --------------------------------------------------------------------------
# Rescans and scan results
# --------------------------------------------------------------------------


def rescan_eligible(jobs: DataFrame, domains: DataFrame) -> DataFrame:
    """Jobs that may run again, with ``reactivates`` where the domain is INACTIVE."""
    able = jobs.filter(F.col("status").isin(*RESCANNABLE_JOB_STATUSES))
    state = domains.select("domain_id", "domain", F.col("status").alias("domain_status"))
    return able.join(state, "domain_id").withColumn("reactivates", F.col("domain_status") == "INACTIVE")


def reactivate(domains: DataFrame, rescans: DataFrame) -> DataFrame:
    """Domains, INACTIVE ones with a rescan set ACTIVE."""
    wanted = rescans.filter(F.col("reactivates")).select("domain_id").distinct().withColumn("_re", F.lit(True))
    return domains.join(wanted, "domain_id", "left").select(
        *[F.when(F.col("_re"), "ACTIVE").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in domains.columns]
    )


def audit_rescans(rescans: DataFrame, as_of: str, retry: bool = False) -> DataFrame:
    if retry:
        return audit(
            rescans, "JOB_RETRIED", "ANALYST", "job", "job_id", as_of,
            domain=F.col("domain"), original_status=F.col("status"),
        )
    return audit(
        rescans, "RESCAN_TRIGGERED", "ANALYST", "scan_job", "job_id", as_of,
        original_job_id=F.col("job_id").cast("string"), domain=F.col("domain"),
    )


def finish_scans(results: DataFrame, as_of: str) -> DataFrame:
    """Job rows from scan results ``(domain_id, reachable, error, urls_checked, findings_count, duration_ms)``."""
    failed, reached = F.col("error").isNotNull(), F.col("reachable")
    status = F.when(failed, "FAILED").when(~reached, "SKIPPED").otherwise("COMPLETED")
    return results.select(
        "domain_id",
        status.alias("status"),
        F.when(status == "COMPLETED", F.col("urls_checked")).otherwise(F.lit(0)).alias("urls_checked"),
        F.when(status == "COMPLETED", F.col("findings_count")).otherwise(F.lit(0)).alias("findings_count"),
        F.when(status == "COMPLETED", F.col("duration_ms")).alias("duration_ms"),
        F.when(failed, F.col("error")).when(~reached, F.lit("Domain unreachable")).alias("error_message"),
        as_of_column(as_of).alias("completed_at"),
    )


def scanned_domains(domains: DataFrame, finished: DataFrame, as_of: str) -> DataFrame:
    """Domains after their scans: times, count and next due date, or INACTIVE if unreachable."""
    now = as_of_column(as_of)
    outcome = finished.groupBy("domain_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("_done"), F.count_if(F.col("status") == "SKIPPED").alias("_skip")
    )
    joined = domains.join(outcome, "domain_id", "left")
    done, skipped = F.coalesce("_done", F.lit(0)) > 0, F.coalesce("_skip", F.lit(0)) > 0
    changed = {
        "status": F.when(skipped & ~done, "INACTIVE").otherwise(F.col("status")),
        "last_scanned_at": F.when(done, now).otherwise(F.col("last_scanned_at")),
        "next_scan_due_at": F.when(done, next_scan_at(now, F.col("sector"))).otherwise(F.col("next_scan_due_at")),
        "scan_count": F.coalesce("scan_count", F.lit(0)) + F.coalesce("_done", F.lit(0)).cast("int"),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in domains.columns])


# --------------------------------------------------------------------------
# Contacts
# --------------------------------------------------------------------------


def set_contacts(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed domains only; ``changes`` is ``(domain_id, email)``, in order as reviews; the last one wins."""
    one = changes.groupBy("domain_id").agg(F.max_by(strip(F.col("email")), F.struct(*_order(changes, "email"))).alias("_new"))
    return domains.join(one, "domain_id").select(
        *[c for c in domains.columns if c != "contact_email"],
        F.col("_new").alias("contact_email"),
        F.col("contact_email").alias("old_contact_email"),
    )


def audit_contacts(changed: DataFrame, as_of: str) -> DataFrame:
    return audit(
        changed, "CONTACT_EMAIL_UPDATED", "ANALYST", "domain", "domain_id", as_of,
        domain=F.col("domain"), old=F.col("old_contact_email"), new=F.col("contact_email"),
    )


def discover_contacts(domains: DataFrame, contacts: DataFrame) -> DataFrame:
    """Domains without a contact, filled from resolved contacts ``(domain, email, source)``."""
    found = contacts.select("domain", F.col("email").alias("_e"), F.col("source").alias("contact_source"))
    bare = domains.filter(F.col("contact_email").isNull())
    return bare.join(found, "domain").select(
        *[F.col("_e").alias(c) if c == "contact_email" else F.col(c) for c in domains.columns], "contact_source"
    )


def audit_discovered(changed: DataFrame, as_of: str) -> DataFrame:
    return audit(
        changed, "CONTACT_EMAIL_DISCOVERED", "SYSTEM", "domain", "domain_id", as_of,
        domain=F.col("domain"), email=F.col("contact_email"), source=F.col("contact_source"),
    )


def audit_deleted(doomed: DataFrame, as_of: str) -> DataFrame:
    return audit(doomed, "DOMAIN_DELETED", "ANALYST", "domain", "domain_id", as_of, domain=F.col("domain"))
