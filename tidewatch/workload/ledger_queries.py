"""Queries over the mapped ledger, each with its SQL for the comparison engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators import correlation, disclosure, names, predicates, risk, transitions
from tidewatch.operators import findings as saving
from tidewatch.operators.corpus import delete_domains
from tidewatch.plans import journal, reports, workflow
from tidewatch.schemas import CONFIDENCE, is_open, is_risk_open
from tidewatch.session import as_of_column, checkpoint_root, handover
from tidewatch.sources import lookups
from tidewatch.sources.buckets import BucketTable
from tidewatch.streaming.detect import arriving, batch_folder
from tidewatch.streaming.ledger_state import append_available, record_closed
from tidewatch.workload import inputs as I
from tidewatch.workload.inputs import AS_OF, SETTINGS
from tidewatch.workload.inputs_sql import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are the derived tables its SQL reads."""

    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, with_ctes(sql, *ctes) if sql and ctes else sql)
        return fn

    return add


def ts(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


NOW = "TIMESTAMP '2026-01-01 00:00:00'"
OPEN = "status NOT IN ('RESOLVED','FALSE_POSITIVE')"
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END"
SLA = "CASE severity WHEN 'CRITICAL' THEN 24 WHEN 'HIGH' THEN 72 WHEN 'MEDIUM' THEN 168 ELSE 720 END"
EFFECTIVE = "coalesce(nullif(final_confidence, 0), heuristic_confidence, 0)"

# Rows of a file of a list that is read by pages.
PAGED_FILE_ROWS = 100_000

# -- figures ---------------------------------------------------------------


@query(
    "findings_page_after",
    """SELECT finding_id, final_confidence FROM (SELECT *, row_number() OVER (ORDER BY final_confidence DESC NULLS LAST, finding_id) AS n FROM findings)
        WHERE n > 75 AND n <= 100 OR n > (SELECT count(*) // 10 * 9 FROM findings) AND n <= (SELECT count(*) // 10 * 9 FROM findings) + 25""",
    "findings",
)
def findings_page_after(spark, sf):
    """The fourth page, by three cursors, and a deep page after the row nine tenths down."""
    rows = I.findings(spark, sf).select("finding_id", "final_confidence")
    nine_tenths = rows.count() // 10 * 9
    files = max(32, nine_tenths // PAGED_FILE_ROWS)
    paged = reports.write_paged(rows, f"{checkpoint_root(spark)}/paged-{uuid.uuid4().hex}", -F.col("final_confidence"), "finding_id", files)

    def last_of(page):
        return max(((r.sort_value is None, r.sort_value or 0, r.finding_id), (r.sort_value, r.finding_id)) for r in page.collect())[1]

    page = reports.page_after(paged, "finding_id")
    for _ in range(3):
        page = reports.page_after(paged, "finding_id", last_of(page))
    deep = reports.page_after(paged, "finding_id", reports.row_at(paged, "finding_id", nine_tenths))
    return page.unionByName(deep).select("finding_id", "final_confidence")



@query(
    "dashboard_summary",
    f"""SELECT * FROM
        (SELECT count(*) AS total_domains, count(*) FILTER (status = 'ACTIVE') AS active_domains FROM domains),
        (SELECT count(*) AS total_findings,
                count(*) FILTER (severity = 'CRITICAL' AND {OPEN}) AS open_critical,
                count(*) FILTER (severity = 'HIGH' AND {OPEN}) AS open_high,
                count(*) FILTER (severity = 'MEDIUM' AND {OPEN}) AS open_medium,
                count(*) FILTER (status = 'RESOLVED') AS resolved_findings,
                count(*) FILTER (status = 'DISCLOSED') AS pending_remediation
         FROM findings)""",
    "domains",
    "findings",
)
def dashboard_summary(spark, sf):
    return reports.dashboard_summary(I.domains(spark, sf), I.findings(spark, sf))


@query(
    "findings_by_sector",
    "SELECT d.sector, COUNT(*) AS n_findings FROM findings f JOIN domains d USING (domain_id) WHERE d.sector IS NOT NULL GROUP BY d.sector",
    "domains",
    "findings",
)
def findings_by_sector(spark, sf):
    return reports.findings_by_sector(I.findings(spark, sf), I.domains(spark, sf))


@query("findings_by_severity", "SELECT severity, COUNT(*) AS n_findings FROM findings GROUP BY severity", "findings")
def findings_by_severity(spark, sf):
    return reports.findings_by_severity(I.findings(spark, sf))


@query("findings_by_domain", "SELECT domain_id, COUNT(*) AS n_findings FROM findings GROUP BY domain_id", "findings")
def findings_by_domain(spark, sf):
    return reports.findings_by_domain(I.findings(spark, sf))


@query(
    "disclosure_summary",
    f"""WITH a AS (SELECT
         count(*) FILTER (disclosed_at IS NULL AND {OPEN} AND (severity = 'CRITICAL' OR disclosure_sla_due <= {NOW} + to_hours(24))) AS awaiting_disclosure,
         count(*) FILTER (disclosed_at IS NULL AND {OPEN} AND severity = 'CRITICAL') AS awaiting_critical,
         count(*) FILTER (disclosed_at IS NULL AND {OPEN} AND severity <> 'CRITICAL' AND disclosure_sla_due <= {NOW} + to_hours(24)) AS awaiting_sla,
         count(*) FILTER (severity = 'CRITICAL' AND status = 'DISCLOSED' AND acknowledged_at IS NULL AND disclosed_at < {NOW} - to_hours(72)) AS escalation_pending,
         count(disclosed_at) AS disclosed_total, count(acknowledged_at) AS acknowledged FROM findings),
       b AS (SELECT count(*) FILTER (status = 'ACTIVE' AND contact_email IS NULL) AS no_contact_email FROM domains)
       SELECT * FROM a, b""",
    "domains",
    "findings",
)
def disclosure_summary(spark, sf):
    return reports.disclosure_summary(I.domains(spark, sf), I.findings(spark, sf), AS_OF)


@query(
    "recent_jobs",
    f"SELECT job_id, domain_name, status, findings_count, duration_ms, {sql_ts('created_at')} AS created_at FROM scan_jobs ORDER BY scan_jobs.created_at DESC NULLS FIRST, job_id LIMIT 5",
    "scan_jobs",
)
def recent_jobs(spark, sf):
    cols = ["job_id", "domain_name", "status", "findings_count", "duration_ms", ts("created_at").alias("created_at")]
    return reports.recent_jobs(I.scan_jobs(spark, sf)).select(*cols)


@query(
    "recent_jobs_per_domain",
    """SELECT domain_id, job_id, job_rank FROM (SELECT domain_id, job_id,
       row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC NULLS FIRST, job_id) AS job_rank FROM scan_jobs) WHERE job_rank <= 10""",
    "scan_jobs",
)
def recent_jobs_per_domain(spark, sf):
    return reports.recent_jobs_per_domain(I.scan_jobs(spark, sf)).select("domain_id", "job_id", "job_rank")


# -- predicates ------------------------------------------------------------


@query("open_findings", f"SELECT finding_id, status FROM findings WHERE {OPEN}", "findings")
def open_findings(spark, sf):
    return I.findings(spark, sf).filter(is_open(F.col("status"))).select("finding_id", "status")


@query(
    "risk_open_findings",
    "SELECT finding_id, status FROM findings WHERE status IN ('NEW','CONFIRMED','ESCALATED')",
    "findings",
)
def risk_open_findings(spark, sf):
    return I.findings(spark, sf).filter(is_risk_open(F.col("status"))).select("finding_id", "status")


@query(
    "filtered_domains",
    """SELECT domain_id, domain FROM domains d WHERE domain ILIKE '%rg1%' AND status = 'ACTIVE' AND sector = 'FINANCE'
       AND iocs_score >= 20 AND EXISTS (SELECT 1 FROM findings f WHERE f.domain_id = d.domain_id)""",
    "domains",
    "findings",
)
def filtered_domains(spark, sf):
    found = predicates.domain_filter(I.domains(spark, sf), term="RG1", status="active", sector="finance", min_score=20)
    return predicates.with_findings(found, I.findings(spark, sf), True).select("domain_id", "domain")


@query(
    "domains_without_findings",
    "SELECT domain_id, domain FROM domains d WHERE tld = '.gov.in' AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.domain_id = d.domain_id AND f.status = 'NEW')",
    "domains",
    "findings",
)
def domains_without_findings(spark, sf):
    found = predicates.domain_filter(I.domains(spark, sf), tld=".GOV.IN")
    new = predicates.finding_filter(I.findings(spark, sf), status="new")
    return predicates.with_findings(found, new, False).select("domain_id", "domain")


@query(
    "filtered_findings",
    "SELECT finding_id FROM findings WHERE severity = 'HIGH' AND status = 'NEW' AND entity_type = 'GIT_REPO' AND dark_web_confirmed",
    "findings",
)
def filtered_findings(spark, sf):
    return predicates.finding_filter(
        I.findings(spark, sf), severity="high", status="new", entity_type="git_repo", dark_web=True
    ).select("finding_id")


@query("search_domains", "SELECT domain_id, domain FROM domains WHERE domain ILIKE '%ORG12%'", "domains")
def search_domains(spark, sf):
    return I.domains(spark, sf).filter(text.search(F.col("domain"), "ORG12")).select("domain_id", "domain")


@query(
    "search_findings",
    """SELECT finding_id, domain FROM findings f JOIN domains d USING (domain_id)
       WHERE url ILIKE '%g77%' OR finding_type ILIKE '%g77%' OR domain ILIKE '%g77%'""",
    "domains",
    "findings",
)
def search_findings(spark, sf):
    return predicates.search_findings(I.findings(spark, sf), I.domains(spark, sf), "G77").select("finding_id", "domain")


@query(
    "due_scans",
    f"""SELECT domain_id, {sql_ts('next_scan_due_at')} AS next_scan_due_at FROM domains
        WHERE status = 'ACTIVE' AND domains.next_scan_due_at <= {NOW} ORDER BY domains.next_scan_due_at, domain_id LIMIT 100""",
    "domains",
)
def due_scans(spark, sf):
    return predicates.due_by_time(I.domains(spark, sf), AS_OF, batch=100).select("domain_id", ts("next_scan_due_at").alias("next_scan_due_at"))


@query(
    "due_scans_all",
    f"SELECT domain_id FROM domains WHERE status = 'ACTIVE' AND next_scan_due_at <= {NOW}",
    "domains",
)
def due_scans_all(spark, sf):
    return predicates.due_by_time(I.domains(spark, sf), AS_OF, batch=None).select("domain_id")


@query(
    "due_rescans",
    f"""SELECT domain_id, last_scanned_at IS NULL OR floor(epoch({NOW} - last_scanned_at) / 86400) >=
        CASE sector WHEN 'GOVERNMENT' THEN 7 WHEN 'HEALTHCARE' THEN 7 WHEN 'FINANCE' THEN 7 WHEN 'EDUCATION' THEN 14 WHEN 'RESEARCH' THEN 14 ELSE 30 END AS due
        FROM domains WHERE status = 'ACTIVE' AND iocs_score >= 50""",
    "domains",
)
def due_rescans(spark, sf):
    return predicates.due_by_ttl(I.domains(spark, sf), AS_OF).select("domain_id", "due")


@query(
    "due_fingerprints",
    "SELECT domain_id FROM domains WHERE status = 'ACTIVE' AND vendor_fingerprint IS NULL",
    "domains",
)
def due_fingerprints(spark, sf):
    from tidewatch.operators.corpus import due_for_fingerprint

    return due_for_fingerprint(I.domains(spark, sf)).select("domain_id")


# -- lists -----------------------------------------------------------------


@query(
    "list_domains",
    """WITH p AS (SELECT * FROM domains WHERE status = 'ACTIVE' ORDER BY iocs_score DESC NULLS FIRST, domain_id LIMIT 25 OFFSET 25)
       SELECT p.domain_id, p.domain, p.iocs_score, count(f.finding_id) AS findings_count
       FROM p LEFT JOIN findings f USING (domain_id) GROUP BY ALL""",
    "domains",
    "findings",
)
def list_domains(spark, sf):
    active = predicates.domain_filter(I.domains(spark, sf), status="ACTIVE")
    return reports.list_domains(active, I.findings(spark, sf), page=2).select("domain_id", "domain", "iocs_score", "findings_count")


@query(
    "list_domains_scanned",
    f"SELECT domain_id, {sql_ts('last_scanned_at')} AS last_scanned_at FROM domains ORDER BY domains.last_scanned_at DESC NULLS FIRST, domain_id LIMIT 50",
    "domains",
)
def list_domains_scanned(spark, sf):
    found = reports.list_domains(I.domains(spark, sf), I.findings(spark, sf), sort="scanned_desc", per_page=50)
    return found.select("domain_id", ts("last_scanned_at").alias("last_scanned_at"))


@query(
    "list_domains_by_score_asc",
    "SELECT domain_id, iocs_score FROM domains ORDER BY iocs_score ASC NULLS LAST, domain_id LIMIT 100",
    "domains",
)
def list_domains_by_score_asc(spark, sf):
    found = reports.list_domains(I.domains(spark, sf), I.findings(spark, sf), sort="iocs_asc", per_page=100)
    return found.select("domain_id", "iocs_score")


@query("list_domains_by_name", "SELECT domain_id, domain FROM domains ORDER BY domain ASC NULLS LAST, domain_id LIMIT 25", "domains")
def list_domains_by_name(spark, sf):
    return reports.list_domains(I.domains(spark, sf), I.findings(spark, sf), sort="domain_asc").select("domain_id", "domain")


@query(
    "finding_detail",
    f"""SELECT finding_id, d.domain, url, url_path, entity_type, finding_type, severity, f.status, heuristic_confidence, dark_web_confirmed,
        {sql_ts('disclosure_sla_due')} AS sla_due, escalation_level FROM findings f JOIN domains d USING (domain_id)""",
    "domains",
    "findings",
)
def finding_detail(spark, sf):
    return reports.finding_detail(I.findings(spark, sf), I.domains(spark, sf)).select(
        "finding_id", "domain", "url", "url_path", "entity_type", "finding_type", "severity", "status", "heuristic_confidence",
        "dark_web_confirmed", ts("disclosure_sla_due").alias("sla_due"), "escalation_level",
    )


def _list_findings_sql(order: str) -> str:
    return f"""SELECT f.finding_id, d.domain, f.finding_type, f.severity, f.status, CAST({EFFECTIVE} AS DECIMAL(4,3)) AS confidence,
        {sql_ts('f.disclosure_sla_due')} AS sla_due FROM findings f JOIN domains d USING (domain_id) ORDER BY {order}, f.finding_id LIMIT 25"""


def _list_findings(spark, sf, sort):
    listed = reports.list_findings(I.findings(spark, sf), I.domains(spark, sf), sort=sort)
    return listed.select("finding_id", "domain", "finding_type", "severity", "status", "confidence", ts("sla_due").alias("sla_due"))


@query("list_findings", _list_findings_sql("f.created_at DESC NULLS FIRST"), "domains", "findings")
def list_findings(spark, sf):
    return _list_findings(spark, sf, "created_desc")


@query("list_findings_by_severity", _list_findings_sql(RANK), "domains", "findings")
def list_findings_by_severity(spark, sf):
    return _list_findings(spark, sf, "severity_desc")


@query("list_findings_by_confidence", _list_findings_sql("f.final_confidence DESC NULLS FIRST"), "domains", "findings")
def list_findings_by_confidence(spark, sf):
    return _list_findings(spark, sf, "confidence_desc")


@query("list_findings_by_sla", _list_findings_sql("f.disclosure_sla_due ASC NULLS LAST"), "domains", "findings")
def list_findings_by_sla(spark, sf):
    return _list_findings(spark, sf, "sla_asc")


@query(
    "list_jobs",
    f"""SELECT job_id, domain_name, status, urls_checked, {sql_ts('created_at')} AS created_at FROM scan_jobs
        WHERE status = 'FAILED' AND domain_name ILIKE '%org1%' ORDER BY scan_jobs.created_at DESC NULLS FIRST, job_id LIMIT 25""",
    "scan_jobs",
)
def list_jobs(spark, sf):
    found = predicates.job_filter(I.scan_jobs(spark, sf), status="failed", domain="org1")
    return reports.list_jobs(found).select("job_id", "domain_name", "status", "urls_checked", ts("created_at").alias("created_at"))


@query(
    "list_audit",
    """SELECT id, event_type, actor, details FROM audit_logs WHERE event_type ILIKE '%cli%' AND actor ILIKE '%user1%'
       ORDER BY event_at DESC NULLS FIRST, id LIMIT 200""",
    "audit_logs",
)
def list_audit(spark, sf):
    found = predicates.audit_filter(I.audit_logs(spark, sf), event_type="cli", actor="user1")
    return reports.list_audit(found, per_page=200).select("id", "event_type", "actor", "details")


@query(
    "list_disclosures",
    """SELECT event_id, finding_id, recipient_email, recipient_type, subject, send_status FROM disclosure_events
       WHERE send_status = 'FAILED' ORDER BY created_at DESC NULLS FIRST, event_id LIMIT 25 OFFSET 25""",
    "disclosure_events",
)
def list_disclosures(spark, sf):
    found = predicates.disclosure_filter(I.disclosure_events(spark, sf), "failed")
    return reports.list_disclosures(found, page=2).select(
        "event_id", "finding_id", "recipient_email", "recipient_type", "subject", "send_status"
    )


@query(
    "counts_with_page",
    f"""SELECT 'domains' AS listing, count(*) AS total FROM domains WHERE status = 'ACTIVE'
        UNION ALL SELECT 'findings', count(*) FROM findings WHERE severity = 'CRITICAL'
        UNION ALL SELECT 'jobs', count(*) FROM scan_jobs WHERE status = 'FAILED'
        UNION ALL SELECT 'disclosures', count(*) FROM disclosure_events WHERE send_status = 'SENT'""",
    "domains",
    "findings",
    "scan_jobs",
    "disclosure_events",
)
def counts_with_page(spark, sf):
    lists = {
        "domains": predicates.domain_filter(I.domains(spark, sf), status="ACTIVE"),
        "findings": predicates.finding_filter(I.findings(spark, sf), severity="CRITICAL"),
        "jobs": predicates.job_filter(I.scan_jobs(spark, sf), status="FAILED"),
        "disclosures": predicates.disclosure_filter(I.disclosure_events(spark, sf), "SENT"),
    }
    out = None
    for name, df in lists.items():
        row = reports.total_of(df).select(F.lit(name).alias("listing"), "total")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "domain_findings",
    f"""SELECT domain_id, domain, finding_id, {RANK} AS severity_rank, status, CAST({EFFECTIVE} AS DECIMAL(4,3)) AS confidence
        FROM findings JOIN (SELECT domain_id, domain FROM domains) USING (domain_id)""",
    "domains",
    "findings",
)
def domain_findings(spark, sf):
    rows = reports.domain_findings(I.findings(spark, sf), I.domains(spark, sf))
    return rows.select("domain_id", "domain", "finding_id", "severity_rank", "status", "confidence")


@query(
    "domain_detail",
    """WITH c AS (SELECT domain_id, count(*) AS n_findings, count(*) FILTER (severity = 'CRITICAL') AS n_critical,
         count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium,
         count(*) FILTER (severity = 'LOW') AS n_low, count(*) FILTER (severity = 'INFO') AS n_info FROM findings GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at DESC NULLS FIRST, job_id) AS rn FROM scan_jobs),
       j AS (SELECT domain_id, string_agg(job_id || ':' || status, ',' ORDER BY rn) AS jobs FROM r WHERE rn <= 10 GROUP BY 1)
       SELECT domain_id, domain, coalesce(n_findings, 0) AS n_findings, coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
         coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low, coalesce(n_info, 0) AS n_info, coalesce(jobs, '') AS jobs
       FROM domains LEFT JOIN c USING (domain_id) LEFT JOIN j USING (domain_id)""",
    "domains",
    "findings",
    "scan_jobs",
)
def domain_detail(spark, sf):
    rows = reports.domain_overview(I.domains(spark, sf), I.findings(spark, sf), I.scan_jobs(spark, sf))
    line = F.transform("recent_jobs", lambda j: F.concat(j["job_id"].cast("string"), F.lit(":"), j["status"]))
    return rows.select(
        "domain_id", "domain", "n_findings", "n_critical", "n_high", "n_medium", "n_low", "n_info",
        F.coalesce(F.array_join(line, ","), F.lit("")).alias("jobs"),
    )


# -- scalars on the ledger -------------------------------------------------


@query("case_id", "SELECT domain_id, upper(substr(sha256(domain), 1, 12)) AS case_id FROM domains", "domains")
def case_id(spark, sf):
    return I.domains(spark, sf).select("domain_id", text.case_id(F.col("domain")).alias("case_id"))


@query("sla_due", f"SELECT finding_id, {sql_ts(f'created_at + to_hours({SLA})')} AS due FROM findings", "findings")
def sla_due(spark, sf):
    return I.findings(spark, sf).select("finding_id", ts(text.sla_due(F.col("created_at"), F.col("severity"))).alias("due"))


@query(
    "confidence_effective",
    f"""SELECT finding_id, CAST(coalesce(nullif(CASE WHEN finding_id % 3 = 0 THEN 0 ELSE final_confidence END, 0), heuristic_confidence, 0) AS DECIMAL(4,3)) AS confidence FROM findings""",
    "findings",
)
def confidence_effective(spark, sf):
    final = F.when(F.col("finding_id") % 3 == 0, F.lit(0).cast(CONFIDENCE)).otherwise(F.col("final_confidence"))
    return I.findings(spark, sf).select(
        "finding_id", text.effective_confidence(final, F.col("heuristic_confidence")).cast(CONFIDENCE).alias("confidence")
    )


@query(
    "next_scan",
    f"""SELECT domain_id, {sql_ts(f"{NOW} + to_days(CASE WHEN sector IN ('GOVERNMENT','EDUCATION') THEN 7 ELSE 30 END)")} AS next_scan FROM domains""",
    "domains",
)
def next_scan(spark, sf):
    return I.domains(spark, sf).select("domain_id", ts(text.next_scan_at(as_of_column(AS_OF), F.col("sector"))).alias("next_scan"))


@query(
    "domain_normalise",
    """SELECT domain_id, rtrim(replace(replace(lower(trim('  HTTPS://' || upper(domain) || '//  ')), 'https://', ''), 'http://', ''), '/') AS name FROM domains""",
    "domains",
)
def domain_normalise(spark, sf):
    messy = F.concat(F.lit("  HTTPS://"), F.upper("domain"), F.lit("//  "))
    return I.domains(spark, sf).select("domain_id", text.normalise_domain(messy).alias("name"))


@query(
    "notes_merge",
    """SELECT domain_id, coalesce(CASE WHEN json_valid(notes) THEN notes ->> '$.owner' END, 'none') AS owner,
       CAST(iocs_score AS INTEGER) AS risk_score, tld AS zone FROM domains""",
    "domains",
)
def notes_merge(spark, sf):
    update = F.to_json(F.struct(F.col("iocs_score").alias("risk_score"), F.col("tld").alias("zone")))
    merged = I.domains(spark, sf).withColumn("m", text.merge_notes(F.col("notes"), update))
    return merged.select(
        "domain_id",
        F.coalesce(F.get_json_object("m", "$.owner"), F.lit("none")).alias("owner"),
        text.note_int(F.col("m"), "risk_score").alias("risk_score"),
        F.get_json_object("m", "$.zone").alias("zone"),
    )


@query(
    "note_fields",
    """SELECT id, coalesce(TRY_CAST(details ->> '$.k' AS INTEGER), 0) AS k, coalesce(TRY_CAST(details ->> '$.missing' AS INTEGER), 0) AS missing FROM audit_logs""",
    "audit_logs",
)
def note_fields(spark, sf):
    return I.audit_logs(spark, sf).select(
        "id", text.note_int(F.col("details"), "k").alias("k"), text.note_int(F.col("details"), "missing").alias("missing")
    )


# -- risk and breach -------------------------------------------------------

_RISK_OPEN = "status IN ('NEW','CONFIRMED','ESCALATED')"
_BREAKDOWN = f"""r AS (SELECT domain_id,
    count(*) FILTER ({_RISK_OPEN} AND severity = 'CRITICAL') AS open_critical, count(*) FILTER ({_RISK_OPEN} AND severity = 'HIGH') AS open_high,
    count(*) FILTER (dark_web_confirmed) AS dark_web_hits, count(*) FILTER (disclosure_sla_due < {NOW} AND {OPEN}) AS sla_breached,
    count(*) FILTER ({_RISK_OPEN} AND dark_web_confirmed) AS open_dark_web, count(*) FILTER ({_RISK_OPEN} AND disclosure_sla_due < {NOW}) AS open_overdue
    FROM findings GROUP BY domain_id)"""
_RISK = f"""{_BREAKDOWN}, s AS (SELECT d.*, coalesce(open_critical, 0) AS open_critical, coalesce(open_high, 0) AS open_high,
    coalesce(dark_web_hits, 0) AS dark_web_hits, coalesce(sla_breached, 0) AS sla_breached,
    least(100, CAST(trunc((least(iocs_score / CAST(4 AS DOUBLE), 25) + least(15 * coalesce(open_critical, 0), 30) + least(8 * coalesce(open_high, 0), 24)
      + least(10 * coalesce(open_dark_web, 0), 20) + least(5 * coalesce(open_overdue, 0), 10))
      * CAST(CASE WHEN vendor_fingerprint ILIKE '%wordpress%' OR vendor_fingerprint ILIKE '%joomla%' THEN 1.3
             WHEN vendor_fingerprint ILIKE '%nic-egov%' THEN 1.2
             WHEN vendor_fingerprint ILIKE '%drupal%' OR vendor_fingerprint ILIKE '%spring-boot%' THEN 1.1 ELSE 1.0 END AS DOUBLE)
      * CAST(CASE sector WHEN 'GOVERNMENT' THEN 1.5 WHEN 'HEALTHCARE' THEN 1.4 WHEN 'FINANCE' THEN 1.4 WHEN 'RESEARCH' THEN 1.2 WHEN 'EDUCATION' THEN 1.1 ELSE 1.0 END AS DOUBLE)) AS INTEGER)) AS risk_score
    FROM domains d LEFT JOIN r USING (domain_id) WHERE d.status = 'ACTIVE')"""


@query(
    "risk_breakdown",
    f"WITH {_BREAKDOWN} SELECT domain_id, open_critical, open_high, dark_web_hits, sla_breached FROM r",
    "findings",
)
def risk_breakdown(spark, sf):
    rows = risk.risk_breakdown(I.findings(spark, sf), AS_OF)
    return rows.select("domain_id", "open_critical", "open_high", "dark_web_hits", "sla_breached")


@query(
    "risk_scores",
    f"WITH {_RISK} SELECT domain_id, risk_score, open_critical, open_high, dark_web_hits, sla_breached FROM s",
    "domains",
    "findings",
)
def risk_scores(spark, sf):
    rows = risk.risk_scores(I.domains(spark, sf), I.findings(spark, sf), AS_OF)
    return rows.select("domain_id", "risk_score", "open_critical", "open_high", "dark_web_hits", "sla_breached")


@query(
    "risk_overview",
    f"""WITH {_RISK} SELECT domain_id, domain, sector, risk_score, open_critical, open_high, dark_web_hits, sla_breached,
        '2026-01-01T00:00:00+00:00' AS last_scored_at FROM s ORDER BY risk_score DESC, domain_id LIMIT 100""",
    "domains",
    "findings",
)
def risk_overview(spark, sf):
    scored = risk.risk_scores(I.domains(spark, sf), I.findings(spark, sf), AS_OF)
    rows = reports.risk_overview(risk.with_risk_notes(scored, AS_OF))
    return rows.select(
        "domain_id", "domain", "sector", "risk_score", "open_critical", "open_high", "dark_web_hits", "sla_breached", "last_scored_at"
    )


@query(
    "breach_feed",
    """WITH e AS (SELECT domain, unnest(json_keys(payload)) AS k, payload FROM breaches)
       SELECT domain, count(*) AS breach_count,
       CAST(sum(CASE WHEN json_type(payload, '$.' || k) = 'ARRAY' THEN json_array_length(payload, '$.' || k) ELSE 1 END) AS BIGINT) AS account_count
       FROM e GROUP BY domain""",
    "breaches",
)
def breach_feed(spark, sf):
    return lookups.breach_counts(I.breaches(spark, sf))


@query(
    "host_vulns",
    """SELECT ip, array_to_string(open_ports, ',') AS ports, CAST(len(vulns) AS INTEGER) AS vuln_count, array_to_string(vulns, ',') AS vulns, org FROM host_vulns""",
    "host_vulns",
)
def host_vulns(spark, sf):
    return lookups.host_vulnerabilities(I.host_vulns(spark, sf)).select(
        "ip", F.array_join("open_ports", ",").alias("ports"), "vuln_count", F.array_join("vulns", ",").alias("vulns"), "org"
    )


_EVIDENCE = """bc AS (SELECT domain, CAST(sum(len(json_keys(payload))) AS BIGINT) AS breach_count FROM breaches GROUP BY domain),
    vc AS (SELECT ip, max(len(vulns)) AS vuln_count FROM host_vulns GROUP BY ip HAVING max(len(vulns)) > 0),
    ev AS (SELECT domain_id,
       CASE WHEN breach_count IS NOT NULL THEN '[BREACH CORRELATION HIBP @ 2026-01-01] breach_count=' || breach_count || ' vuln_count=?' END AS breach_note,
       CASE WHEN vuln_count IS NOT NULL THEN '[BREACH CORRELATION SHODAN @ 2026-01-01] breach_count=? vuln_count=' || vuln_count END AS vuln_note
       FROM domains d LEFT JOIN bc USING (domain) LEFT JOIN vc ON vc.ip = d.ip_address
       WHERE status = 'ACTIVE' AND (breach_count IS NOT NULL OR vuln_count IS NOT NULL))"""


@query(
    "breach_marking",
    f"""WITH {_EVIDENCE}, m AS (SELECT f.*, breach_note, vuln_note,
          (breach_note IS NOT NULL OR vuln_note IS NOT NULL) AND severity IN ('CRITICAL','HIGH') AND {OPEN} AS hit
          FROM findings f LEFT JOIN ev USING (domain_id))
        SELECT finding_id, dark_web_confirmed OR hit AS dark_web_confirmed,
          CASE WHEN hit THEN greatest(escalation_level, 1) ELSE escalation_level END AS escalation_level,
          coalesce(CASE WHEN hit THEN concat_ws(chr(10), context_snippet_safe, breach_note, vuln_note) ELSE context_snippet_safe END, '') AS context
        FROM m""",
    "domains",
    "findings",
    "breaches",
    "host_vulns",
)
def breach_marking(spark, sf):
    evidence = risk.breach_evidence(I.domains(spark, sf), I.breaches(spark, sf), I.host_vulns(spark, sf), AS_OF)
    marked = risk.mark_breached(I.findings(spark, sf), evidence)
    return marked.select(
        "finding_id", "dark_web_confirmed", "escalation_level", F.coalesce("context_snippet_safe", F.lit("")).alias("context")
    )


@query(
    "breach_counters",
    f"""WITH {_EVIDENCE} SELECT (SELECT count(*) FROM domains WHERE status = 'ACTIVE') AS checked, (SELECT count(*) FROM ev) AS breached""",
    "domains",
    "breaches",
    "host_vulns",
)
def breach_counters(spark, sf):
    d = I.domains(spark, sf)
    evidence = risk.breach_evidence(d, I.breaches(spark, sf), I.host_vulns(spark, sf), AS_OF)
    return risk.breach_counters(d, evidence)


# -- vendor correlation ----------------------------------------------------

_KNOWN = """k AS (SELECT f.*, d.vendor_fingerprint AS vendor FROM findings f LEFT JOIN domains d USING (domain_id)),
    risky AS (SELECT * FROM k WHERE vendor IS NOT NULL AND vendor <> '' AND severity IN ('CRITICAL','HIGH') AND status NOT IN ('RESOLVED','FALSE_POSITIVE'))"""
_TEMPLATES = f"""{_KNOWN}, t AS (SELECT vendor, severity, finding_type FROM (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY {RANK}, finding_id) AS rn FROM risky) WHERE rn = 1)"""


@query("risky_vendors", f"WITH {_KNOWN} SELECT DISTINCT vendor FROM risky", "domains", "findings")
def risky_vendors(spark, sf):
    known = correlation.with_domain_vendor(I.findings(spark, sf), I.domains(spark, sf))
    return correlation.risky_findings(known).select(F.col("vendor_fingerprint").alias("vendor")).distinct()


@query("vendor_representative", f"WITH {_TEMPLATES} SELECT vendor, severity, finding_type FROM t", "domains", "findings")
def vendor_representative(spark, sf):
    return correlation.vendor_representatives(I.findings(spark, sf), I.domains(spark, sf))


@query(
    "vendor_correlation",
    f"""WITH {_TEMPLATES} SELECT d.domain_id, t.vendor, 'https://' || d.domain || '/' AS url, 'HIGH' AS severity, CAST(0.75 AS DECIMAL(4,3)) AS confidence,
        '[VENDOR CORRELATION] ' || t.vendor || ' runs on this domain. A ' || t.severity || ' ' || t.finding_type ||
        ' was found on another domain with the same software. Check this domain for it.' AS context
        FROM t JOIN domains d ON contains(lower(d.vendor_fingerprint), lower(split_part(t.vendor, ' ', 1))) WHERE d.status = 'ACTIVE'""",
    "domains",
    "findings",
)
def vendor_correlation(spark, sf):
    rows = correlation.correlate_vendors(I.domains(spark, sf), I.findings(spark, sf), AS_OF)
    return rows.select(
        "domain_id", F.col("vendor_fingerprint").alias("vendor"), "url", "severity",
        F.col("final_confidence").alias("confidence"), F.col("context_snippet_safe").alias("context"),
    )


_WORDS = f"""{_TEMPLATES}, w AS (SELECT lower(split_part(vendor, ' ', 1)) AS word, count(*) AS vendors,
      min_by(vendor, {RANK} || vendor) AS vendor, min_by(severity, {RANK} || vendor) AS severity, min_by(finding_type, {RANK} || vendor) AS finding_type FROM t GROUP BY 1)"""


@query(
    "vendor_word_correlation",
    f"""WITH {_WORDS} SELECT sha256(d.domain_id || '|https://' || d.domain || '/|VENDOR_CORRELATION|' || word) AS finding_id, d.domain_id, word, vendor, vendors,
        '[VENDOR CORRELATION] ' || vendor || CASE WHEN vendors > 1 THEN ' and ' || (vendors - 1) || ' more with its name' ELSE '' END || ' at risk elsewhere. A ' ||
        severity || ' ' || finding_type || ' was found on another domain with this software. Check this domain for it.' AS context
        FROM w JOIN domains d ON contains(lower(d.vendor_fingerprint), word) WHERE d.status = 'ACTIVE'""",
    "domains",
    "findings",
)
def vendor_word_correlation(spark, sf):
    """One finding for each domain and vendor word, with the number of vendors behind it."""
    rows = correlation.correlate_vendor_words(I.domains(spark, sf), I.findings(spark, sf), AS_OF)
    return rows.select(
        "finding_id", "domain_id", F.col("vendor_word").alias("word"), F.col("vendor_fingerprint").alias("vendor"), "vendors",
        F.col("context_snippet_safe").alias("context"),
    )


@query(
    "vendor_word_index",
    f"""WITH {_WORDS} SELECT vendor_fingerprint, string_agg(word, ',' ORDER BY word) AS words
        FROM (SELECT DISTINCT vendor_fingerprint FROM domains WHERE status = 'ACTIVE') d JOIN w ON contains(lower(d.vendor_fingerprint), word) GROUP BY 1""",
    "domains",
    "findings",
)
def vendor_word_index(spark, sf):
    d = I.domains(spark, sf)
    words = correlation.vendor_words(correlation.vendor_representatives(I.findings(spark, sf), d))
    index = correlation.fingerprint_words(words, d.filter("status = 'ACTIVE'"))
    return index.select("vendor_fingerprint", F.array_join("words", ",").alias("words"))


# -- disclosure ------------------------------------------------------------

_QUEUE = f"q AS (SELECT * FROM findings WHERE disclosed_at IS NULL AND {OPEN} AND (severity = 'CRITICAL' OR disclosure_sla_due <= {NOW} + to_hours(24)))"
_ESCALATE = f"""q AS (SELECT * FROM findings WHERE (severity = 'CRITICAL' AND status = 'DISCLOSED' AND acknowledged_at IS NULL AND disclosed_at < {NOW} - to_hours(72))
    OR (dark_web_confirmed AND severity IN ('CRITICAL','HIGH') AND escalation_level < 3 AND {OPEN}))"""


def _summary(lines: int) -> str:
    return f"""o AS (SELECT *, {RANK} AS rank, row_number() OVER (PARTITION BY domain_id ORDER BY {RANK}, finding_id) AS rn FROM q),
    l AS (SELECT domain_id, string_agg('  ' || rn || '. [' || severity || '] ' || finding_type || ' @ ' || url_path || ' (confidence=' ||
          CAST(CAST({EFFECTIVE} * 100 AS INTEGER) AS VARCHAR) || '%)', chr(10) ORDER BY rn) AS lines_text FROM o WHERE rn <= {lines} GROUP BY 1),
    ty AS (SELECT domain_id, string_agg(finding_type, ', ' ORDER BY n) AS types_text FROM
          (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY first) AS n FROM (SELECT domain_id, finding_type, min(rn) AS first FROM o GROUP BY 1, 2)) WHERE n <= 5 GROUP BY 1),
    sv AS (SELECT domain_id, string_agg(c || ' ' || severity, ', ' ORDER BY rank) AS severity_text FROM (SELECT domain_id, severity, rank, count(*) AS c FROM o GROUP BY 1, 2, 3) GROUP BY 1),
    a AS (SELECT domain_id, count(*) AS n_findings, min_by(severity, rank) AS top_severity, count(*) FILTER (disclosure_sla_due < {NOW}) AS n_overdue,
          min_by(finding_id, rn) AS first_finding_id, bool_or(dark_web_confirmed) AS any_dark_web FROM o GROUP BY 1)"""


@query("disclosure_queue", f"WITH {_QUEUE} SELECT finding_id, domain_id, severity FROM q", "findings")
def disclosure_queue(spark, sf):
    return disclosure.disclosure_queue(I.findings(spark, sf), AS_OF).select("finding_id", "domain_id", "severity")


@query(
    "waiting_by_domain",
    f"WITH {_QUEUE} SELECT domain_id, count(*) AS n_waiting FROM q GROUP BY domain_id",
    "findings",
)
def waiting_by_domain(spark, sf):
    return reports.waiting_by_domain(I.findings(spark, sf), AS_OF)


@query("escalation_queue", f"WITH {_ESCALATE} SELECT finding_id, domain_id, severity FROM q", "findings")
def escalation_queue(spark, sf):
    return disclosure.escalation_queue(I.findings(spark, sf), AS_OF).select("finding_id", "domain_id", "severity")


@query(
    "domain_summary_text",
    f"""WITH {_QUEUE}, {_summary(5)} SELECT domain_id, n_findings, top_severity, severity_text, types_text, lines_text, first_finding_id,
        CASE WHEN n_overdue > 0 THEN 'BREACHED (' || n_overdue || ' overdue)' ELSE 'Within SLA' END AS sla
        FROM a JOIN l USING (domain_id) JOIN ty USING (domain_id) JOIN sv USING (domain_id)""",
    "findings",
)
def domain_summary_text(spark, sf):
    rows = disclosure.batch_summary(disclosure.disclosure_queue(I.findings(spark, sf), AS_OF), AS_OF)
    return rows.select(
        "domain_id", "n_findings", "top_severity", "severity_text", "types_text", "lines_text", "first_finding_id",
        text.sla_summary(F.col("n_overdue")).alias("sla"),
    )


def _contacts(spark, sf):
    d = I.domains(spark, sf)
    found = names.security_contacts(d, I.contact_files(spark, sf))
    return disclosure.stored_or_found(d, found)


_EMAILS = r"""pf AS (SELECT domain, priority, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(body, '\r\n|\n|\r'), lambda x: trim(x)),
      lambda x: starts_with(lower(x), 'contact:')),
      lambda x: CASE WHEN starts_with(lower(trim(substr(x, 9))), 'mailto:') THEN trim(substr(trim(substr(x, 9)), 8)) ELSE trim(substr(x, 9)) END),
      lambda v: regexp_matches(v, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AND NOT contains(v, '://')) AS emails
      FROM contact_files WHERE status = 200),
    fe AS (SELECT domain, min_by(emails, priority) AS emails FROM pf WHERE len(emails) > 0 GROUP BY 1),
    ct AS (SELECT d.domain, coalesce(emails[1], 'security@' || d.domain) AS email, CASE WHEN emails IS NULL THEN 'convention' ELSE 'security.txt' END AS source,
       list_concat(coalesce(emails, []), list_filter(['security@' || d.domain, 'abuse@' || d.domain, 'cert@' || d.domain, 'webmaster@' || d.domain],
         lambda m: NOT list_contains(coalesce(emails, []), m))) AS candidates FROM domains d LEFT JOIN fe USING (domain)),
    dc AS (SELECT d.* EXCLUDE (contact_email), coalesce(contact_email, email) AS contact_email, CASE WHEN contact_email IS NOT NULL THEN 'stored' ELSE source END AS contact_source
       FROM domains d LEFT JOIN ct USING (domain))"""


@query(
    "contact_parse",
    f"WITH {_EMAILS} SELECT domain, email, source, array_to_string(candidates, ',') AS candidates FROM ct",
    "domains",
    "contact_files",
)
def contact_parse(spark, sf):
    rows = names.security_contacts(I.domains(spark, sf), I.contact_files(spark, sf))
    return rows.select("domain", "email", "source", F.array_join("candidates", ",").alias("candidates"))


@query(
    "discovered_contacts",
    f"WITH {_EMAILS} SELECT d.domain_id, ct.email AS contact_email, ct.source AS contact_source FROM domains d JOIN ct USING (domain) WHERE d.contact_email IS NULL",
    "domains",
    "contact_files",
)
def discovered_contacts(spark, sf):
    d = I.domains(spark, sf)
    rows = transitions.discover_contacts(d, names.security_contacts(d, I.contact_files(spark, sf)))
    return rows.select("domain_id", "contact_email", "contact_source")


_SUBJECT = "'[Exposure Desk] Security disclosure: ' || domain || ' - ' || top_severity || ' | CVD-' || upper(substr(sha256(domain), 1, 12))"
_GOV = "(domain LIKE '%.gov.in' OR domain LIKE '%.nic.in')"
_NOTICES = f"""n AS (SELECT domain_id, domain, contact_email AS recipient_email, CASE WHEN {_GOV} THEN '{I.GOVERNMENT_TEAM}' END AS cc_email, contact_source,
    n_findings, first_finding_id, severity_text, types_text, lines_text, sha256('workload-salt|' || domain_id || '|2026-01-01 00:00:00') AS ack_token, {_SUBJECT} AS subject
    FROM a JOIN l USING (domain_id) JOIN ty USING (domain_id) JOIN sv USING (domain_id) JOIN dc USING (domain_id))"""


@query(
    "disclosure_plan",
    f"""WITH {_EMAILS}, {_QUEUE}, {_summary(5)}, {_NOTICES},
        e AS (SELECT q.finding_id, n.subject, n.recipient_email, 'PRIMARY' AS recipient_type, CASE WHEN q.finding_id = n.first_finding_id THEN n.ack_token END AS ack_token FROM q JOIN n USING (domain_id)
              UNION ALL SELECT q.finding_id, n.subject, n.cc_email, 'CC_NIC', NULL FROM q JOIN n USING (domain_id) WHERE n.cc_email IS NOT NULL)
        SELECT finding_id, subject, recipient_email, recipient_type, coalesce(ack_token, '') AS ack_token FROM e""",
    "domains",
    "findings",
    "contact_files",
)
def disclosure_plan(spark, sf):
    plan = disclosure.disclosure_plan(I.findings(spark, sf), _contacts(spark, sf), SETTINGS, AS_OF)
    return plan.events.select(
        "finding_id", "subject", "recipient_email", "recipient_type", F.coalesce("ack_token", F.lit("")).alias("ack_token")
    )


@query(
    "notice_text",
    f"""WITH {_EMAILS}, {_QUEUE}, {_summary(5)}, {_NOTICES}
        SELECT domain_id, subject, concat_ws(chr(10), 'Security disclosure notice', '', 'Exposures were found on ' || domain || '.',
          CASE WHEN contact_source <> 'stored' THEN 'Contact found via ' || contact_source || '.' END,
          CASE WHEN {_GOV} THEN 'Copied to the government response team ({I.GOVERNMENT_TEAM}).' END, '',
          'Severity        : ' || severity_text, 'Types           : ' || types_text, '',
          'Findings (no credential or personal value is included):', lines_text, '',
          'Please acknowledge within 48 hours, send a remediation timeline, and tell us when it is fixed.',
          'A CRITICAL finding without acknowledgement after 72 hours may go to the national response team.', '',
          'Reference       : CVD-' || upper(substr(sha256(domain), 1, 12)), 'Date            : 2026-01-01',
          'Acknowledge     : https://localhost/api/ack/' || ack_token) AS body FROM n""",
    "domains",
    "findings",
    "contact_files",
)
def notice_text(spark, sf):
    plan = disclosure.disclosure_plan(I.findings(spark, sf), _contacts(spark, sf), SETTINGS, AS_OF)
    return plan.notices.select("domain_id", "subject", "body")


@query(
    "escalation_plan",
    f"""WITH {_ESCALATE}, {_summary(10)} SELECT domain_id, '{I.NATIONAL_TEAM}' AS recipient_email, n_findings, types_text AS triggers, {_SUBJECT} AS subject,
        concat_ws(chr(10), 'Incident report', '', 'Domain          : ' || domain, 'Sector          : ' || coalesce(sector, 'UNKNOWN'),
          'IP address      : ' || ip_address, 'Origin score    : ' || iocs_score, 'Vendor          : ' || coalesce(vendor_fingerprint, 'N/A'),
          'Contact         : ' || coalesce(contact_email, 'Not found'), '', 'Findings        : ' || n_findings, 'Severity        : ' || severity_text,
          'Types           : ' || types_text, 'Dark web        : ' || CASE WHEN any_dark_web THEN 'YES' ELSE 'NO' END,
          'SLA             : ' || CASE WHEN n_overdue > 0 THEN 'BREACHED (' || n_overdue || ' overdue)' ELSE 'Within SLA' END, '',
          'Affected paths (no credential or personal value is included):', lines_text, '',
          'Reference       : CVD-' || upper(substr(sha256(domain), 1, 12)), 'Date            : 2026-01-01') AS body
        FROM a JOIN l USING (domain_id) JOIN ty USING (domain_id) JOIN sv USING (domain_id) JOIN domains USING (domain_id)""",
    "domains",
    "findings",
)
def escalation_plan(spark, sf):
    plan = disclosure.escalation_plan(I.findings(spark, sf), I.domains(spark, sf), SETTINGS, AS_OF)
    return plan.notices.select("domain_id", "recipient_email", "n_findings", "triggers", "subject", "body")


@query(
    "escalated_findings",
    f"""WITH {_ESCALATE}, d AS (SELECT domain_id FROM domains)
        SELECT finding_id, 3 AS escalation_level, 'ESCALATED' AS status FROM q SEMI JOIN d USING (domain_id)""",
    "domains",
    "findings",
)
def escalated_findings(spark, sf):
    plan = disclosure.escalation_plan(I.findings(spark, sf), I.domains(spark, sf), SETTINGS, AS_OF)
    return plan.findings.select("finding_id", "escalation_level", "status")


@query(
    "escalation_audit",
    f"""WITH {_ESCALATE}, ty AS (SELECT domain_id, finding_type, count(*) AS n, min({RANK} || '|' || lpad(CAST(finding_id AS VARCHAR), 20, '0')) AS first FROM q GROUP BY 1, 2)
        SELECT CAST(domain_id AS VARCHAR) AS target_id, string_agg(finding_type, ',' ORDER BY first) AS triggers, CAST(sum(n) AS INTEGER) AS findings
        FROM ty SEMI JOIN domains USING (domain_id) GROUP BY 1""",
    "domains",
    "findings",
)
def escalation_audit(spark, sf):
    """The audit names every type that was escalated, however many."""
    plan = disclosure.escalation_plan(I.findings(spark, sf), I.domains(spark, sf), SETTINGS, AS_OF)
    details = F.from_json("details", "domain string, findings int, triggers array<string>")
    return plan.audit.select("target_id", F.array_join(details["triggers"], ",").alias("triggers"), details["findings"].alias("findings"))


# -- acknowledgements and reviews ------------------------------------------


def _acks(spark, sf):
    """Acknowledgements of two events in five, one of them twice."""
    tokens = I.disclosure_events(spark, sf).selectExpr("ack_token", "finding_id")
    used = tokens.filter("finding_id % 5 < 2").select("ack_token")
    return used.unionByName(tokens.filter("finding_id % 5 = 0").select("ack_token"))


@query(
    "ack_apply",
    f"""SELECT event_id, finding_id, {sql_ts(f"coalesce(acknowledged_at, {NOW})")} AS acknowledged_at, acknowledged_at IS NOT NULL AS was_acknowledged
        FROM disclosure_events WHERE finding_id % 5 < 2""",
    "disclosure_events",
)
def ack_apply(spark, sf):
    rows = transitions.acknowledge_events(I.disclosure_events(spark, sf), _acks(spark, sf), AS_OF)
    return rows.select("event_id", "finding_id", ts("acknowledged_at").alias("acknowledged_at"), "was_acknowledged")


@query(
    "ack_findings",
    f"""SELECT finding_id, '2026-01-01 00:00:00' AS acknowledged_at FROM disclosure_events WHERE finding_id % 5 < 2 AND disclosure_events.acknowledged_at IS NULL""",
    "disclosure_events",
)
def ack_findings(spark, sf):
    acknowledged = transitions.acknowledge_events(I.disclosure_events(spark, sf), _acks(spark, sf), AS_OF)
    rows = transitions.acknowledge_findings(I.findings(spark, sf), acknowledged)
    return rows.select("finding_id", ts("acknowledged_at").alias("acknowledged_at"))


@query(
    "ack_chain",
    """SELECT e.ack_token, e.event_id, f.finding_id, f.finding_type, d.domain FROM disclosure_events e
       JOIN findings f USING (finding_id) JOIN domains d USING (domain_id)""",
    "domains",
    "findings",
    "disclosure_events",
)
def ack_chain(spark, sf):
    return transitions.ack_chain(I.disclosure_events(spark, sf), I.findings(spark, sf), I.domains(spark, sf))


def _changes(spark, sf):
    """One review per finding, some of them not allowed."""
    return I.findings(spark, sf).selectExpr(
        "finding_id",
        f"{I.pick('finding_id', repr('confirmed'), repr('FALSE_POSITIVE'), repr('RESOLVED'), repr('escalated'), repr('CLOSED'))} AS new_status",
        f"{I.pick('finding_id', 'NULL', repr('low'), 'NULL', repr('URGENT'))} AS new_severity",
        "concat('reason ', finding_id) AS reason",
        "CASE WHEN finding_id % 2 = 0 THEN 'analyst-a' END AS analyst",
    )


_CHANGES = """ch AS (SELECT finding_id, upper(['confirmed','FALSE_POSITIVE','RESOLVED','escalated','CLOSED'][finding_id % 5 + 1]) AS s,
    upper([NULL,'low',NULL,'URGENT'][finding_id % 4 + 1]) AS v, 'reason ' || finding_id AS reason, coalesce(CASE WHEN finding_id % 2 = 0 THEN 'analyst-a' END, 'ANALYST') AS who FROM findings)"""


@query(
    "status_transition",
    f"""WITH {_CHANGES} SELECT f.finding_id, ch.s AS status, coalesce(ch.v, f.severity) AS severity,
        {sql_ts(f"CASE WHEN ch.v IS NOT NULL THEN {NOW} + to_hours(720) ELSE f.disclosure_sla_due END")} AS sla, ch.who AS reviewed_by,
        CASE WHEN ch.s = 'FALSE_POSITIVE' THEN ch.reason ELSE '' END AS fp_reason, ch.s = 'RESOLVED' AS resolved
        FROM findings f JOIN ch USING (finding_id) WHERE ch.s IN ('CONFIRMED','FALSE_POSITIVE','RESOLVED','ESCALATED') AND (ch.v IS NULL OR ch.v = 'LOW')""",
    "findings",
)
def status_transition(spark, sf):
    rows = transitions.apply_reviews(I.findings(spark, sf), _changes(spark, sf), AS_OF)
    return rows.select(
        "finding_id", "status", "severity", ts("disclosure_sla_due").alias("sla"), "reviewed_by",
        F.coalesce("false_positive_reason", F.lit("")).alias("fp_reason"), F.col("resolved_at").isNotNull().alias("resolved"),
    )


def _sequence(spark, sf):
    """Two reviews per finding; for each seventh the one of ``_changes`` comes last, else first."""
    first = _changes(spark, sf).selectExpr("*", "CASE WHEN finding_id % 7 = 0 THEN 3 ELSE 1 END AS sequence")
    second = I.findings(spark, sf).selectExpr(
        "finding_id", "CASE WHEN finding_id % 2 = 0 THEN 'RESOLVED' ELSE 'CONFIRMED' END AS new_status",
        "CASE WHEN finding_id % 3 = 0 THEN 'critical' END AS new_severity", "concat('second ', finding_id) AS reason",
        "'analyst-b' AS analyst", "2 AS sequence",
    )
    return first.unionByName(second).withColumn("changed_at", F.expr(I.NOW))


_SEQUENCE = f"""{_CHANGES}, sq AS (SELECT * FROM (
      SELECT *, CASE WHEN finding_id % 7 = 0 THEN 3 ELSE 1 END AS nr FROM ch
      UNION ALL SELECT finding_id, CASE WHEN finding_id % 2 = 0 THEN 'RESOLVED' ELSE 'CONFIRMED' END, CASE WHEN finding_id % 3 = 0 THEN 'CRITICAL' END,
        'second ' || finding_id, 'analyst-b', 2 FROM findings)
    WHERE s IN ('CONFIRMED','FALSE_POSITIVE','RESOLVED','ESCALATED') AND (v IS NULL OR v IN ('LOW', 'CRITICAL')))"""


@query(
    "review_sequence",
    f"""WITH {_SEQUENCE}, l AS (SELECT finding_id, arg_max(s, nr) AS s, arg_max(who, nr) AS who, arg_max(v, nr) FILTER (v IS NOT NULL) AS v,
          arg_max(reason, nr) FILTER (s = 'FALSE_POSITIVE') AS fp, bool_or(s = 'RESOLVED') AS resolved FROM sq GROUP BY 1)
        SELECT finding_id, s AS status, coalesce(v, severity) AS severity, who AS reviewed_by, coalesce(fp, '') AS fp_reason, resolved
        FROM findings JOIN l USING (finding_id)""",
    "findings",
)
def review_sequence(spark, sf):
    rows = transitions.apply_reviews(I.findings(spark, sf), _sequence(spark, sf), AS_OF)
    return rows.select(
        "finding_id", "status", "severity", "reviewed_by",
        F.coalesce("false_positive_reason", F.lit("")).alias("fp_reason"), F.col("resolved_at").isNotNull().alias("resolved"),
    )


@query(
    "audit_review_sequence",
    f"""WITH {_SEQUENCE}, o AS (SELECT sq.*, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY finding_id ORDER BY nr
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), severity) AS old_severity FROM sq JOIN findings f USING (finding_id))
        SELECT CAST(finding_id AS VARCHAR) AS target_id, who AS actor, CAST(json_object('new_status', s, 'old_severity', old_severity,
          'new_severity', coalesce(v, old_severity), 'reason', reason) AS VARCHAR) AS details FROM o""",
    "findings",
)
def audit_review_sequence(spark, sf):
    steps = transitions.review_steps(I.findings(spark, sf), _sequence(spark, sf))
    return transitions.audit_reviews(steps, AS_OF).select("target_id", "actor", "details")


@query(
    "quarantine",
    f"""WITH {_CHANGES} SELECT finding_id, s AS status FROM ch WHERE s NOT IN ('CONFIRMED','FALSE_POSITIVE','RESOLVED','ESCALATED') OR v NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO')""",
    "findings",
)
def quarantine(spark, sf):
    _, bad = transitions.split_reviews(_changes(spark, sf))
    return bad.select("finding_id", F.upper("new_status").alias("status"))


@query(
    "audit_from_changes",
    f"""WITH {_CHANGES} SELECT CAST(f.finding_id AS VARCHAR) AS target_id, 'FINDING_STATUS_UPDATED' AS event_type, ch.who AS actor,
        CAST(json_object('new_status', ch.s, 'old_severity', f.severity, 'new_severity', coalesce(ch.v, f.severity), 'reason', ch.reason) AS VARCHAR) AS details
        FROM findings f JOIN ch USING (finding_id) WHERE ch.s IN ('CONFIRMED','FALSE_POSITIVE','RESOLVED','ESCALATED') AND (ch.v IS NULL OR ch.v = 'LOW')""",
    "findings",
)
def audit_from_changes(spark, sf):
    reviewed = transitions.apply_reviews(I.findings(spark, sf), _changes(spark, sf), AS_OF)
    return transitions.audit_reviews(reviewed, AS_OF).select("target_id", "event_type", "actor", "details")


# -- rescans, bookkeeping, contacts ----------------------------------------


@query(
    "rescan_eligible",
    """SELECT j.job_id, j.domain_id, d.status = 'INACTIVE' AS reactivates FROM scan_jobs j JOIN domains d USING (domain_id)
       WHERE j.status IN ('FAILED','SKIPPED','COMPLETED')""",
    "domains",
    "scan_jobs",
)
def rescan_eligible(spark, sf):
    rows = transitions.rescan_eligible(I.scan_jobs(spark, sf), I.domains(spark, sf))
    return rows.select("job_id", "domain_id", "reactivates")


@query(
    "reactivated_domains",
    """SELECT domain_id, CASE WHEN status = 'INACTIVE' AND EXISTS (SELECT 1 FROM scan_jobs j WHERE j.domain_id = d.domain_id AND j.status IN ('FAILED','SKIPPED','COMPLETED'))
       THEN 'ACTIVE' ELSE status END AS status FROM domains d""",
    "domains",
    "scan_jobs",
)
def reactivated_domains(spark, sf):
    d = I.domains(spark, sf)
    return transitions.reactivate(d, transitions.rescan_eligible(I.scan_jobs(spark, sf), d)).select("domain_id", "status")


def _results(spark, sf):
    return I.domains(spark, sf).selectExpr(
        "domain_id",
        "domain_id % 4 <> 0 AS reachable",
        "CASE WHEN domain_id % 10 = 3 THEN 'timeout' END AS error",
        "109 AS urls_checked",
        "CAST(domain_id % 7 AS INT) AS findings_count",
        "CAST(1000 + domain_id % 500 AS INT) AS duration_ms",
    )


_FINISH = """fin AS (SELECT domain_id, domain_id % 10 = 3 AS failed, domain_id % 4 = 0 AND domain_id % 10 <> 3 AS skipped FROM domains)"""


@query(
    "scan_bookkeeping",
    f"""WITH {_FINISH} SELECT domain_id, CASE WHEN failed THEN 'FAILED' WHEN skipped THEN 'SKIPPED' ELSE 'COMPLETED' END AS job_status,
        CASE WHEN failed OR skipped THEN 0 ELSE 109 END AS urls_checked, CASE WHEN failed THEN 'timeout' WHEN skipped THEN 'Domain unreachable' ELSE '' END AS error_message,
        CASE WHEN skipped THEN 'INACTIVE' ELSE status END AS domain_status, scan_count + CASE WHEN failed OR skipped THEN 0 ELSE 1 END AS scan_count,
        {sql_ts(f"CASE WHEN failed OR skipped THEN next_scan_due_at WHEN sector IN ('GOVERNMENT','EDUCATION') THEN {NOW} + to_days(7) ELSE {NOW} + to_days(30) END")} AS next_scan
        FROM domains JOIN fin USING (domain_id)""",
    "domains",
)
def scan_bookkeeping(spark, sf):
    finished = transitions.finish_scans(_results(spark, sf), AS_OF)
    after = transitions.scanned_domains(I.domains(spark, sf), finished, AS_OF)
    job = finished.select("domain_id", F.col("status").alias("job_status"), "urls_checked", F.coalesce("error_message", F.lit("")).alias("error_message"))
    return job.join(
        after.select("domain_id", F.col("status").alias("domain_status"), "scan_count", ts("next_scan_due_at").alias("next_scan")), "domain_id"
    )


@query(
    "set_contact",
    """SELECT domain_id, 'new' || domain_id || '@x.example' AS contact_email, coalesce(contact_email, '') AS old_contact_email FROM domains WHERE contact_email IS NULL OR domain_id % 3 = 0""",
    "domains",
)
def set_contact(spark, sf):
    d = I.domains(spark, sf)
    wanted = d.filter("contact_email IS NULL OR domain_id % 3 = 0").selectExpr("domain_id", "concat('  new', domain_id, '@x.example ') AS email")
    rows = transitions.set_contacts(d, wanted)
    return rows.select("domain_id", "contact_email", F.coalesce("old_contact_email", F.lit("")).alias("old_contact_email"))


# -- saving and deleting ---------------------------------------------------


def _candidates(spark, sf):
    """Candidate findings: the same keys for known findings, new ones for the rest; some repeated, some invalid."""
    rows = I.findings(spark, sf)
    again = rows.selectExpr("domain_id", "url", "finding_type", "severity", "'ENV_FILE' AS entity_type", "heuristic_confidence AS confidence")
    new = rows.selectExpr(
        "domain_id", "concat(url, '/new') AS url", "finding_type", "CASE WHEN finding_id % 17 = 0 THEN 'HUGE' ELSE severity END AS severity",
        "'NO_SUCH' AS entity_type", "heuristic_confidence AS confidence",
    )
    return again.unionByName(new)


_CAND = """c AS (SELECT domain_id, url, finding_type, severity, 'ENV_FILE' AS entity_type, heuristic_confidence AS confidence FROM findings
    UNION ALL SELECT domain_id, url || '/new', finding_type, CASE WHEN finding_id % 17 = 0 THEN 'HUGE' ELSE severity END, 'NO_SUCH', heuristic_confidence FROM findings)"""


@query(
    "finding_dedup",
    f"""WITH {_CAND}, k AS (SELECT domain_id, url, finding_type, max(confidence) AS confidence FROM c
          WHERE severity IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') GROUP BY 1, 2, 3),
          shut AS (SELECT domain_id, url, finding_type, count(*) AS shut_n FROM findings WHERE NOT ({OPEN}) GROUP BY 1, 2, 3),
          kk AS (SELECT k.*, coalesce(shut_n, 0) AS closed FROM k LEFT JOIN shut USING (domain_id, url, finding_type))
        SELECT sha256(domain_id || '|' || url || '|' || finding_type || CASE WHEN closed > 0 THEN '|' || closed ELSE '' END) AS finding_id, domain_id, url, finding_type, confidence,
          CASE WHEN url LIKE '%/new' THEN 'OTHER' ELSE 'ENV_FILE' END AS entity_type
        FROM kk AS k WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.domain_id = k.domain_id AND f.url = k.url AND f.finding_type = k.finding_type AND f.{OPEN})""",
    "findings",
)
def finding_dedup(spark, sf):
    rows, _ = saving.save_findings(_candidates(spark, sf), I.findings(spark, sf), AS_OF)
    return rows.select("finding_id", "domain_id", "url", "finding_type", F.col("final_confidence").alias("confidence"), "entity_type")


@query("bucketed_findings", QUERIES["finding_dedup"][1])
def bucketed_findings(spark, sf):
    """The candidates saved to a ledger in hash buckets, and saved again, which adds nothing."""
    ledger = I.findings(spark, sf).withColumn("finding_id", F.col("finding_id").cast("string"))
    table = BucketTable(f"{checkpoint_root(spark)}/ledger-{uuid.uuid4().hex}", ledger.schema, tuple(saving.DEDUP_KEY), 32)
    table.create(ledger)
    version = 0
    for _ in range(2):
        version, _rows, _bad = saving.save_to_buckets(_candidates(spark, sf), table, version, AS_OF)
    new = table.read(spark, version).join(ledger.select("finding_id"), "finding_id", "left_anti")
    return new.select("finding_id", "domain_id", "url", "finding_type", F.col("final_confidence").alias("confidence"), "entity_type")


def _arrivals(spark, sf):
    """The candidates in three arrivals; keys come back in later ones, the new urls twice."""
    rows = I.findings(spark, sf)
    both = _candidates(spark, sf).withColumn("arrival", F.pmod(F.length("url") + F.col("domain_id"), F.lit(3)).cast("int"))
    later = rows.filter("finding_id % 2 = 0").selectExpr(
        "domain_id", "concat(url, '/new') AS url", "finding_type", "severity", "'NO_SUCH' AS entity_type",
        "CAST(0.5 AS DECIMAL(4,3)) AS confidence", "CAST(1 + finding_id div 2 % 2 AS INT) AS arrival",
    )
    return both.unionByName(later)


_ARRIVALS = f"""{_CAND}, arrivals AS (SELECT *, (length(url) + domain_id) % 3 AS arrival FROM c
        UNION ALL SELECT domain_id, url || '/new', finding_type, severity, 'NO_SUCH', 0.5, 1 + finding_id // 2 % 2 FROM findings WHERE finding_id % 2 = 0),
    k AS (SELECT domain_id, url, finding_type, max(confidence) FILTER (arrival = 0) AS p0, max(confidence) FILTER (arrival = 1) AS p1,
          max(confidence) FILTER (arrival = 2) AS p2 FROM arrivals WHERE severity <> 'HUGE' GROUP BY 1, 2, 3),
    l AS (SELECT domain_id, url, finding_type, count(*) FILTER ({OPEN}) > 0 AS open0, count(*) FILTER (NOT ({OPEN})) AS c0 FROM findings GROUP BY 1, 2, 3),
    s0 AS (SELECT k.*, coalesce(open0, false) AS open0, coalesce(c0, 0) AS c0 FROM k LEFT JOIN l USING (domain_id, url, finding_type)),
    s1 AS (SELECT *, p0 IS NOT NULL AND NOT open0 AS a0, p0 IS NOT NULL AND NOT open0 AND domain_id % 4 = 0 AS shut FROM s0),
    s2 AS (SELECT *, (open0 OR a0) AND NOT shut AS open1, c0 + shut::INTEGER AS c1 FROM s1),
    s3 AS (SELECT *, p1 IS NOT NULL AND NOT open1 AS a1 FROM s2),
    s4 AS (SELECT *, p2 IS NOT NULL AND NOT (open1 OR a1) AS a2 FROM s3),
    added AS (SELECT 0 AS batch_id, c0 AS closed, p0 AS confidence, * EXCLUDE (p0, p1, p2) FROM s4 WHERE a0
        UNION ALL SELECT 1, c1, p1, * EXCLUDE (p0, p1, p2) FROM s4 WHERE a1 UNION ALL SELECT 2, c1, p2, * EXCLUDE (p0, p1, p2) FROM s4 WHERE a2)"""


@query(
    "stream_ledger_append",
    f"""WITH {_ARRIVALS} SELECT sha256(domain_id || '|' || url || '|' || finding_type || CASE WHEN closed > 0 THEN '|' || closed ELSE '' END) AS finding_id,
        batch_id, domain_id, url, finding_type, CAST(confidence AS DECIMAL(4,3)) AS confidence FROM added""",
    "findings",
)
def stream_ledger_append(spark, sf):
    """Three arrivals streamed against the ledger; after the first, reviews close what it added for every fourth domain."""
    rows = handover(_arrivals(spark, sf), "arrivals")
    base = f"{checkpoint_root(spark)}/stream-ledger-{uuid.uuid4().hex}"
    how = {"detect": lambda batch: batch.drop("arrival"), "ledger": I.findings(spark, sf), "state": f"{base}/keys", "out": f"{base}/out"}
    for arrival in range(3):
        rows.filter(F.col("arrival") == arrival).write.mode("append").parquet(f"{base}/in")
        append_available(arriving(spark, f"{base}/in", rows.schema), f"{base}/checkpoint", as_of=AS_OF, **how)
        if arrival == 0:
            record_closed(spark.read.parquet(batch_folder(how["out"], 0)).filter("domain_id % 4 = 0"), how["state"], 0)
    return spark.read.parquet(how["out"]).select(
        "finding_id", "batch_id", "domain_id", "url", "finding_type", F.col("final_confidence").alias("confidence")
    )


@query(
    "finding_quarantine",
    f"WITH {_CAND} SELECT domain_id, url, finding_type, 'unknown severity' AS problem FROM c WHERE severity = 'HUGE'",
    "findings",
)
def finding_quarantine(spark, sf):
    _, bad = saving.split_valid(_candidates(spark, sf))
    return bad.select("domain_id", "url", "finding_type", "problem")


@query(
    "audit_created",
    f"""WITH {_CAND}, k AS (SELECT domain_id, url, finding_type, max(confidence) AS confidence FROM c
          WHERE severity IN ('CRITICAL','HIGH','MEDIUM','LOW','INFO') GROUP BY 1, 2, 3),
          shut AS (SELECT domain_id, url, finding_type, count(*) AS shut_n FROM findings WHERE NOT ({OPEN}) GROUP BY 1, 2, 3),
          kk AS (SELECT k.*, coalesce(shut_n, 0) AS closed FROM k LEFT JOIN shut USING (domain_id, url, finding_type))
        SELECT sha256(domain_id || '|' || url || '|' || finding_type || CASE WHEN closed > 0 THEN '|' || closed ELSE '' END) AS target_id, 'FINDING_CREATED' AS event_type, 'SCANNER' AS actor, url
        FROM kk AS k WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.domain_id = k.domain_id AND f.url = k.url AND f.finding_type = k.finding_type AND f.{OPEN})""",
    "findings",
)
def audit_created(spark, sf):
    rows, _ = saving.save_findings(_candidates(spark, sf), I.findings(spark, sf), AS_OF)
    log = saving.audit_created(rows, AS_OF)
    return log.select("target_id", "event_type", "actor", F.get_json_object("details", "$.url").alias("url"))


@query(
    "domain_delete",
    """SELECT 'domains' AS tab, count(*) AS n, count(domain_id) AS with_domain FROM domains WHERE status <> 'INACTIVE'
       UNION ALL SELECT 'findings', count(*), count(domain_id) FROM findings WHERE domain_id NOT IN (SELECT domain_id FROM domains WHERE status = 'INACTIVE')
       UNION ALL SELECT 'scan_jobs', count(*), count(*) FILTER (domain_id NOT IN (SELECT domain_id FROM domains WHERE status = 'INACTIVE')) FROM scan_jobs
       UNION ALL SELECT 'disclosure_events', count(*), count(*) FROM disclosure_events WHERE finding_id NOT IN
         (SELECT finding_id FROM findings WHERE domain_id IN (SELECT domain_id FROM domains WHERE status = 'INACTIVE'))""",
    "domains",
    "findings",
    "scan_jobs",
    "disclosure_events",
)
def domain_delete(spark, sf):
    d = I.domains(spark, sf)
    left = delete_domains(
        d, I.findings(spark, sf), I.scan_jobs(spark, sf), I.disclosure_events(spark, sf), d.filter("status = 'INACTIVE'")
    )
    out = None
    for name, df in left.items():
        kept = F.count("domain_id") if "domain_id" in df.columns else F.count(F.lit(1))
        row = df.agg(F.count(F.lit(1)).alias("n"), kept.alias("with_domain")).select(F.lit(name).alias("tab"), "n", "with_domain")
        out = row if out is None else out.unionByName(row)
    return out


_ELIGIBLE = "(SELECT j.job_id FROM scan_jobs j JOIN domains d USING (domain_id) WHERE j.status IN ('FAILED','SKIPPED','COMPLETED'))"


@query(
    "audit_trail",
    f"""WITH {_EMAILS}, {_CHANGES}, ESC AS (WITH {_ESCALATE} SELECT DISTINCT domain_id FROM q SEMI JOIN domains USING (domain_id)),
        DIS AS (WITH {_QUEUE} SELECT DISTINCT domain_id FROM q SEMI JOIN domains USING (domain_id))
        SELECT 'FINDING_STATUS_UPDATED' AS event_type, 'finding' AS target_type, count(*) AS n FROM ch
          WHERE s IN ('CONFIRMED','FALSE_POSITIVE','RESOLVED','ESCALATED') AND (v IS NULL OR v = 'LOW')
        UNION ALL SELECT 'DISCLOSURE_ACKNOWLEDGED', 'finding', count(*) FROM disclosure_events WHERE finding_id % 5 < 2 AND acknowledged_at IS NULL
        UNION ALL SELECT 'RESCAN_TRIGGERED', 'scan_job', count(*) FROM {_ELIGIBLE}
        UNION ALL SELECT 'JOB_RETRIED', 'job', count(*) FROM {_ELIGIBLE}
        UNION ALL SELECT 'CONTACT_EMAIL_UPDATED', 'domain', count(*) FROM domains WHERE contact_email IS NULL
        UNION ALL SELECT 'CONTACT_EMAIL_DISCOVERED', 'domain', count(*) FROM domains WHERE contact_email IS NULL
        UNION ALL SELECT 'DOMAIN_DELETED', 'domain', count(*) FROM domains WHERE status = 'INACTIVE'
        UNION ALL SELECT 'DISCLOSURE_SENT', 'domain', count(*) FROM DIS
        UNION ALL SELECT 'CERTIN_ESCALATION', 'domain', count(*) FROM ESC""",
    "domains",
    "findings",
    "scan_jobs",
    "disclosure_events",
    "contact_files",
)
def audit_trail(spark, sf):
    """Audit rows of every state change, counted by type."""
    d, f, e = I.domains(spark, sf), I.findings(spark, sf), I.disclosure_events(spark, sf)
    contacts = names.security_contacts(d, I.contact_files(spark, sf))
    rescans = transitions.rescan_eligible(I.scan_jobs(spark, sf), d)
    bare = d.filter("contact_email IS NULL").selectExpr("domain_id", "concat('x@', domain) AS email")
    logs = [
        transitions.audit_reviews(transitions.apply_reviews(f, _changes(spark, sf), AS_OF), AS_OF),
        transitions.audit_acknowledged(transitions.acknowledge_events(e, _acks(spark, sf), AS_OF), f, AS_OF),
        transitions.audit_rescans(rescans, AS_OF),
        transitions.audit_rescans(rescans, AS_OF, retry=True),
        transitions.audit_contacts(transitions.set_contacts(d, bare), AS_OF),
        transitions.audit_discovered(transitions.discover_contacts(d, contacts), AS_OF),
        transitions.audit_deleted(d.filter("status = 'INACTIVE'"), AS_OF),
        disclosure.disclosure_plan(f, disclosure.stored_or_found(d, contacts), SETTINGS, AS_OF).audit,
        disclosure.escalation_plan(f, d, SETTINGS, AS_OF).audit,
    ]
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.groupBy("event_type", "target_type").agg(F.count(F.lit(1)).alias("n"))


# -- the whole run ---------------------------------------------------------


@query(
    "workflow_steps",
    f"""WITH {_EVIDENCE}, {_TEMPLATES},
        fm AS (SELECT f.*, (breach_note IS NOT NULL OR vuln_note IS NOT NULL) AND severity IN ('CRITICAL','HIGH') AND {OPEN} AS hit FROM findings f LEFT JOIN ev USING (domain_id)),
        vc2 AS (SELECT d.domain_id FROM t JOIN domains d ON contains(lower(d.vendor_fingerprint), lower(split_part(t.vendor, ' ', 1))) WHERE d.status = 'ACTIVE'),
        st AS (SELECT domain_id, severity, status, disclosed_at, acknowledged_at, disclosure_sla_due, dark_web_confirmed OR hit AS dark, CASE WHEN hit THEN greatest(escalation_level, 1) ELSE escalation_level END AS lvl FROM fm
               UNION ALL SELECT domain_id, 'HIGH', 'NEW', NULL, NULL, {NOW} + to_hours(72), false, 0 FROM vc2),
        dq AS (SELECT *, disclosed_at IS NULL AND {OPEN} AND (severity = 'CRITICAL' OR disclosure_sla_due <= {NOW} + to_hours(24)) AND domain_id IN (SELECT domain_id FROM domains) AS due FROM st),
        af AS (SELECT domain_id, severity, CASE WHEN due THEN 'DISCLOSED' ELSE status END AS status, CASE WHEN due THEN {NOW} ELSE disclosed_at END AS disclosed_at, acknowledged_at, dark, lvl FROM dq)
        SELECT 'risk_scores' AS step, 'updated' AS metric, count(*) AS n FROM domains WHERE status = 'ACTIVE'
        UNION ALL SELECT 'breach_correlation', 'breached', count(*) FROM ev
        UNION ALL SELECT 'vendor_correlation', 'correlated', count(*) FROM vc2
        UNION ALL SELECT 'disclosure', 'disclosed', count(*) FROM dq WHERE due
        UNION ALL SELECT 'escalation', 'escalated', count(*) FROM af WHERE domain_id IN (SELECT domain_id FROM domains) AND
          ((severity = 'CRITICAL' AND status = 'DISCLOSED' AND acknowledged_at IS NULL AND disclosed_at < {NOW} - to_hours(72))
           OR (dark AND severity IN ('CRITICAL','HIGH') AND lvl < 3 AND {OPEN}))""",
    "domains",
    "findings",
    "breaches",
    "host_vulns",
)
def workflow_steps(spark, sf):
    d = _contacts(spark, sf)
    rows = I.findings(spark, sf).withColumn("finding_id", F.col("finding_id").cast("string"))
    run = workflow.run_ledger(
        workflow.LedgerInputs(d, rows, I.breaches(spark, sf), I.host_vulns(spark, sf)), SETTINGS, AS_OF, handover
    )
    return workflow.step_counts(run, d)


def _inputs(spark, sf, broken: bool = False) -> workflow.LedgerInputs:
    """The ledger's inputs; a broken host feed fails wherever a row of it is read."""
    feed = I.host_vulns(spark, sf)
    if broken:
        feed = feed.withColumns({c: F.when(F.length(F.col(c).cast("string")) >= 0, F.raise_error(F.lit("feed"))).cast(t) for c, t in feed.dtypes if t == "string"})
    rows = I.findings(spark, sf).withColumn("finding_id", F.col("finding_id").cast("string"))
    return workflow.LedgerInputs(_contacts(spark, sf), rows, I.breaches(spark, sf), feed)


def _run(spark, inputs: workflow.LedgerInputs, folder: str) -> journal.Run:
    return journal.run_steps(spark, folder, inputs.findings, journal.ledger_steps(inputs, SETTINGS, AS_OF))


def _run_folder(spark) -> str:
    return f"{checkpoint_root(spark)}/ledger-run-{uuid.uuid4().hex}"


def _state(marked: bool) -> str:
    """SQL for the findings after breach marking (or without it), correlation, disclosure (``aft``) and escalation (``fin``)."""
    hit = "(breach_note IS NOT NULL OR vuln_note IS NOT NULL) AND severity IN ('CRITICAL','HIGH') AND " + OPEN if marked else "false"
    return f"""{_EVIDENCE}, {_TEMPLATES},
        fm AS (SELECT f.*, {hit} AS hit FROM findings f LEFT JOIN ev USING (domain_id)),
        cor AS (SELECT d.domain_id, sha256(d.domain_id || '|https://' || d.domain || '/|VENDOR_CORRELATION|' || t.vendor) AS finding_id
               FROM t JOIN domains d ON contains(lower(d.vendor_fingerprint), lower(split_part(t.vendor, ' ', 1))) WHERE d.status = 'ACTIVE'),
        st AS (SELECT CAST(finding_id AS VARCHAR) AS finding_id, domain_id, severity, status, disclosed_at, acknowledged_at, disclosure_sla_due,
                 dark_web_confirmed OR hit AS dark, CASE WHEN hit THEN greatest(escalation_level, 1) ELSE escalation_level END AS lvl FROM fm
               UNION ALL SELECT finding_id, domain_id, 'HIGH', 'NEW', NULL, NULL, {NOW} + to_hours(72), false, 0 FROM cor),
        dq AS (SELECT *, disclosed_at IS NULL AND {OPEN} AND (severity = 'CRITICAL' OR disclosure_sla_due <= {NOW} + to_hours(24)) AS wanted,
                 domain_id IN (SELECT domain_id FROM domains) AS known FROM st),
        aft AS (SELECT finding_id, domain_id, severity, CASE WHEN wanted AND known THEN 'DISCLOSED' ELSE status END AS status,
                 CASE WHEN wanted AND known THEN {NOW} ELSE disclosed_at END AS disclosed_at, acknowledged_at, dark, lvl, known, wanted FROM dq),
        esc AS (SELECT *, known AND ((severity = 'CRITICAL' AND status = 'DISCLOSED' AND acknowledged_at IS NULL AND disclosed_at < {NOW} - to_hours(72))
           OR (dark AND severity IN ('CRITICAL','HIGH') AND lvl < 3 AND {OPEN})) AS raised FROM aft),
        fin AS (SELECT finding_id, domain_id, severity, CASE WHEN raised THEN 'ESCALATED' ELSE status END AS status, disclosed_at, dark,
                 CASE WHEN raised THEN 3 ELSE lvl END AS lvl, raised, wanted AND known AS sent FROM esc)"""


_ROWS = ["finding_id", "domain_id", "severity", "status", "dark_web_confirmed", "escalation_level"]
_TABLES = ("domains", "findings", "breaches", "host_vulns")


def _rows(findings: DataFrame) -> DataFrame:
    return findings.select(*_ROWS, F.col("disclosed_at").isNotNull().alias("disclosed"))


@query(
    "workflow_findings",
    f"WITH {_state(True)} SELECT finding_id, domain_id, severity, status, dark AS dark_web_confirmed, lvl AS escalation_level, disclosed_at IS NOT NULL AS disclosed FROM fin",
    *_TABLES,
)
def workflow_findings(spark, sf):
    """Every finding after a whole run, raised ones included; an error if a step failed."""
    return _rows(_run(spark, _inputs(spark, sf), _run_folder(spark)).whole().findings)


_COUNTS = """SELECT 'risk_scores' AS step, (SELECT count(*) FROM domains WHERE status = 'ACTIVE') AS n
        UNION ALL SELECT 'vendor_correlation', (SELECT count(*) FROM cor)
        UNION ALL SELECT 'disclosure', (SELECT count(*) FROM fin WHERE sent) UNION ALL SELECT 'escalation', (SELECT count(*) FROM fin WHERE raised)"""


@query(
    "workflow_error_row",
    f"""WITH {_state(False)}, c AS ({_COUNTS}) SELECT step, 'DONE' AS status, n, NULL AS error FROM c
        UNION ALL SELECT 'breach_correlation', 'FAILED', NULL, 'SparkRuntimeException: USER_RAISED_EXCEPTION'""",
    *_TABLES,
)
def workflow_error_row(spark, sf):
    """The journal of a run whose host feed is broken: one step has an error row, the others have finished."""
    run = _run(spark, _inputs(spark, sf, broken=True), _run_folder(spark))
    return run.results().select("step", "status", "n", "error")


@query(
    "workflow_second_run",
    f"""WITH {_state(False)} SELECT finding_id, domain_id, severity, status, dark OR hit AS dark_web_confirmed,
          CASE WHEN hit THEN greatest(lvl, 1) ELSE lvl END AS escalation_level, disclosed_at IS NOT NULL AS disclosed
        FROM (SELECT fin.*, (breach_note IS NOT NULL OR vuln_note IS NOT NULL) AND severity IN ('CRITICAL','HIGH') AND {OPEN} AS hit
              FROM fin LEFT JOIN ev USING (domain_id))""",
    *_TABLES,
)
def workflow_second_run(spark, sf):
    """The findings after the broken run was resumed with a sound feed: only breach marking ran again; an error if a step failed in the end."""
    folder = _run_folder(spark)
    _run(spark, _inputs(spark, sf, broken=True), folder)
    return _rows(_run(spark, _inputs(spark, sf), folder).whole().findings)


@query(
    "workflow_audit",
    f"""WITH {_state(True)}, c AS ({_COUNTS} UNION ALL SELECT 'breach_correlation', (SELECT count(*) FROM ev))
        SELECT 'PHASE3_PIPELINE_COMPLETED' AS event_type, 'SYSTEM' AS actor, 'ledger' AS target_id,
          '{{' || string_agg('"' || step || '":"n=' || n || '"', ',' ORDER BY step) || '}}' AS details FROM c""",
    *_TABLES,
)
def workflow_audit(spark, sf):
    run = _run(spark, _inputs(spark, sf), _run_folder(spark))
    return journal.audit_completed(run, AS_OF).select("event_type", "actor", "target_id", "details")
