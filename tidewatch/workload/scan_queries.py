"""The whole domain scan over pages and documents as captures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators.content_scan import DEFAULT_RULES
from tidewatch.plans.scan import ScanRun, scan_domains
from tidewatch.session import checkpoint_root, handover
from tidewatch.sources.captures import read_captures
from tidewatch.sources.ledger import read_table
from tidewatch.workload import inputs as I
from tidewatch.workload.inputs_sql import pick as sql_pick
from tidewatch.workload.inputs_sql import with_ctes
from tidewatch.workload.ledger_queries import NOW, OPEN, Query, sql_ts, ts
from tidewatch.workload.path_inputs import path_captures
from tidewatch.workload.path_queries import _SCAN
from tidewatch.workload.text_queries import _BASE, _PAGES, hits_sql

QUERIES: dict[str, tuple[Query, str | None]] = {}
# What the ledger already holds of a page's domain: by turns an open finding, a closed one or none.
_KINDS = (*[f"'{r.name}_IN_CONTENT'" for r in DEFAULT_RULES], "'PAN_IN_CONTENT'")


def _captures(spark, sf):
    """Home pages with planted values, some not reachable, and answers at every rule path of the first hundred sites."""
    pages = I.augmented_pages(spark, sf).selectExpr(
        "concat('site', page_id, '.example') AS domain",
        "concat('https://site', page_id, '.example/') AS url",
        "'/' AS path",
        "CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status",
        "'text/html' AS content_type",
        "text AS body",
        "CAST(octet_length(text) AS BIGINT) AS body_bytes",
    )
    files = path_captures(spark, sf).select(*pages.columns)
    return pages.unionByName(files).selectExpr(
        "*", "'https' AS scheme", "CAST(NULL AS map<string,string>) AS headers", f"{I.NOW} AS fetched_at"
    )


def _domains(spark, sf):
    """Most sites; those of every thirteenth page are not in the inventory."""
    return I.table(spark, sf, "pages").filter("page_id % 13 <> 5").selectExpr(
        "page_id AS domain_id", "concat('site', page_id, '.example') AS domain", "'ACTIVE' AS status", "'OTHER' AS sector",
        "CAST(NULL AS STRING) AS vendor_fingerprint", "'before' AS baseline_hash", "1 AS scan_count",
        "CAST(NULL AS TIMESTAMP) AS last_scanned_at", f"{I.NOW} AS next_scan_due_at",
    )


def _ledger(spark, sf):
    return I.table(spark, sf, "pages").filter("page_id div 12 % 3 < 2").selectExpr(
        "page_id AS domain_id", "concat('https://site', page_id, '.example/') AS url",
        f"{I.pick('page_id', *_KINDS)} AS finding_type", "CASE WHEN page_id div 12 % 3 = 0 THEN 'NEW' ELSE 'RESOLVED' END AS status",
    )


def _scan(spark, sf, findings=None) -> ScanRun:
    ledger = _ledger(spark, sf) if findings is None else findings
    return scan_domains(
        _captures(spark, sf), _domains(spark, sf), ledger, as_of=I.AS_OF, salt=I.SALT, cut=lambda df: handover(df, "scan")
    )


_FOUND = f"""{_SCAN}, {hits_sql(_PAGES, _BASE)},
    cand AS (SELECT id AS domain_id, 'https://site' || id || '.example/' AS url, rule || '_IN_CONTENT' AS finding_type, severity,
             CAST(CASE WHEN kw THEN 0.8 ELSE 0.6 END AS DECIMAL(4,3)) AS confidence FROM h WHERE id % 11 <> 0
      UNION ALL SELECT CAST(regexp_extract(domain, '[0-9]+') AS BIGINT), url, finding_type, severity, max(confidence) FROM f GROUP BY ALL),
    inv AS (SELECT page_id AS domain_id FROM pages WHERE page_id % 13 <> 5),
    led AS (SELECT page_id AS domain_id, 'https://site' || page_id || '.example/' AS url, {sql_pick("page_id", *_KINDS)} AS finding_type,
            CASE WHEN page_id // 12 % 3 = 0 THEN 'NEW' ELSE 'RESOLVED' END AS status FROM pages WHERE page_id // 12 % 3 < 2),
    fresh AS (SELECT c.*, (SELECT count(*) FROM led WHERE led.domain_id = c.domain_id AND led.url = c.url AND led.finding_type = c.finding_type AND NOT ({OPEN})) AS closed
      FROM cand c SEMI JOIN inv USING (domain_id) ANTI JOIN (SELECT * FROM led WHERE {OPEN}) o USING (domain_id, url, finding_type)),
    fnd AS (SELECT sha256(domain_id || '|' || url || '|' || finding_type || CASE WHEN closed > 0 THEN '|' || closed ELSE '' END) AS finding_id, * FROM fresh),
    cap AS (SELECT page_id AS domain_id, '/' AS path, CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status FROM pages
      UNION ALL SELECT CAST(regexp_extract(domain, '[0-9]+') AS BIGINT), path, status FROM c),
    seen AS (SELECT domain_id, CAST(count(DISTINCT path) AS INTEGER) AS paths, bool_or(status < 500) AS reachable FROM cap SEMI JOIN inv USING (domain_id) GROUP BY 1)"""


def query(name: str, sql: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, with_ctes(f"WITH {_FOUND} {sql}", "augmented_pages"))
        return fn

    return add


@query("scan_new_findings", "SELECT finding_id, domain_id, url, finding_type, severity, confidence FROM fnd")
def scan_new_findings(spark, sf):
    return _scan(spark, sf).findings.select(
        "finding_id", "domain_id", "url", "finding_type", "severity", F.col("final_confidence").alias("confidence")
    )


@query("scan_quarantine", "SELECT url, finding_type, 'domain missing' AS problem FROM cand ANTI JOIN inv USING (domain_id)")
def scan_quarantine(spark, sf):
    return _scan(spark, sf).quarantined.select("url", "finding_type", "problem")


@query(
    "scan_jobs_done",
    """SELECT domain_id, CASE WHEN reachable THEN 'COMPLETED' ELSE 'SKIPPED' END AS status, CASE WHEN reachable THEN paths ELSE 0 END AS urls_checked,
        CASE WHEN reachable THEN coalesce(n, 0) ELSE 0 END AS findings_count FROM seen
        LEFT JOIN (SELECT domain_id, CAST(count(*) AS INTEGER) AS n FROM fnd GROUP BY 1) USING (domain_id)""",
)
def scan_jobs_done(spark, sf):
    return _scan(spark, sf).jobs.select("domain_id", "status", "urls_checked", "findings_count")


@query(
    "scan_domains_after",
    f"""SELECT page_id AS domain_id, CASE WHEN reachable THEN 'ACTIVE' ELSE 'INACTIVE' END AS status, CASE WHEN reachable THEN 2 ELSE 1 END AS scan_count,
        CASE WHEN page_id % 11 <> 0 THEN sha256(text) ELSE 'before' END AS baseline_hash,
        {sql_ts(f"CASE WHEN reachable THEN {NOW} + to_days(30) ELSE {NOW} END")} AS next_scan
        FROM augmented_pages JOIN seen ON domain_id = page_id""",
)
def scan_domains_after(spark, sf):
    return _scan(spark, sf).domains.select("domain_id", "status", "scan_count", "baseline_hash", ts("next_scan_due_at").alias("next_scan"))


def _requested_scan(spark, sf) -> ScanRun:
    """A scan of the whole inventory to which every fifth site has no capture at all."""
    captures = _captures(spark, sf).filter("CAST(regexp_extract(domain, '[0-9]+', 0) AS BIGINT) % 5 <> 2")
    cut = {"as_of": I.AS_OF, "salt": I.SALT, "cut": lambda df: handover(df, "scan")}
    return scan_domains(captures, _domains(spark, sf), _ledger(spark, sf), requested=_domains(spark, sf), **cut)


@query(
    "scan_jobs_requested",
    """SELECT i.domain_id, CASE WHEN s.reachable AND i.domain_id % 5 <> 2 THEN 'COMPLETED' ELSE 'SKIPPED' END AS status,
        CASE WHEN s.reachable AND i.domain_id % 5 <> 2 THEN paths ELSE 0 END AS urls_checked,
        CASE WHEN s.reachable AND i.domain_id % 5 <> 2 THEN coalesce(n, 0) ELSE 0 END AS findings_count,
        CASE WHEN s.reachable AND i.domain_id % 5 <> 2 THEN NULL ELSE 'Domain unreachable' END AS error_message
        FROM inv i LEFT JOIN seen s USING (domain_id) LEFT JOIN (SELECT domain_id, CAST(count(*) AS INTEGER) AS n FROM fnd GROUP BY 1) USING (domain_id)""",
)
def scan_jobs_requested(spark, sf):
    return _requested_scan(spark, sf).jobs.select("domain_id", "status", "urls_checked", "findings_count", "error_message")


@query(
    "scan_domains_requested",
    "SELECT i.domain_id, CASE WHEN s.reachable AND i.domain_id % 5 <> 2 THEN 'ACTIVE' ELSE 'INACTIVE' END AS status FROM inv i LEFT JOIN seen s USING (domain_id)",
)
def scan_domains_requested(spark, sf):
    return _requested_scan(spark, sf).domains.select("domain_id", "status")


@query(
    "scan_audit",
    "SELECT finding_id AS target_id, 'FINDING_CREATED' AS event_type, finding_type, severity FROM fnd",
)
def scan_audit(spark, sf):
    field = F.get_json_object
    return _scan(spark, sf).audit.select(
        "target_id", "event_type", field("details", "$.finding_type").alias("finding_type"), field("details", "$.severity").alias("severity")
    )


@query(
    "scan_rerun_adds_nothing",
    "SELECT count(*) AS n_first, count(DISTINCT finding_id) AS n_ids, CAST(0 AS BIGINT) AS n_again FROM fnd",
)
def scan_rerun_adds_nothing(spark, sf):
    ledger = _ledger(spark, sf)
    first = _scan(spark, sf, ledger).findings
    again = _scan(spark, sf, ledger.unionByName(first.select(*ledger.columns))).findings
    rows = first.select("finding_id", F.lit(1).alias("run")).unionByName(again.select("finding_id", F.lit(2).alias("run")))
    return rows.agg(
        F.count_if(F.col("run") == 1).alias("n_first"),
        F.count_distinct("finding_id").alias("n_ids"),
        F.count_if(F.col("run") == 2).alias("n_again"),
    )


# --------------------------------------------------------------------------
# Declared reads: captures and ledger tables at rest
# --------------------------------------------------------------------------


def _at_rest(df, name: str, fmt: str) -> str:
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.format(fmt).save(path)
    return path


_READ = """SELECT domain, url, path, scheme, status, content_type, sha256(body) AS body_hash, body_bytes, fetched_at_us, server FROM (
    SELECT 'site' || page_id || '.example' AS domain, 'https://site' || page_id || '.example/' AS url, '/' AS path, 'https' AS scheme,
      CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status, 'text/html' AS content_type, text AS body, octet_length(encode(text)) AS body_bytes
      FROM augmented_pages
    UNION ALL SELECT domain, url, path, 'https', status, content_type, body, octet_length(encode(body)) FROM c),
    (SELECT epoch_us(TIMESTAMP '{now}') AS fetched_at_us, 'test/1' AS server)""".format(now=I.AS_OF)


@query("read_captures", _READ)
def captures_at_rest(spark, sf):
    """Whole captures, written as JSON lines without types and read with the declared ones."""
    given = _captures(spark, sf).withColumn("headers", F.create_map(F.lit("Server"), F.lit("test/1")))
    found = read_captures(spark, _at_rest(given, "captures", "json"), "json")
    return found.select(
        "domain", "url", "path", "scheme", "status", "content_type", F.sha2("body", 256).alias("body_hash"), "body_bytes",
        F.unix_micros("fetched_at").alias("fetched_at_us"), F.col("headers")["Server"].alias("server"),
    )


_LEDGER_READ = """SELECT CAST(finding_id AS VARCHAR) AS finding_id, CAST(domain_id AS VARCHAR) AS domain_id, url, finding_type, severity, status,
    CAST(CAST(final_confidence AS DECIMAL(4,3)) AS VARCHAR) AS confidence_text, epoch_us(created_at) AS created_at_us, true AS no_ml_confidence, dark_web_confirmed FROM findings"""


def read_ledger(spark, sf):
    """A ledger table with fewer and looser columns than declared, read with all of its types; columns it lacks are null."""
    found = read_table(spark, _at_rest(I.findings(spark, sf), "findings", "json"), "findings", "json")
    return found.select(
        "finding_id", "domain_id", "url", "finding_type", "severity", "status",
        F.col("final_confidence").cast("string").alias("confidence_text"), F.unix_micros("created_at").alias("created_at_us"), F.isnull("ml_confidence").alias("no_ml_confidence"), "dark_web_confirmed",
    )


QUERIES["read_ledger_table"] = (read_ledger, with_ctes(_LEDGER_READ, "findings"))
