"""Ledger and input tables derived by Spark from the given tables.

Every derived table grows with the table it comes from. ``inputs_sql`` states
the same mappings for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import prepare
from tidewatch.config import Settings

AS_OF = "2026-01-01 00:00:00"
SALT = "workload-salt"
NATIONAL_TEAM, GOVERNMENT_TEAM = "national-team@example.org", "government-team@example.org"
SETTINGS = Settings(SALT, NATIONAL_TEAM, GOVERNMENT_TEAM)


# Declared, so that reading a table needs no job to look at its files first.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(index: str, *values: str) -> str:
    """SQL: the value at ``index`` modulo the number of values."""
    return f"element_at(array({', '.join(values)}), CAST(({index}) % {len(values)} + 1 AS INT))"


NOW = f"TIMESTAMP '{AS_OF}'"
_TLD = pick("c_custkey", "'.gov.in'", "'.ac.in'", "'.co.in'", "'.in'", "'.com'", "'.nic.in'")


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = pick("c_custkey", "'PENDING'", "'ACTIVE'", "'ACTIVE'", "'ACTIVE'", "'INACTIVE'")
    vendor = pick(
        "c_custkey", "NULL", "'WordPress 6.4.2'", "'Joomla 4.1'", "'Drupal 10'", "'Spring-Boot 2.7'", "'NIC-eGov'", "'WordPress'"
    )
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS domain_id",
        f"concat('org', c_custkey, {_TLD}) AS domain",
        f"{_TLD} AS tld",
        "CAST(c_custkey % 101 AS INT) AS iocs_score",
        f"{status} AS status",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'GOVERNMENT' WHEN 'AUTOMOBILE' THEN 'FINANCE' "
        "WHEN 'MACHINERY' THEN 'RESEARCH' WHEN 'HOUSEHOLD' THEN 'HEALTHCARE' ELSE 'EDUCATION' END AS sector",
        f"{vendor} AS vendor_fingerprint",
        "CASE WHEN c_custkey % 4 <> 0 THEN concat('security@org', c_custkey, '.example') END AS contact_email",
        "concat('10.0.', c_custkey div 250, '.', c_custkey % 250) AS ip_address",
        f"CASE WHEN c_custkey % 9 <> 0 THEN {NOW} - make_dt_interval(CAST(c_custkey % 40 AS INT)) END AS last_scanned_at",
        f"{NOW} + make_dt_interval(CAST(c_custkey % 41 - 20 AS INT)) AS next_scan_due_at",
        "CAST(c_custkey % 12 AS INT) AS scan_count",
        "CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('{\"owner\":\"team', c_custkey, '\",\"risk_score\":1}') "
        "ELSE 'not json' END AS notes",
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(
        "o_orderkey", "'ENV_FILE_EXPOSED'", "'GIT_REPO_EXPOSED'", "'CREDIT_CARD_IN_CONTENT'", "'DATABASE_DUMP_EXPOSED'",
        "'OPEN_DIRECTORY_LISTING'", "'ERROR_LOG_EXPOSED'", "'EMAIL_IN_CONTENT'",
    )
    entity = pick(
        "o_orderkey", "'ENV_FILE'", "'GIT_REPO'", "'CREDIT_CARD'", "'DATABASE_DUMP'", "'OPEN_DIRECTORY'", "'OTHER'", "'EMAIL'"
    )
    status = pick("o_orderkey", "'NEW'", "'CONFIRMED'", "'DISCLOSED'", "'RESOLVED'", "'FALSE_POSITIVE'", "'ESCALATED'")
    score = "CAST((60 + o_orderkey % 40) / 100.0 AS DECIMAL(4,3))"
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS finding_id",
        "o_custkey AS domain_id",
        "concat('https://org', o_custkey, '.example/p', o_orderkey % 13) AS url",
        "concat('/p', o_orderkey % 13) AS url_path",
        f"{entity} AS entity_type",
        f"{kind} AS finding_type",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' "
        "WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS severity",
        f"{status} AS status",
        f"{score} AS heuristic_confidence",
        f"CASE WHEN o_orderkey % 5 <> 0 THEN {score} END AS final_confidence",
        "o_orderkey % 11 = 0 AS dark_web_confirmed",
        f"{NOW} - make_dt_interval(0, CAST((o_orderkey * 37) % 1500 + 13 AS INT)) AS created_at",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'seen before' END AS context_snippet_safe",
    )
    hours = "CASE severity WHEN 'CRITICAL' THEN 24 WHEN 'HIGH' THEN 72 WHEN 'MEDIUM' THEN 168 ELSE 720 END"
    return base.selectExpr(
        "*",
        f"created_at + make_dt_interval(0, {hours}) AS disclosure_sla_due",
        "CASE WHEN status IN ('DISCLOSED','ESCALATED') THEN created_at + make_dt_interval(0, 1) END AS disclosed_at",
        "CASE WHEN status = 'DISCLOSED' AND finding_id % 4 = 0 THEN created_at + make_dt_interval(0, 12) END AS acknowledged_at",
        "CASE WHEN status = 'ESCALATED' THEN 3 ELSE 0 END AS escalation_level",
    )


def scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order."""
    status = pick("o_orderkey", "'PENDING'", "'RUNNING'", "'COMPLETED'", "'FAILED'", "'SKIPPED'")
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS job_id",
        "o_custkey AS domain_id",
        "concat('org', o_custkey) AS domain_name",
        f"{status} AS status",
        "109 AS urls_checked",
        "CAST(o_orderkey % 7 AS INT) AS findings_count",
        "CAST(20000 + o_orderkey % 5000 AS INT) AS duration_ms",
        f"{NOW} - make_dt_interval(0, CAST(o_orderkey % 2000 AS INT)) AS created_at",
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "upper(event_type) AS event_type",
        "concat('user', user_id) AS actor",
        "props AS details",
        "CAST(ts AS TIMESTAMP) AS event_at",
    )


def disclosure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).filter("disclosed_at IS NOT NULL").selectExpr(
        "finding_id AS event_id",
        "finding_id",
        "concat('security@org', domain_id, '.example') AS recipient_email",
        "'PRIMARY' AS recipient_type",
        "concat('Disclosure ', finding_id) AS subject",
        "CASE WHEN finding_id % 10 = 2 THEN 'FAILED' ELSE 'SENT' END AS send_status",
        "sha2(concat('tok', finding_id), 256) AS ack_token",
        "disclosed_at AS sent_at",
        "disclosed_at AS created_at",
        "acknowledged_at",
    )


def breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload row for every eighth domain, two for every sixteenth."""
    rows = domains(spark, sf_dir).select("domain_id", "domain").filter("domain_id % 8 = 0")
    payload = "CASE WHEN domain_id % 16 = 0 THEN concat('{\"a', domain_id, '\":[\"b1\",\"b2\"],\"z\":\"one\"}') ELSE concat('{\"a', domain_id, '\":[\"b1\"]}') END"
    first = rows.selectExpr("domain", f"{payload} AS payload")
    return first.unionByName(rows.filter("domain_id % 16 = 0").selectExpr("domain", "'{\"q\":[\"b3\"]}' AS payload"))


def host_vulns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains(spark, sf_dir).filter("domain_id % 9 = 0").selectExpr(
        "ip_address AS ip",
        "sequence(1, CAST(domain_id % 30 + 1 AS INT)) AS open_ports",
        "CASE WHEN domain_id % 2 = 0 THEN array() ELSE transform(sequence(1, CAST(domain_id % 13 + 1 AS INT)), x -> concat('V-', x)) END AS vulns",
        "concat('host', domain_id % 5) AS org",
    )


def contact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two contact files per domain, of five forms."""
    rows = domains(spark, sf_dir).select("domain_id", "domain")
    body = pick(
        "domain_id",
        r"concat('Contact: mailto:sec@', domain, '\nExpires: never')",
        r"concat('# comment\nContact: https://', domain, '/report\r\nCONTACT:   abuse@', domain)",
        r"'Contact: mailto:bad address\n'",
        "''",
        r"concat('contact: mailto:a@', domain, '\n  contact: b@', domain)",
    )
    first = rows.selectExpr(
        "domain", "CAST(domain_id % 4 + 1 AS INT) AS priority", "CASE WHEN domain_id % 10 = 9 THEN 404 ELSE 200 END AS status", f"{body} AS body"
    )
    second = rows.selectExpr(
        "domain", "9 AS priority", "CASE WHEN domain_id % 2 = 0 THEN 200 ELSE 500 END AS status", "concat('Contact: mailto:second@', domain) AS body"
    )
    return first.unionByName(second)


# --------------------------------------------------------------------------
# Pages as captures, names, resolutions and feeds
# --------------------------------------------------------------------------

# Values planted so that every signal and several vendors occur.
PAGE_MARKERS = (
    "",
    '<link href="/wp-content/themes/x">',
    '<meta name="generator" content="Joomla! 4.1">',
    '<p lang="hi">',
    " call +919876543210 ",
    " GST 27ABCDE1234F1Z5 ",
    ' <script src="https://checkout.razorpay.example/v1.js"></script> ',
    " नमस्तेदुनिया ",
    ' <input name="__VIEWSTATE"> ',
)
NAME_SUFFIXES = (".gov.in", ".co.in", ".in", "", ".nic.in")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per page: its host, a name below it and the page with a planted marker."""
    host = "lower(substring_index(substring_index(substring_index(url, '//', -1), '/', 1), ':', 1))"
    suffix = pick("page_id", *[f"'{s}'" for s in NAME_SUFFIXES])
    marker = pick("page_id", *[f"'{m}'" for m in PAGE_MARKERS])
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        f"{host} AS host",
        f"concat('p', page_id, '.', {host}, {suffix}) AS domain",
        "concat('10.', page_id % 200, '.', (page_id div 200) % 250, '.7') AS ip",
        f"concat(html, {marker}) AS html",
        "url",
    )


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site but each seventh resolves."""
    return sites(spark, sf_dir).filter("page_id % 7 <> 0").select(F.col("domain").alias("name"), "ip")


def ip_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites(spark, sf_dir).selectExpr(
        "ip",
        "CASE WHEN page_id % 3 = 0 THEN 'AS9829 Example Net' ELSE 'AS98291 Other Net' END AS asn",
        "CASE WHEN page_id % 2 = 0 THEN 'India' ELSE 'France' END AS country",
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures per site: the page, an http one that loses against https, and a newer one at a rule path."""
    rows = sites(spark, sf_dir)
    scheme = "CASE WHEN page_id % 3 = 0 THEN 'http' ELSE 'https' END"
    page = rows.selectExpr(
        "domain",
        f"concat({scheme}, '://', CASE WHEN page_id % 6 = 1 THEN 'www.' WHEN page_id % 6 = 2 THEN 'cdn.' ELSE '' END, domain, '/') AS url",
        "'/' AS path",
        f"{scheme} AS scheme",
        "CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status",
        "CASE WHEN page_id % 4 = 0 THEN map('server', 'nginx', 'x-powered-by', concat('PHP/8.1.', page_id % 10)) "
        "ELSE map('server', 'nginx') END AS headers",
        "'text/html' AS content_type",
        "html AS body",
        "CAST(octet_length(html) AS BIGINT) AS body_bytes",
        f"{NOW} - make_dt_interval(0, 0, CAST(page_id % 10000 AS INT)) AS fetched_at",
    )
    other = rows.selectExpr(
        "domain",
        "concat('http://', domain, '/') AS url",
        "'/' AS path",
        "'http' AS scheme",
        "200 AS status",
        "map('server', 'old') AS headers",
        "'text/html' AS content_type",
        "concat('old page of ', domain) AS body",
        "10L AS body_bytes",
        f"{NOW} - make_dt_interval(30) AS fetched_at",
    )
    probe = rows.selectExpr(
        "domain",
        "concat('https://', domain, '/.env') AS url",
        "'/.env' AS path",
        "'https' AS scheme",
        "200 AS status",
        "map('server', 'probe') AS headers",
        "'text/plain' AS content_type",
        "concat('APP_NAME=', domain) AS body",
        "10L AS body_bytes",
        f"{NOW} AS fetched_at",
    )
    return page.unionByName(other).unionByName(probe)


SIGNALS = (
    "signal_whois_in", "signal_ip_in", "signal_payment_gw", "signal_gst_number", "signal_lang_in", "signal_registry",
)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing inventory that holds two of three sites, older."""
    return sites(spark, sf_dir).filter("page_id % 3 <> 2").selectExpr(
        "domain",
        "'.in' AS tld",
        "CAST(page_id % 70 AS INT) AS iocs_score",
        "CASE WHEN page_id % 2 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS status",
        "CASE WHEN page_id % 5 <> 0 THEN ip END AS ip_address",
        "'SEED' AS discovered_via",
        "'OTHER' AS sector",
        "CASE WHEN page_id % 4 = 1 THEN 'WordPress' END AS vendor_fingerprint",
        "CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN sha2(html, 256) ELSE sha2(concat(html, 'x'), 256) END AS baseline_hash",
        "concat('d', page_id) AS domain_id",
        "concat('AS', page_id % 90) AS asn",
        "concat('host', page_id % 5) AS hosting_provider",
        "CASE WHEN page_id % 4 = 2 THEN 'cdn' END AS cdn_detected",
        "'IN' AS country_code",
        *[f"page_id % {n} = 0 AS {c}" for n, c in enumerate(SIGNALS, 2)],
        f"{NOW} - make_dt_interval(CAST(page_id % 40 AS INT)) AS last_scanned_at",
        f"{NOW} + make_dt_interval(CAST(page_id % 31 AS INT)) AS next_scan_due_at",
        "CAST(page_id % 9 AS INT) AS scan_count",
        "CASE WHEN page_id % 3 = 0 THEN concat('security@s', page_id, '.example') END AS contact_email",
        "concat('{\"owner\":\"team', page_id, '\"}') AS notes",
        f"{NOW} - make_dt_interval(400) AS created_at",
        f"{NOW} - make_dt_interval(50) AS updated_at",
    )


# --------------------------------------------------------------------------
# Documents with planted values
# --------------------------------------------------------------------------

# Made-up values in parts; the first number has a valid check digit, the second not.
PLANTED = (
    "concat(' ', '2341', ' 2341 ', '2346', ' and ', '2341 2341', ' 2347 ')",
    "concat(' ABC', 'DE12', '34F ')",
    "concat(' ABC', '1234567', ' XYZ', '7654321 ')",
    "concat(' MH', '12 2011', ' 0062821 ', ' KA', '05 20१९', ' 1२34567 ')",
    "concat(' 91-', '1234-', '5678-', '9012 ', ' ८1-', '२२34-', '5678-', '901२ ')",
    "concat(' K', '1234567 ')",
    "concat(' AK', 'IA', 'ABCDEFGHIJKLMNOP ')",
    "concat(' sk_', 'live_', 'abcdefghijklmnopqrstuvwx ')",
    "concat(' -----BEGIN RSA ', 'PRIVATE KEY-----', ' MIIB ', '-----END RSA PRIVATE KEY----- ')",
    "concat(' \"pass', 'word\": \"hunter', '2abc\" ')",
    "repeat(concat(' 98', '76543210 '), 15)",
    "''",
)
KEYWORDS = (
    " aadhaar ", " income tax ", " voter ", " driving ", " abha ", " passport ", " aws ", " stripe ", " ", " ", " mobile ", " ",
)


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a planted value per rule, with its keyword for every second round."""
    keyword = pick("doc_id", *[f"'{k}'" for k in KEYWORDS])
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "source",
        f"concat(text, {pick('doc_id', *PLANTED)}, CASE WHEN (doc_id div 12) % 2 = 0 THEN {keyword} ELSE '' END) AS text",
    )


def augmented_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the same planted values."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"concat(html, {pick('page_id', *PLANTED)}) AS text")
