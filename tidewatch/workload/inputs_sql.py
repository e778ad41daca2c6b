"""The derived tables once more, as SQL for the comparison engine."""

from __future__ import annotations

from tidewatch.workload.inputs import KEYWORDS, NAME_SUFFIXES, PAGE_MARKERS


def pick(index: str, *values: str) -> str:
    return f"[{', '.join(values)}][({index}) % {len(values)} + 1]"


_TLD = pick("c_custkey", "'.gov.in'", "'.ac.in'", "'.co.in'", "'.in'", "'.com'", "'.nic.in'")
_NOW = "TIMESTAMP '2026-01-01 00:00:00'"

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` the named derived tables (and what they need) in front of a query."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for need in CTES[n][0]:
            visit(need)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    parts = ", ".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    stripped = body.strip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {parts}, {stripped[5:]}"
    return f"WITH {parts} {stripped}"


_cte(
    "domains",
    f"""
  SELECT c_custkey AS domain_id, 'org' || c_custkey || {_TLD} AS domain, {_TLD} AS tld,
         CAST(c_custkey % 101 AS INTEGER) AS iocs_score,
         {pick("c_custkey", "'PENDING'", "'ACTIVE'", "'ACTIVE'", "'ACTIVE'", "'INACTIVE'")} AS status,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'GOVERNMENT' WHEN 'AUTOMOBILE' THEN 'FINANCE'
              WHEN 'MACHINERY' THEN 'RESEARCH' WHEN 'HOUSEHOLD' THEN 'HEALTHCARE' ELSE 'EDUCATION' END AS sector,
         {pick("c_custkey", "NULL", "'WordPress 6.4.2'", "'Joomla 4.1'", "'Drupal 10'", "'Spring-Boot 2.7'", "'NIC-eGov'", "'WordPress'")} AS vendor_fingerprint,
         CASE WHEN c_custkey % 4 <> 0 THEN 'security@org' || c_custkey || '.example' END AS contact_email,
         '10.0.' || (c_custkey // 250) || '.' || (c_custkey % 250) AS ip_address,
         CASE WHEN c_custkey % 9 <> 0 THEN {_NOW} - to_days(CAST(c_custkey % 40 AS INTEGER)) END AS last_scanned_at,
         {_NOW} + to_days(CAST(c_custkey % 41 - 20 AS INTEGER)) AS next_scan_due_at,
         CAST(c_custkey % 12 AS INTEGER) AS scan_count,
         CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '{{"owner":"team' || c_custkey || '","risk_score":1}}'
              ELSE 'not json' END AS notes
  FROM customer""",
)
_SCORE = "CAST((60 + o_orderkey % 40) / 100.0 AS DECIMAL(4,3))"
_cte(
    "findings",
    f"""
  SELECT f.*,
         created_at + to_hours(CASE severity WHEN 'CRITICAL' THEN 24 WHEN 'HIGH' THEN 72 WHEN 'MEDIUM' THEN 168 ELSE 720 END) AS disclosure_sla_due,
         CASE WHEN status IN ('DISCLOSED','ESCALATED') THEN created_at + to_hours(1) END AS disclosed_at,
         CASE WHEN status = 'DISCLOSED' AND finding_id % 4 = 0 THEN created_at + to_hours(12) END AS acknowledged_at,
         CASE WHEN status = 'ESCALATED' THEN 3 ELSE 0 END AS escalation_level
  FROM (
    SELECT o_orderkey AS finding_id, o_custkey AS domain_id,
           'https://org' || o_custkey || '.example/p' || (o_orderkey % 13) AS url,
           '/p' || (o_orderkey % 13) AS url_path,
           {pick("o_orderkey", "'ENV_FILE'", "'GIT_REPO'", "'CREDIT_CARD'", "'DATABASE_DUMP'", "'OPEN_DIRECTORY'", "'OTHER'", "'EMAIL'")} AS entity_type,
           {pick("o_orderkey", "'ENV_FILE_EXPOSED'", "'GIT_REPO_EXPOSED'", "'CREDIT_CARD_IN_CONTENT'", "'DATABASE_DUMP_EXPOSED'", "'OPEN_DIRECTORY_LISTING'", "'ERROR_LOG_EXPOSED'", "'EMAIL_IN_CONTENT'")} AS finding_type,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
                WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' ELSE 'INFO' END AS severity,
           {pick("o_orderkey", "'NEW'", "'CONFIRMED'", "'DISCLOSED'", "'RESOLVED'", "'FALSE_POSITIVE'", "'ESCALATED'")} AS status,
           {_SCORE} AS heuristic_confidence,
           CASE WHEN o_orderkey % 5 <> 0 THEN {_SCORE} END AS final_confidence,
           o_orderkey % 11 = 0 AS dark_web_confirmed,
           {_NOW} - to_hours(CAST((o_orderkey * 37) % 1500 + 13 AS INTEGER)) AS created_at,
           CASE WHEN o_orderkey % 4 = 0 THEN 'seen before' END AS context_snippet_safe
    FROM orders) f""",
)
_cte(
    "scan_jobs",
    f"""
  SELECT o_orderkey AS job_id, o_custkey AS domain_id, 'org' || o_custkey AS domain_name,
         {pick("o_orderkey", "'PENDING'", "'RUNNING'", "'COMPLETED'", "'FAILED'", "'SKIPPED'")} AS status,
         109 AS urls_checked, CAST(o_orderkey % 7 AS INTEGER) AS findings_count,
         CAST(20000 + o_orderkey % 5000 AS INTEGER) AS duration_ms,
         {_NOW} - to_hours(CAST(o_orderkey % 2000 AS INTEGER)) AS created_at
  FROM orders""",
)
_cte(
    "audit_logs",
    "SELECT event_id AS id, upper(event_type) AS event_type, 'user' || user_id AS actor, props AS details, ts AS event_at FROM events",
)
_cte(
    "disclosure_events",
    """
  SELECT finding_id AS event_id, finding_id, 'security@org' || domain_id || '.example' AS recipient_email,
         'PRIMARY' AS recipient_type, 'Disclosure ' || finding_id AS subject,
         CASE WHEN finding_id % 10 = 2 THEN 'FAILED' ELSE 'SENT' END AS send_status,
         sha256('tok' || finding_id) AS ack_token, disclosed_at AS sent_at, disclosed_at AS created_at, acknowledged_at
  FROM findings WHERE disclosed_at IS NOT NULL""",
    "findings",
)
_cte(
    "breaches",
    """
  SELECT domain, CASE WHEN domain_id % 16 = 0 THEN '{"a' || domain_id || '":["b1","b2"],"z":"one"}'
                      ELSE '{"a' || domain_id || '":["b1"]}' END AS payload
  FROM domains WHERE domain_id % 8 = 0
  UNION ALL SELECT domain, '{"q":["b3"]}' FROM domains WHERE domain_id % 16 = 0""",
    "domains",
)
_cte(
    "host_vulns",
    """
  SELECT ip_address AS ip, range(1, domain_id % 30 + 2) AS open_ports,
         CASE WHEN domain_id % 2 = 0 THEN [] ELSE list_transform(range(1, domain_id % 13 + 2), lambda x: 'V-' || x) END AS vulns,
         'host' || (domain_id % 5) AS org
  FROM domains WHERE domain_id % 9 = 0""",
    "domains",
)
_cte(
    "contact_files",
    f"""
  SELECT domain, CAST(domain_id % 4 + 1 AS INTEGER) AS priority,
         CASE WHEN domain_id % 10 = 9 THEN 404 ELSE 200 END AS status,
         {pick(
             "domain_id",
             "'Contact: mailto:sec@' || domain || chr(10) || 'Expires: never'",
             "'# comment' || chr(10) || 'Contact: https://' || domain || '/report' || chr(13) || chr(10) || 'CONTACT:   abuse@' || domain",
             "'Contact: mailto:bad address' || chr(10)",
             "''",
             "'contact: mailto:a@' || domain || chr(10) || '  contact: b@' || domain",
         )} AS body
  FROM domains
  UNION ALL
  SELECT domain, 9, CASE WHEN domain_id % 2 = 0 THEN 200 ELSE 500 END, 'Contact: mailto:second@' || domain FROM domains""",
    "domains",
)

_HOST = "lower(regexp_extract(url, '//([^/:]*)', 1))"
_cte(
    "sites",
    f"""
  SELECT page_id, {_HOST} AS host,
         'p' || page_id || '.' || {_HOST} || {pick("page_id", *[f"'{s}'" for s in NAME_SUFFIXES])} AS domain,
         '10.' || (page_id % 200) || '.' || ((page_id // 200) % 250) || '.7' AS ip,
         html || {pick("page_id", *[f"'{m}'" for m in PAGE_MARKERS])} AS html, url
  FROM pages""",
)
_cte("resolutions", "SELECT domain AS name, ip FROM sites WHERE page_id % 7 <> 0", "sites")
_cte(
    "ip_geo",
    """
  SELECT ip, CASE WHEN page_id % 3 = 0 THEN 'AS9829 Example Net' ELSE 'AS98291 Other Net' END AS asn,
         CASE WHEN page_id % 2 = 0 THEN 'India' ELSE 'France' END AS country FROM sites""",
    "sites",
)
_SCHEME = "CASE WHEN page_id % 3 = 0 THEN 'http' ELSE 'https' END"
_cte(
    "captures",
    f"""
  SELECT domain, {_SCHEME} || '://' || CASE WHEN page_id % 6 = 1 THEN 'www.' WHEN page_id % 6 = 2 THEN 'cdn.' ELSE '' END || domain || '/' AS url,
         '/' AS path, {_SCHEME} AS scheme, CASE WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status,
         CASE WHEN page_id % 4 = 0 THEN 'server: nginx x-powered-by: PHP/8.1.' || (page_id % 10) ELSE 'server: nginx' END AS header_text,
         html AS body, {_NOW} - to_minutes(CAST(page_id % 10000 AS INTEGER)) AS fetched_at
  FROM sites
  UNION ALL
  SELECT domain, 'http://' || domain || '/', '/', 'http', 200, 'server: old', 'old page of ' || domain, {_NOW} - to_days(30)
  FROM sites
  UNION ALL
  SELECT domain, 'https://' || domain || '/.env', '/.env', 'https', 200, 'server: probe', 'APP_NAME=' || domain, {_NOW}
  FROM sites""",
    "sites",
)
_cte(
    "inventory",
    f"""
  SELECT domain, '.in' AS tld, CAST(page_id % 70 AS INTEGER) AS iocs_score,
         CASE WHEN page_id % 2 = 0 THEN 'PENDING' ELSE 'ACTIVE' END AS status,
         CASE WHEN page_id % 5 <> 0 THEN ip END AS ip_address, 'SEED' AS discovered_via, 'OTHER' AS sector,
         CASE WHEN page_id % 4 = 1 THEN 'WordPress' END AS vendor_fingerprint,
         CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 6 = 1 THEN sha256(html) ELSE sha256(html || 'x') END AS baseline_hash,
         'd' || page_id AS domain_id, 'AS' || (page_id % 90) AS asn, 'host' || (page_id % 5) AS hosting_provider,
         CASE WHEN page_id % 4 = 2 THEN 'cdn' END AS cdn_detected, 'IN' AS country_code,
         page_id % 2 = 0 AS signal_whois_in, page_id % 3 = 0 AS signal_ip_in, page_id % 4 = 0 AS signal_payment_gw,
         page_id % 5 = 0 AS signal_gst_number, page_id % 6 = 0 AS signal_lang_in, page_id % 7 = 0 AS signal_registry,
         {_NOW} - to_days(CAST(page_id % 40 AS INTEGER)) AS last_scanned_at, {_NOW} + to_days(CAST(page_id % 31 AS INTEGER)) AS next_scan_due_at,
         CAST(page_id % 9 AS INTEGER) AS scan_count, CASE WHEN page_id % 3 = 0 THEN 'security@s' || page_id || '.example' END AS contact_email,
         '{{"owner":"team' || page_id || '"}}' AS notes, {_NOW} - to_days(400) AS created_at, {_NOW} - to_days(50) AS updated_at
  FROM sites WHERE page_id % 3 <> 2""",
    "sites",
)
_PLANTED = (
    "' ' || '2341' || ' 2341 ' || '2346' || ' and ' || '2341 2341' || ' 2347 '",
    "' ABC' || 'DE12' || '34F '",
    "' ABC' || '1234567' || ' XYZ' || '7654321 '",
    "' MH' || '12 2011' || ' 0062821 ' || ' KA' || '05 20१९' || ' 1२34567 '",
    "' 91-' || '1234-' || '5678-' || '9012 ' || ' ८1-' || '२२34-' || '5678-' || '901२ '",
    "' K' || '1234567 '",
    "' AK' || 'IA' || 'ABCDEFGHIJKLMNOP '",
    "' sk_' || 'live_' || 'abcdefghijklmnopqrstuvwx '",
    "' -----BEGIN RSA ' || 'PRIVATE KEY-----' || ' MIIB ' || '-----END RSA PRIVATE KEY----- '",
    "' \"pass' || 'word\": \"hunter' || '2abc\" '",
    "repeat(' 98' || '76543210 ', 15)",
    "''",
)
_cte(
    "augmented",
    f"""
  SELECT doc_id, source, text || {pick("doc_id", *_PLANTED)} ||
         CASE WHEN (doc_id // 12) % 2 = 0 THEN {pick("doc_id", *[f"'{k}'" for k in KEYWORDS])} ELSE '' END AS text
  FROM documents""",
)
_cte("augmented_pages", f"SELECT page_id, html || {pick('page_id', *_PLANTED)} AS text FROM pages")
