"""Queries over sites, captures and name feeds derived from the pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.functions import text
from tidewatch.operators import corpus, names
from tidewatch.plans import refresh as plan
from tidewatch.session import checkpoint_root, handover, spread
from tidewatch.sources import captures as capture_source
from tidewatch.sources import feeds, lookups
from tidewatch.sources.buckets import BucketTable
from tidewatch.workload import inputs as I
from tidewatch.workload.inputs import AS_OF
from tidewatch.workload.inputs_sql import with_ctes
from tidewatch.workload.ledger_queries import NOW, Query, sql_ts, ts

QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = (fn, with_ctes(sql, *ctes) if sql and ctes else sql)
        return fn

    return add


# --------------------------------------------------------------------------
# SQL building blocks
# --------------------------------------------------------------------------


def _in_tlds(c: str, tlds) -> str:
    return "(" + " OR ".join(f"{c} = '{t[1:]}' OR {c} LIKE '%{t}'" for t in tlds) + ")"


def _tld_sql(c: str) -> str:
    longest = sorted([*rules.COUNTRY_TLDS, *rules.OTHER_TLDS], key=len, reverse=True)
    whens = " ".join(f"WHEN {c} = '{t[1:]}' OR {c} LIKE '%{t}' THEN '{t}'" for t in longest)
    return f"CASE {whens} ELSE '.in' END"


def _any_sector_sql(t: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, '{w}')" for w in words) + f" THEN '{s}'" for s, words in rules.SECTOR_KEYWORDS.items()
    )
    return f"CASE {whens} ELSE 'OTHER' END"


def _sector_sql(host: str, page: str | None = None) -> str:
    whens = []
    for sector, words in rules.SECTOR_KEYWORDS.items():
        plain, dotted, compound = corpus.sector_patterns(words)
        tests = []
        for text in filter(None, (host, page)):
            tests.append(f"list_has_any(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), {plain})")
            patterns = [dotted] + ([compound] if text == host else [])
            tests += [f"regexp_matches(lower({text}), '{p}')" for p in patterns if p]
        whens.append("WHEN " + " OR ".join(tests) + f" THEN '{sector}'")
    return f"CASE {' '.join(whens)} ELSE 'OTHER' END"


def _origin_sql(domain: str, html: str, asn: str) -> dict[str, str]:
    known = ", ".join(f"'{a}'" for a in rules.HOME_ASNS)
    return {
        "tld": _in_tlds(domain, rules.COUNTRY_TLDS),
        "pilot_tld_bonus": _in_tlds(domain, rules.PILOT_TLDS),
        "ip_geo_india": f"{asn} IS NOT NULL",
        "indian_asn": f"split_part({asn}, ' ', 1) IN ({known})",
        "devanagari_content": f"regexp_matches({html}, '[\\x{{0900}}-\\x{{097F}}]{{4,}}')",
        "hindi_meta": f"regexp_matches({html}, 'lang=[\"'']hi[\"'']|content-language.*hi', 'i')",
        "indian_phone": f"regexp_matches({html}, '(?:\\+91|0)[6-9]\\d{{9}}\\b')",
        "gst_number": f"regexp_matches({html}, '\\b\\d{{2}}[A-Z]{{5}}\\d{{4}}[A-Z]\\d[Z][A-Z0-9]\\b')",
        "payment_gateway": f"regexp_matches({html}, 'razorpay|paytm\\.com|cashfree|payu\\.in|ccavenue|instamojo|billdesk|easebuzz', 'i')",
    }


def _score_sql(domain: str, html: str, asn: str) -> str:
    tests = _origin_sql(domain, html, asn)
    flags = {n: f"CASE WHEN coalesce({t}, false) THEN 1 ELSE 0 END" for n, t in tests.items()}
    total = " + ".join(f"{rules.ORIGIN_POINTS[n]} * {f}" for n, f in flags.items())
    count = " + ".join(f for n, f in flags.items() if n != "pilot_tld_bonus")
    detail = "concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({t}, false) THEN '{n}={rules.ORIGIN_POINTS[n]}' END" for n, t in tests.items()) + ")"
    return f"least(100, {total}) AS iocs_score, {count} AS signal_count, {detail} AS detail"


# RE2 forms of the vendor signals, written out.
_VENDOR_SQL = (
    ("WordPress", "HIGH", 1, "WordPress[/ ]([0-9.]+)", ("/wp-content/(?:themes|plugins|uploads)/", "/wp-includes/", "wp-json/wp/v", "(?i)<meta[^>]+generator[^>]+WordPress", "(?i)wordpress")),
    ("Joomla", "HIGH", 1, "Joomla[!/ ]([0-9.]+)", ("/components/com_[a-z]", "/media/jui/", "/media/system/js/", "(?i)<meta[^>]+generator[^>]+Joomla", "(?i)joomla")),
    ("Drupal", "MEDIUM", 1, "Drupal[/ ]([0-9.]+)", ("Drupal\\.settings", "/sites/(?:default|all)/(?:files|modules|themes)/", "(?i)<meta[^>]+generator[^>]+Drupal", "(?i)drupal")),
    ("NIC-eGov", "MEDIUM", 1, None, ("(?i)National Informatics Centre", "(?i)eGov(?:ernance)?\\s+Framework", "(?i)NIC\\s+(?:eGov|Portal)")),
    ("Spring-Boot", "MEDIUM", 1, "Spring-Boot[/ ]([0-9.]+)", ("Whitelabel Error Page", "/actuator(?:/health)?", "(?i)Spring Framework")),
    ("Struts", "HIGH", 2, "Struts[/ ]([0-9.]+)", ("\\.action(\\?|$)", "(?i)struts", "(?i)org\\.apache\\.struts")),
    ("Magento", "HIGH", 1, "Magento[/ ]([0-9.]+)", ("/skin/frontend/", "Mage\\.", "(?i)magento")),
    ("Django", "LOW", 2, None, ("csrfmiddlewaretoken", "(?i)django")),
    ("Laravel", "LOW", 1, "Laravel[/ ]([0-9.]+)", ("laravel_session", "(?i)X-Powered-By.*Laravel", "(?i)laravel")),
    ("ASP.NET", "LOW", 1, "ASP\\.NET[/ ]([0-9.]+)", ("__VIEWSTATE", "__EVENTVALIDATION", "(?i)\\.aspx(\\?|$|#)", "(?i)X-AspNet-Version")),
    ("PHP", "LOW", 1, "PHP/([0-9.]+)", ("(?i)PHP/[0-9.]+",)),
    ("OpenCart", "MEDIUM", 1, "OpenCart[/ ]([0-9.]+)", ("/catalog/view/theme/", "route=common/home")),
    ("TYPO3", "MEDIUM", 1, "TYPO3[/ ]([0-9.]+)", ("(?i)typo3", "/typo3conf/")),
)


def _vendor_case(t: str, value) -> str:
    whens = []
    for row in _VENDOR_SQL:
        count = " + ".join(f"CAST(regexp_matches({t}, '{s}') AS INTEGER)" for s in row[4])
        whens.append(f"WHEN {count} >= {row[2]} THEN {value(row, count)}")
    return f"CASE {' '.join(whens)} END"


def _vendor_sql(t: str) -> str:
    def version(row, _count):
        return f"coalesce(nullif(regexp_extract({t}, '(?i){row[3]}', 1), ''), '')" if row[3] else "''"

    return f"""{_vendor_case(t, lambda r, _c: f"'{r[0]}'")} AS vendor_name, {_vendor_case(t, version)} AS vendor_version,
        {_vendor_case(t, lambda r, _c: f"'{r[1]}'")} AS vendor_risk, {_vendor_case(t, lambda _r, c: c)} AS vendor_signals"""


# The best capture per domain and the full refresh, shared by several queries.
_BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN scheme = 'https' THEN 0 ELSE 1 END,
    fetched_at DESC NULLS LAST, url) AS rn FROM captures WHERE path = '/' AND status < 500 AND scheme IN ('https','http')) WHERE rn = 1)"""
_SCORED = f"""{_BEST}, rs AS (SELECT name, min(ip) AS ip FROM resolutions GROUP BY 1), ge AS (SELECT ip, min(coalesce(asn, '')) AS asn FROM ip_geo WHERE country = 'India' GROUP BY 1),
    j AS (SELECT DISTINCT s.domain, rs.ip, CASE WHEN {_in_tlds("s.domain", rules.COUNTRY_TLDS)} THEN '' ELSE ge.asn END AS asn, b.body AS html, b.header_text
       FROM sites s LEFT JOIN rs ON rs.name = s.domain LEFT JOIN ge ON ge.ip = rs.ip LEFT JOIN best b ON b.domain = s.domain),
    sc AS (SELECT *, {_score_sql('domain', 'html', 'asn')} FROM j),
    vf AS (SELECT *, html || chr(10) || header_text AS page FROM sc),
    fp AS (SELECT *, {_vendor_sql("nullif(page, '')")} FROM vf),
    scored AS (SELECT domain, {_tld_sql('domain')} AS tld, ip AS ip_address, iocs_score, signal_count, detail,
       CASE WHEN vendor_name IS NOT NULL THEN rtrim(vendor_name || ' ' || vendor_version) END AS vendor_fingerprint, CASE WHEN length(html) > 0 THEN sha256(html) END AS baseline_hash,
       {_sector_sql("domain", "coalesce(html, '')")} AS sector,
       CASE WHEN ip IS NULL THEN 'skipped_dns' WHEN NOT (iocs_score >= 50 AND signal_count >= 2) THEN 'skipped_iocs' ELSE 'candidate' END AS outcome FROM fp)"""
# Columns of the inventory that an upsert leaves as they are, and its times.
_CARRIED = (
    "asn", "hosting_provider", "cdn_detected", "country_code", "contact_email", "notes",
    "signal_ip_in", "signal_payment_gw", "signal_gst_number", "signal_lang_in", "signal_registry",
)
_TIMES = ("last_scanned_at", "next_scan_due_at", "created_at", "updated_at")
_SCORED_CTES = ("sites", "resolutions", "ip_geo", "captures", "inventory")


def _upsert_sql(incoming: str, via: str) -> str:
    return f"""u AS (SELECT coalesce(o.domain, n.domain) AS domain, o.domain IS NULL AS is_new, n.domain IS NOT NULL AS is_named,
      o.status AS ostatus, o.ip_address AS oip, o.iocs_score AS oscore, o.vendor_fingerprint AS ovendor, o.baseline_hash AS ohash, o.tld AS otld, o.sector AS osector, o.discovered_via AS ovia, o.domain_id AS oid, o.signal_whois_in AS owhois, o.scan_count AS oscans,
      o.next_scan_due_at AS onext, o.created_at AS ocreated, o.updated_at AS oupdated, {', '.join(f'o.{c}' for c in _CARRIED)}, o.last_scanned_at,
      n.tld AS ntld, n.sector AS nsector, coalesce(nullif(o.ip_address, ''), n.ip_address) AS ip, greatest(coalesce(o.iocs_score, 0), coalesce(n.iocs_score, 0)) AS score,
      coalesce(n.vendor_fingerprint, o.vendor_fingerprint) AS vendor, coalesce(n.baseline_hash, o.baseline_hash) AS hash,
      CASE WHEN o.domain IS NULL THEN CASE WHEN n.iocs_score >= 50 THEN 'ACTIVE' ELSE 'PENDING' END WHEN o.status = 'PENDING' AND n.iocs_score >= 50 THEN 'ACTIVE' ELSE o.status END AS st
      FROM inventory o FULL OUTER JOIN ({incoming}) n ON o.domain = n.domain),
    up0 AS (SELECT *, CASE WHEN is_new THEN ntld ELSE otld END AS tld, CASE WHEN is_named THEN score ELSE oscore END AS iocs_score, st AS status, CASE WHEN is_named THEN ip ELSE oip END AS ip_address,
      CASE WHEN is_new THEN '{via}' ELSE ovia END AS discovered_via, CASE WHEN is_new THEN nsector ELSE osector END AS sector, vendor AS vendor_fingerprint, hash AS baseline_hash,
      CASE WHEN NOT is_named THEN 'kept' WHEN is_new THEN 'created' WHEN ip IS NOT DISTINCT FROM oip AND score IS NOT DISTINCT FROM coalesce(oscore, 0) AND vendor IS NOT DISTINCT FROM ovendor
        AND hash IS NOT DISTINCT FROM ohash AND st IS NOT DISTINCT FROM ostatus THEN 'unchanged' ELSE 'updated' END AS action FROM u),
    up AS (SELECT *, CASE WHEN is_new THEN sha256(domain) ELSE oid END AS domain_id, CASE WHEN is_new THEN {_in_tlds('domain', rules.COUNTRY_TLDS)} ELSE owhois END AS signal_whois_in,
      CASE WHEN is_new THEN 0 ELSE oscans END AS scan_count, CASE WHEN is_new THEN {NOW} ELSE onext END AS next_scan_due_at,
      CASE WHEN is_new THEN {NOW} ELSE ocreated END AS created_at, CASE WHEN action IN ('created', 'updated') THEN {NOW} ELSE oupdated END AS updated_at FROM up0)"""


_UP_OUT = f"""SELECT domain_id, signal_whois_in, scan_count, {', '.join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in _CARRIED)},
    {', '.join(f"coalesce({sql_ts(c)}, '') AS {c}" for c in _TIMES)}, domain, tld, iocs_score, status, coalesce(ip_address, '') AS ip_address, discovered_via, sector, coalesce(vendor_fingerprint, '') AS vendor_fingerprint, coalesce(baseline_hash, '') AS baseline_hash, action FROM up"""


def _up_out(df):
    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("ip_address", "vendor_fingerprint", "baseline_hash")]
    filled += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _CARRIED]
    filled += [F.coalesce(ts(c), F.lit("")).alias(c) for c in _TIMES]
    same = ("domain_id", "domain", "tld", "iocs_score", "status", "discovered_via", "sector", "signal_whois_in", "scan_count")
    return df.select(*same, "action", *filled)


def _names(spark, sf):
    return I.sites(spark, sf).select(F.col("domain").alias("name"))


def _world(spark, sf):
    return I.resolutions(spark, sf), I.ip_geo(spark, sf), I.captures(spark, sf)


# --------------------------------------------------------------------------
# Hosts, TLDs, sectors
# --------------------------------------------------------------------------


@query(
    "host_canonical",
    """WITH h AS (SELECT domain, url, rtrim(lower(split_part(split_part(regexp_extract(url, '.*//(.*)$', 1), '/', 1), ':', 1)), '.') AS host FROM captures)
       SELECT domain, url, CASE WHEN host = domain OR host = 'www.' || domain OR host = replace(domain, 'www.', '') THEN host ELSE domain END AS host FROM h""",
    "captures",
)
def host_canonical(spark, sf):
    rows = I.captures(spark, sf)
    return rows.select("domain", "url", text.canonical_host(F.col("url"), F.col("domain")).alias("host"))


@query("page_hosts", "SELECT page_id, rtrim(lower(regexp_extract(url, '//([^/:]*)', 1)), '.') AS host FROM pages")
def page_hosts(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query("rule_urls", "SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/.env' AS rule_url FROM pages")
def rule_urls(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", text.join_path(F.col("url"), F.lit("/.env")).alias("rule_url"))


@query("tld_classify", f"SELECT domain, {_tld_sql('domain')} AS tld FROM sites", "sites")
def tld_classify(spark, sf):
    return I.sites(spark, sf).select("domain", text.tld_class(F.col("domain"), rules.OTHER_TLDS).alias("tld"))


@query(
    "government_names",
    "SELECT domain, domain LIKE '%.gov.in' OR domain LIKE '%.nic.in' OR domain IN ('gov.in', 'nic.in') AS is_government FROM sites",
    "sites",
)
def government_names(spark, sf):
    return I.sites(spark, sf).select("domain", text.is_government(F.col("domain")).alias("is_government"))


@query("sector_infer", f"""SELECT domain, {_sector_sql("domain", "html")} AS sector FROM sites""", "sites")
def sector_infer(spark, sf):
    rows = spread(I.sites(spark, sf), "page_id")
    return rows.select("domain", corpus.infer_sector(F.col("domain"), F.col("html")).alias("sector"))


@query("sector_infer_anywhere", f"""SELECT domain, {_any_sector_sql("(lower(domain) || ' ' || html)")} AS sector FROM sites""", "sites")
def sector_infer_anywhere(spark, sf):
    """The loose form: keywords also inside other words."""
    rows = spread(I.sites(spark, sf), "page_id")
    return rows.select("domain", corpus.infer_sector(F.col("domain"), F.col("html"), strict=False).alias("sector"))


# Documents as pages of hosts whose labels join, border or merely contain keywords.
_HOSTS = ["tech-community", "digital.gov.in", "citybank", "bankruptcy", "dept-of-x", "praxis", "mu.ac.in", "emu.example", "sbi.co.in", "res.in", "hospitality", "x-hospital"]
_WORDS = ["technical community", "The Ministry of X", "embankment", "online BANK login", "department store", "a college.", "universityx", "HEALTH care"]


@query(
    "sector_infer_documents",
    f"""WITH c AS (SELECT doc_id, {_HOSTS}[CAST(doc_id % {len(_HOSTS)} AS INTEGER) + 1] || '.example' AS host,
          text || ' ' || {_WORDS}[CAST(doc_id // 3 % {len(_WORDS)} AS INTEGER) + 1] AS page FROM documents)
        SELECT doc_id, {_sector_sql("host", "page")} AS sector FROM c""",
)
def sector_infer_documents(spark, sf):
    docs = I.table(spark, sf, "documents")
    host = F.concat(F.element_at(F.array(*map(F.lit, _HOSTS)), (F.col("doc_id") % len(_HOSTS) + 1).cast("int")), F.lit(".example"))
    word = F.element_at(F.array(*map(F.lit, _WORDS)), (F.expr("doc_id div 3") % len(_WORDS) + 1).cast("int"))
    rows = docs.select("doc_id", host.alias("host"), F.concat("text", F.lit(" "), word).alias("page"))
    return rows.select("doc_id", corpus.infer_sector(F.col("host"), F.col("page")).alias("sector"))


@query(
    "sector_infer_names",
    f"SELECT domain_id, {_sector_sql('lower(domain)')} AS sector FROM domains",
    "domains",
)
def sector_infer_names(spark, sf):
    return I.domains(spark, sf).select("domain_id", corpus.infer_sector(F.col("domain")).alias("sector"))


# --------------------------------------------------------------------------
# Captures, look-ups
# --------------------------------------------------------------------------


@query("best_capture", f"WITH {_BEST} SELECT domain, url, scheme, status FROM best", "captures")
def best_capture(spark, sf):
    return capture_source.best_capture(I.captures(spark, sf)).select("domain", "url", "scheme", "status")


@query(
    "base_urls",
    f"""WITH {_BEST}, h AS (SELECT domain, scheme, rtrim(lower(split_part(split_part(regexp_extract(url, '.*//(.*)$', 1), '/', 1), ':', 1)), '.') AS host FROM best)
        SELECT domain, scheme || '://' || CASE WHEN host IN (domain, 'www.' || domain) THEN host ELSE domain END AS base_url FROM h""",
    "captures",
)
def base_urls(spark, sf):
    return capture_source.base_urls(I.captures(spark, sf)).select("domain", "base_url")


@query(
    "header_match",
    "SELECT url, header_text, contains(lower(header_text), 'x-powered-by: php/') AS has_php FROM captures",
    "captures",
)
def header_match(spark, sf):
    header = text.header_text(F.col("headers"))
    return I.captures(spark, sf).select("url", header.alias("header_text"), F.contains(F.lower(header), F.lit("x-powered-by: php/")).alias("has_php"))


@query(
    "geo_lookup",
    """WITH g AS (SELECT ip, min(coalesce(asn, '')) AS asn FROM ip_geo WHERE country = 'India' GROUP BY 1)
       SELECT name, ip, coalesce(asn, 'none') AS asn FROM resolutions LEFT JOIN g USING (ip)""",
    "resolutions",
    "ip_geo",
)
def geo_lookup(spark, sf):
    rows = lookups.home_asn(I.resolutions(spark, sf), I.ip_geo(spark, sf))
    return rows.select("name", "ip", F.coalesce("asn", F.lit("none")).alias("asn"))


@query(
    "resolve_names",
    "SELECT s.domain AS name, coalesce(r.ip, 'none') AS ip FROM sites s LEFT JOIN (SELECT name, min(ip) AS ip FROM resolutions GROUP BY 1) r ON r.name = s.domain",
    "sites",
    "resolutions",
)
def resolve_names(spark, sf):
    rows = lookups.resolve(_names(spark, sf), I.resolutions(spark, sf))
    return rows.select("name", F.coalesce("ip", F.lit("none")).alias("ip"))


# --------------------------------------------------------------------------
# Scoring and fingerprints
# --------------------------------------------------------------------------


def _origin(spark, sf):
    """Scores of the sites; the page text is reduced to signals before the join."""
    signals = spread(I.sites(spark, sf), "page_id").select("domain", "ip", corpus.content_signals(F.col("html")).alias("content"))
    return corpus.origin_score(lookups.home_asn(signals, I.ip_geo(spark, sf)), "domain", F.col("content"), "asn")


@query(
    "origin_score",
    f"""WITH g AS (SELECT ip, min(coalesce(asn, '')) AS asn FROM ip_geo WHERE country = 'India' GROUP BY 1)
        SELECT domain, {_score_sql('domain', 'html', 'asn')} FROM sites LEFT JOIN g USING (ip)""",
    "sites",
    "ip_geo",
)
def origin_score(spark, sf):
    scored = _origin(spark, sf)
    order = F.array(*[F.lit(n) for n in rules.ORIGIN_POINTS])
    kept = F.filter(order, lambda n: F.map_contains_key("signal_detail", n))
    detail = F.array_join(F.transform(kept, lambda n: F.concat(n, F.lit("="), F.element_at("signal_detail", n).cast("string"))), ",")
    return scored.select("domain", "iocs_score", "signal_count", detail.alias("detail"))


@query(
    "corpus_gate",
    f"""WITH g AS (SELECT ip, min(coalesce(asn, '')) AS asn FROM ip_geo WHERE country = 'India' GROUP BY 1),
        s AS (SELECT domain, {_score_sql('domain', 'html', 'asn')} FROM sites LEFT JOIN g USING (ip))
        SELECT domain FROM s WHERE iocs_score >= 50 AND signal_count >= 2""",
    "sites",
    "ip_geo",
)
def corpus_gate(spark, sf):
    scored = _origin(spark, sf)
    return scored.filter(corpus.passes_gate(F.col("iocs_score"), F.col("signal_count"))).select("domain")


@query(
    "vendor_fingerprint",
    f"""WITH p AS (SELECT domain, url, CASE WHEN length(body) > 0 THEN body || chr(10) || header_text END AS page FROM captures), v AS (SELECT url, {_vendor_sql('page')} FROM p)
        SELECT url, vendor_name, vendor_version, vendor_risk, CAST(vendor_signals AS INTEGER) AS vendor_signals FROM v WHERE vendor_name IS NOT NULL""",
    "captures",
)
def vendor_fingerprint(spark, sf):
    found = corpus.fingerprint(spread(I.captures(spark, sf), "url"), "body", F.col("headers"))
    return found.select(
        "url", "vendor_name", F.coalesce("vendor_version", F.lit("")).alias("vendor_version"), "vendor_risk", "vendor_signals"
    ).filter("vendor_name IS NOT NULL")


def _two_versions(spark, sf):
    """Each site twice: the stored hash is of the page, missing, or of another version."""
    return I.sites(spark, sf).selectExpr(
        "page_id AS domain_id",
        "domain",
        "html",
        "CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha2(html, 256) ELSE sha2(concat(html, '!'), 256) END AS baseline_hash",
        "CASE WHEN page_id % 2 = 0 THEN 'OldVendor 1.0' END AS vendor_fingerprint",
        "'ACTIVE' AS status",
    )


_VERSIONS = """tv AS (SELECT page_id AS domain_id, domain, html, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(html) ELSE sha256(html || '!') END AS baseline_hash,
    CASE WHEN page_id % 2 = 0 THEN 'OldVendor 1.0' END AS vendor_fingerprint FROM sites)"""


@query(
    "content_changed",
    f"WITH {_VERSIONS} SELECT domain_id, baseline_hash IS NOT NULL AND baseline_hash <> sha256(html) AS changed FROM tv",
    "sites",
)
def content_changed(spark, sf):
    rows = _two_versions(spark, sf)
    changed = corpus.content_changed(F.col("baseline_hash"), text.content_hash(F.col("html")))
    return rows.select("domain_id", changed.alias("changed"))


@query(
    "refingerprint",
    f"""WITH {_VERSIONS}, v AS (SELECT *, {_vendor_sql('html')} FROM tv)
        SELECT domain_id, coalesce(rtrim(vendor_name || ' ' || vendor_version), vendor_fingerprint, '') AS vendor_fingerprint, sha256(html) AS baseline_hash,
          baseline_hash IS NOT NULL AND baseline_hash <> sha256(html) AS content_changed FROM v""",
    "sites",
)
def refingerprint(spark, sf):
    rows = spread(_two_versions(spark, sf), "domain_id")
    pages = rows.select("domain", "html", F.expr("CAST(NULL AS map<string,string>)").alias("headers"))
    out = corpus.refingerprint(rows.drop("html"), pages, AS_OF)
    return out.select("domain_id", F.coalesce("vendor_fingerprint", F.lit("")).alias("vendor_fingerprint"), "baseline_hash", "content_changed")


# --------------------------------------------------------------------------
# Upsert and refresh
# --------------------------------------------------------------------------

_INCOMING = """SELECT domain, '.co.in' AS tld, CAST(page_id * 7 % 101 AS INTEGER) AS iocs_score, ip AS ip_address, 'FINANCE' AS sector,
    CASE WHEN page_id % 4 = 3 THEN 'Drupal 10' END AS vendor_fingerprint, CASE WHEN page_id % 8 <> 1 THEN sha256(html) END AS baseline_hash FROM sites"""


@query("corpus_upsert", f"WITH {_upsert_sql(_INCOMING, 'CT_LOG')} {_UP_OUT}", "sites", "inventory")
def corpus_upsert(spark, sf):
    return _up_out(corpus.upsert_domains(I.inventory(spark, sf), _incoming(spark, sf), AS_OF))


def _incoming(spark, sf):
    return I.sites(spark, sf).selectExpr(
        "domain", "'.co.in' AS tld", "CAST(page_id * 7 % 101 AS INT) AS iocs_score", "ip AS ip_address", "'CT_LOG' AS discovered_via",
        "'FINANCE' AS sector", "CASE WHEN page_id % 4 = 3 THEN 'Drupal 10' END AS vendor_fingerprint",
        "CASE WHEN page_id % 8 <> 1 THEN sha2(html, 256) END AS baseline_hash",
    )


@query("bucketed_upsert", f"WITH {_upsert_sql(_INCOMING, 'CT_LOG')} SELECT * EXCLUDE (action) FROM ({_UP_OUT})", "sites", "inventory")
def bucketed_upsert(spark, sf):
    """The inventory in hash buckets after the upsert, read back; a second upsert of the same rows changes nothing."""
    before = I.inventory(spark, sf)
    inventory = BucketTable(f"{checkpoint_root(spark)}/inventory-{uuid.uuid4().hex}", before.schema, ("domain",), 32)
    inventory.create(before)
    version = 0
    for _ in range(2):
        version, _merged = corpus.upsert_buckets(inventory, version, _incoming(spark, sf), AS_OF)
    return _up_out(inventory.read(spark, version).withColumn("action", F.lit(""))).drop("action")


@query(
    "score_names",
    f"""WITH {_SCORED} SELECT domain, tld, coalesce(ip_address, '') AS ip_address, iocs_score, signal_count, coalesce(vendor_fingerprint, '') AS vendor, sector, outcome FROM scored""",
    *_SCORED_CTES,
)
def score_names(spark, sf):
    scored = plan.score_names(_names(spark, sf), *_world(spark, sf))
    return scored.select(
        "domain", "tld", F.coalesce("ip_address", F.lit("")).alias("ip_address"), "iocs_score", "signal_count",
        F.coalesce("vendor_fingerprint", F.lit("")).alias("vendor"), "sector", "outcome",
    )


@query(
    "corpus_refresh",
    f"WITH {_SCORED}, {_upsert_sql(chr(10).join(['SELECT * FROM scored', 'WHERE outcome = ' + repr('candidate')]), 'CT_LOG')} {_UP_OUT}",
    *_SCORED_CTES,
)
def corpus_refresh(spark, sf):
    scored = plan.score_names(_names(spark, sf), *_world(spark, sf))
    return _up_out(plan.refresh(scored, I.inventory(spark, sf), AS_OF))


@query(
    "refresh_counters",
    f"""WITH {_SCORED}, {_upsert_sql("SELECT * FROM scored WHERE outcome = 'candidate'", 'CT_LOG')}
        SELECT CASE WHEN action = 'created' THEN 'new' ELSE action END AS outcome, count(*) AS n FROM up WHERE action <> 'kept' GROUP BY 1
        UNION ALL SELECT outcome, count(*) FROM scored WHERE outcome <> 'candidate' GROUP BY 1""",
    *_SCORED_CTES,
)
def refresh_counters(spark, sf):
    scored = handover(plan.score_names(_names(spark, sf), *_world(spark, sf)), "scored")
    return plan.refresh_counters(scored, plan.refresh(scored, I.inventory(spark, sf), AS_OF))


@query(
    "refresh_audit",
    f"""WITH {_SCORED}, {_upsert_sql("SELECT * FROM scored WHERE outcome = 'candidate'", 'CT_LOG')},
        c AS (SELECT CASE WHEN action = 'created' THEN 'new' ELSE action END AS outcome, count(*) AS n FROM up WHERE action <> 'kept' GROUP BY 1
              UNION ALL SELECT outcome, count(*) FROM scored WHERE outcome <> 'candidate' GROUP BY 1)
        SELECT 'CORPUS_REFRESH_COMPLETED' AS event_type, 'SYSTEM' AS actor, '{{' || string_agg('"' || outcome || '":' || n, ',' ORDER BY outcome) || '}}' AS details FROM c""",
    *_SCORED_CTES,
)
def refresh_audit(spark, sf):
    scored = handover(plan.score_names(_names(spark, sf), *_world(spark, sf)), "scored")
    counters = plan.refresh_counters(scored, plan.refresh(scored, I.inventory(spark, sf), AS_OF))
    return plan.audit_refresh(counters, AS_OF).select("event_type", "actor", "details")


_UNGATED = _SCORED.replace(
    f"CASE WHEN {_in_tlds('s.domain', rules.COUNTRY_TLDS)} THEN '' ELSE ge.asn END AS asn", "ge.asn AS asn"
)


@query("add_domains", f"WITH {_UNGATED}, {_upsert_sql('SELECT * FROM scored', 'MANUAL')} {_UP_OUT}", *_SCORED_CTES)
def add_domains(spark, sf):
    return _up_out(plan.add_domains(_names(spark, sf), I.inventory(spark, sf), *_world(spark, sf), AS_OF))


@query(
    "ingest_names",
    f"WITH {_SCORED}, {_upsert_sql('SELECT * FROM scored WHERE ip_address IS NOT NULL', 'SUBDOMAIN_ENUM')} {_UP_OUT}",
    *_SCORED_CTES,
)
def ingest_names(spark, sf):
    return _up_out(plan.ingest_names(_names(spark, sf), I.inventory(spark, sf), *_world(spark, sf), AS_OF))


# --------------------------------------------------------------------------
# Name feeds: one payload row per page
# --------------------------------------------------------------------------

# Per shape: Spark payload expression, SQL payload expression, SQL for the raw names.
_NAMES = ("concat('P', page_id, '.', host)", "host", "concat('*.', host)", "concat('x', page_id, '.other.example')", "concat(' p', page_id, '.', host, ' ')")
_NAMES_SQL = ("'P' || page_id || '.' || host", "host", "'*.' || host", "'x' || page_id || '.other.example'", "' p' || page_id || '.' || host || ' '")


def _payload(parts: tuple[str, ...], before: str, between: str, after: str, each: tuple[str, str] = ("", "")) -> tuple[str, str]:
    """The same text built in both dialects."""

    def lit(x: str) -> str:
        return "'" + x.replace("\\", "\\\\") + "'"

    def sql_lit(x: str) -> str:
        return "'" + x.replace("\n", "' || chr(10) || '") + "'"

    spark_items = f", {lit(between)}, ".join(f"{lit(each[0])}, {p}, {lit(each[1])}" for p in parts)
    duck = [_NAMES_SQL[_NAMES.index(p)] if p in _NAMES else p for p in parts]
    sql_items = f" || {sql_lit(between)} || ".join(f"{sql_lit(each[0])} || {p} || {sql_lit(each[1])}" for p in duck)
    return (
        f"concat({lit(before)}, {spark_items}, {lit(after)})".replace("\n", "\\n"),
        f"{sql_lit(before)} || {sql_items} || {sql_lit(after)}",
    )


_QUOTED = ('"', '"')
_SHAPES = {
    "ct": (_payload(_NAMES, "", "\n", "\n\n"), "ltrim(trim(x), '*.')", "regexp_split_to_array(lower(payload), '\n')"),
    "passive_dns": (_payload(_NAMES, '{"passive_dns":[', ",", "]}", ('{"hostname":"', '"}')), "lower(trim(x))", "CAST(json_extract_string(payload, '$.passive_dns[*].hostname') AS VARCHAR[])"),
    "list_name": (_payload(_NAMES, '{"list":[', ",", "]}", ('{"name":"', '"}')), "lower(trim(x))", "CAST(json_extract_string(payload, '$.list[*].name') AS VARCHAR[])"),
    "data_id": (_payload(_NAMES, '{"data":[', ",", "]}", ('{"id":"', '"}')), "lower(trim(x))", "CAST(json_extract_string(payload, '$.data[*].id') AS VARCHAR[])"),
    "records_domain": (_payload(_NAMES, '{"result":{"records":[', ",", "]}}", ('{"domain":"', '"}')), "lower(trim(x))", "CAST(json_extract_string(payload, '$.result.records[*].domain') AS VARCHAR[])"),
    "nested_names": (_payload(_NAMES, '{"result":{"hits":[{"parsed.names":[', ",", ']},{"other":1}]}}', _QUOTED), "ltrim(lower(trim(x)), '*.')", "CAST(json_extract_string(payload, '$.result.hits[*].\"parsed.names\"[*]') AS VARCHAR[])"),
    "plain_names": (_payload(_NAMES, '{"subdomains":[', ",", "]}", _QUOTED), "lower(trim(x))", "CAST(json_extract_string(payload, '$.subdomains[*]') AS VARCHAR[])"),
    "events": (_payload(_NAMES, '{"events":[', ",", "]}", _QUOTED), "lower(trim(x))", "CAST(json_extract_string(payload, '$.events[*]') AS VARCHAR[])"),
    "csv_lines": (_payload(_NAMES, "", ",10.0.0.1\n", ",10.0.0.2"), "lower(trim(split_part(x, ',', 1)))", "regexp_split_to_array(payload, '\n')"),
    "csv_in_json": (_payload(_NAMES, '{"Results":[', ",", "]}", ('"10.0.0.1,', '"')), "lower(trim(x))", "flatten(list_transform(CAST(json_extract_string(payload, '$.Results[*]') AS VARCHAR[]), lambda r: string_split(r, ',')))"),
}
_LABEL_PAYLOAD = ("""concat('{"subdomains":["P', page_id, '","www"]}')""", """'{"subdomains":["P' || page_id || '","www"]}'""")
_CELL_PAYLOAD = (
    "concat('<tr><td>P', page_id, '.', host, '</td><td>', host, '</td><td>x.other.example</td></tr>')",
    "'<tr><td>P' || page_id || '.' || host || '</td><td>' || host || '</td><td>x.other.example</td></tr>'",
)
_SOURCE_OF = {shape: name for name, shape, _key in reversed(rules.FEEDS)}


def _feed_sql(shape: str) -> str:
    if shape == "labels":
        return f"""SELECT page_id, host AS root, lower(unnest(CAST(json_extract_string({_LABEL_PAYLOAD[1]}, '$.subdomains[*]') AS VARCHAR[])) || '.' || host) AS name FROM sites"""
    if shape == "html_cells":
        inner = f"SELECT page_id, host AS root, unnest(regexp_extract_all({_CELL_PAYLOAD[1]}, '<td>([a-zA-Z0-9._-]+)</td>', 1)) AS name FROM sites"
        return f"SELECT page_id, root, lower(name) AS name FROM ({inner}) WHERE name LIKE '%.' || root"
    (_spark, payload), norm, raw = _SHAPES[shape]
    inner = f"SELECT page_id, root, unnest({raw}) AS x FROM (SELECT page_id, host AS root, {payload} AS payload FROM sites)"
    named = f"SELECT page_id, root, {norm} AS name FROM ({inner})"
    return f"SELECT page_id, root, name FROM ({named}) WHERE name <> '' AND (name = root OR name LIKE '%.' || root)"


def _feed(spark, sf, shape: str):
    payload = {"labels": _LABEL_PAYLOAD[0], "html_cells": _CELL_PAYLOAD[0]}.get(shape) or _SHAPES[shape][0][0]
    return I.sites(spark, sf).selectExpr(f"'{_SOURCE_OF[shape]}' AS source", "host AS root", f"{payload} AS payload")


def _register_feed(shape: str) -> None:
    sql = f"SELECT root, name, count(*) AS n FROM ({_feed_sql(shape)}) GROUP BY 1, 2"

    @query(f"feed_{shape}", sql, "sites")
    def run(spark, sf):
        return feeds.SHAPES[shape](_feed(spark, sf, shape)).groupBy("root", "name").agg(F.count(F.lit(1)).alias("n"))


for _shape in feeds.SHAPES:
    _register_feed(_shape)


@query(
    "ct_names",
    r"""WITH r AS (SELECT unnest(string_split(lower('*.' || host || chr(10) || 'P' || page_id || '.' || host || chr(10) || 'bad name' || chr(10) || 'ab' || chr(10)), chr(10))) AS x FROM sites),
       n AS (SELECT trim(ltrim(trim(x), '*.')) AS name FROM r) SELECT DISTINCT name FROM n WHERE length(name) > 3 AND NOT contains(name, ' ')""",
    "sites",
)
def ct_names(spark, sf):
    entries = I.sites(spark, sf).selectExpr(
        "page_id AS entry_id", r"concat('*.', host, '\nP', page_id, '.', host, '\nbad name\nab\n') AS name_value"
    )
    return feeds.ct_names(entries)


def _all_feeds(spark, sf):
    out = None
    for shape in feeds.SHAPES:
        part = _feed(spark, sf, shape)
        out = part if out is None else out.unionByName(part)
    return out


_KEYED = {"labels", "nested_names", "list_name", "data_id", "events", "records_domain"}
_PARSED = " UNION ALL ".join(
    f"SELECT '{_SOURCE_OF[s]}' AS source, root, name FROM ({_feed_sql(s)})" for s in feeds.SHAPES if s not in _KEYED or s == "labels"
)


@query("name_consolidate", f"WITH n AS ({_PARSED}) SELECT DISTINCT root, name FROM n", "sites")
def name_consolidate(spark, sf):
    return names.consolidate(feeds.parse_feeds(_all_feeds(spark, sf), configured=("Shodan",)))


@query("source_stats", f"WITH n AS ({_PARSED}) SELECT root, source, count(DISTINCT name) AS n_names FROM n GROUP BY 1, 2", "sites")
def source_stats(spark, sf):
    return names.source_stats(feeds.parse_feeds(_all_feeds(spark, sf), configured=("Shodan",)))


@query(
    "enumeration_audit",
    f"""WITH n AS ({_PARSED}), c AS (SELECT source, count(*) AS k FROM (SELECT DISTINCT root, source, name FROM n) GROUP BY 1)
        SELECT 'SUBDOMAIN_ENUM_COMPLETED' AS event_type, '{{' || string_agg('"' || source || '":' || k, ',' ORDER BY source) || '}}' AS details FROM c""",
    "sites",
)
def enumeration_audit(spark, sf):
    stats = names.source_stats(feeds.parse_feeds(_all_feeds(spark, sf), configured=("Shodan",)), by_root=False)
    return plan.audit_enumeration(stats, AS_OF).select("event_type", "details")


@query(
    "feed_availability",
    "SELECT source, count(*) AS n_payloads FROM sites, (VALUES "
    + ", ".join(f"('{_SOURCE_OF[s]}')" for s in feeds.SHAPES if s not in _KEYED or s == "labels")
    + ") v(source) GROUP BY source",
    "sites",
)
def feed_availability(spark, sf):
    kept = feeds.available_feeds(_all_feeds(spark, sf), feeds.feed_config(spark, configured=("Shodan",)))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_payloads"))


@query(
    "names_resolving",
    "WITH n AS (SELECT DISTINCT host AS root, 'p' || page_id || '.' || host AS name FROM sites) SELECT root, name FROM n WHERE name IN (SELECT name FROM resolutions)",
    "sites",
    "resolutions",
)
def names_resolving(spark, sf):
    found = I.sites(spark, sf).selectExpr("host AS root", "concat('p', page_id, '.', host) AS name")
    return names.resolving(names.consolidate(found), I.resolutions(spark, sf))


@query(
    "candidate_names",
    """WITH w AS (SELECT DISTINCT split_part(domain, '.', 1) AS word FROM sites), r AS (SELECT DISTINCT host || CASE WHEN page_id % 5 = 1 THEN '.co.in' ELSE '' END AS root FROM sites)
       SELECT r.root, w.word || '.' || r.root AS name FROM w, r WHERE w.word || '.' || r.root IN (SELECT name FROM resolutions)""",
    "sites",
    "resolutions",
)
def candidate_names(spark, sf):
    sites = I.sites(spark, sf)
    words = sites.selectExpr("substring_index(domain, '.', 1) AS word").distinct()
    roots = sites.selectExpr("concat(host, CASE WHEN page_id % 5 = 1 THEN '.co.in' ELSE '' END) AS root").distinct()
    return names.candidate_names(words, roots, I.resolutions(spark, sf))


@query(
    "seed_fallback",
    f"""WITH r AS (SELECT DISTINCT {_tld_sql('domain')} AS tld, domain AS name FROM sites),
        seeds AS (SELECT * FROM (VALUES {", ".join(f"('{t}', '{n}')" for t, ns in rules.SEED_NAMES.items() for n in ns)}) s(tld, name))
        SELECT tld, name FROM r UNION ALL SELECT tld, name FROM seeds WHERE tld NOT IN (SELECT tld FROM r)""",
    "sites",
)
def seed_fallback(spark, sf):
    sites = I.sites(spark, sf)
    roots = sites.select(text.tld_class(F.col("domain"), rules.OTHER_TLDS).alias("tld"), F.col("domain").alias("name")).distinct()
    return feeds.seed_fallback(spark, roots, rules.COUNTRY_TLDS)


def _roots(spark, sf):
    sites = I.sites(spark, sf)
    return sites.select(text.tld_class(F.col("domain"), rules.OTHER_TLDS).alias("tld"), F.col("domain").alias("name")).distinct()


@query(
    "limited_roots",
    f"""SELECT tld, name FROM (SELECT tld, name, row_number() OVER (PARTITION BY tld ORDER BY name) AS rn FROM (SELECT DISTINCT {_tld_sql('domain')} AS tld, domain AS name FROM sites)) WHERE rn <= 50""",
    "sites",
)
def limited_roots(spark, sf):
    return plan.limit_roots(_roots(spark, sf), 50)


@query("all_roots", f"SELECT DISTINCT {_tld_sql('domain')} AS tld, domain AS name FROM sites", "sites")
def all_roots(spark, sf):
    return plan.limit_roots(_roots(spark, sf))
