"""Content rules, validators and known differences, on small fixtures."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewatch import rules
from tidewatch.operators import corpus, path_scan
from tidewatch.operators import findings as saving
from tidewatch.operators.content_scan import ALL_RULES, DEFAULT_RULES, scan_content
from tidewatch.functions import masking, text
from tidewatch.plans.scan import scan_candidates

NUMBER = "2341 2341 " + "2346"
PLANTS = {
    "AADHAAR": (NUMBER, "aadhaar"),
    "PAN": ("ABCDE" + "1234F", "income tax"),
    "VOTER_ID": ("ABC" + "1234567 XYZ" + "7654321", "voter"),
    "DRIVING_LICENSE": ("MH12 2011" + " 0062821", "driving"),
    "ABHA_ID": ("91-1234-" + "5678-9012", "abha"),
    "INDIAN_PASSPORT": ("K" + "1234567", "passport"),
    "AWS_ACCESS_KEY": ("AK" + "IA" + "ABCDEFGHIJKLMNOP", "amazon"),
    "STRIPE_LIVE_KEY": ("sk_" + "live_" + "a" * 24, "stripe"),
    "PRIVATE_KEY_BLOCK": ("-----BEGIN EC " + "PRIVATE KEY-----", None),
    "GENERIC_SECRET_FIELD": ('"api_' + 'key": "abcdefgh"', None),
    "INDIAN_PHONE": (" 98" + "76543210", "helpline"),
}


def scan(spark, texts, rule_set=DEFAULT_RULES, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = scan_content(df, "text", key="id", salt="s", rules=rule_set, **kw).collect()
    return {(r.id, r.rule): r for r in rows}


def test_each_rule_with_and_without_its_keyword(spark):
    names = list(PLANTS)
    texts = [f"before {PLANTS[n][0]} after" for n in names] + [f"{PLANTS[n][1] or ''} {PLANTS[n][0]} after" for n in names]
    found = scan(spark, texts)
    for i, name in enumerate(names):
        keyword = PLANTS[name][1]
        plain, worded = found.get((i, name)), found.get((i + len(names), name))
        if name in ("AADHAAR", "INDIAN_PHONE"):
            assert plain is None  # needs its keyword, or fifteen occurrences
        else:
            assert float(plain.confidence) == 0.6
        assert float(worded.confidence) == (0.8 if keyword else 0.6)
        assert worded.has_keyword is (keyword is not None)


def test_volume_stands_in_for_a_keyword(spark):
    phones = PLANTS["INDIAN_PHONE"][0]
    found = scan(spark, [phones * 14, phones * 15, "ABC" + "1234567"])
    assert (0, "INDIAN_PHONE") not in found
    assert found[(1, "INDIAN_PHONE")].value_count_estimate == 15
    assert (2, "VOTER_ID") not in found


def test_checksum_and_borders(spark):
    bad, joined = "aadhaar 2341 2341 2347", "aadhaar 12341 2341 2346"
    found = scan(spark, [bad, joined, "aadhaar 2341 2341-2346", "aadhaar 234123412346"])
    assert {i for i, rule in found if rule == "AADHAAR"} == {2, 3}
    # One number written in two ways has one hash.
    assert found[(2, "AADHAAR")].value_hash == found[(3, "AADHAAR")].value_hash


def test_keywords_see_the_whole_page_and_patterns_only_its_text(spark):
    page = f"<meta content='aadhaar'><style>x{{width:{NUMBER}px}}</style><p>{NUMBER}</p>"
    hit = scan(spark, [page])[(0, "AADHAAR")]
    assert hit.value_count_estimate == 1 and hit.has_keyword


def test_text_is_never_cut(spark):
    far = "x " * 60_000 + PLANTS["PAN"][0]
    assert (0, "PAN") in scan(spark, [far])


def test_no_column_holds_a_value(spark):
    texts = [f"{k or ''} {v} tail" for v, k in PLANTS.values()]
    for row in scan(spark, texts, ALL_RULES, with_context=True).values():
        for value, _ in PLANTS.values():
            assert value.strip() not in " ".join(str(x) for x in row)


def test_optional_rules_are_off_by_default(spark):
    card = "card 4539 1488 0343 6467 mail a.b@example.org upi me@okbank account number 123456789012"
    assert not scan(spark, [card])
    assert {k[1] for k in scan(spark, [card], ALL_RULES)} == {"CREDIT_CARD", "EMAIL", "UPI_ID", "BANK_ACCOUNT"}


def test_low_entropy_tokens_are_dropped(spark):
    low, high = "aaaabbbbccccdddd", "a8Fk2Lq9Zx7Wm4Tn"
    texts = [f'token = "{low}"', f'token = "{high}"', f'token = "{low}" token = "{high}"']
    found = scan(spark, texts, ALL_RULES)
    assert {(i, r.value_count_estimate) for (i, name), r in found.items() if name == "GENERIC_API_KEY"} == {(1, 1), (2, 1)}


# -- validators ------------------------------------------------------------


def verdict(spark, validator, path, body, entity="OTHER"):
    df = spark.createDataFrame([(path, body, entity)], "path string, body string, entity string")
    v = df.select(path_scan.validate(validator, F.col("path"), F.col("body"), F.col("entity")).alias("v")).first().v
    return v.confirmed, float(v.confidence)


@pytest.mark.parametrize(
    ("validator", "path", "body", "expected"),
    [
        ("dsstore", "/.DS_Store", "\x00\x00\x00\x01Bud", (True, 0.97)),
        ("git", "/.git/HEAD", "ref: refs/heads/main\n", (True, 0.99)),
        ("git", "/.git/config", "ref: refs/heads/main", (False, 0.0)),
        ("env", "/.env", "API_KEY=abc", (True, 0.98)),
        ("env", "/.env", "# example\nAPI_KEY=abc", (False, 0.0)),
        ("sql", "/www.zip", "PK" * 60, (True, 0.8)),
        ("sql", "/backup.sql", "PK" * 60, (False, 0.0)),
        ("json", "/actuator/env", "[1,2]", (False, 0.0)),
        ("json", "/actuator/env", '{"activeProfiles":[]}', (True, 0.97)),
        ("phpinfo", "/info.php", "<table>PHP Version 8", (True, 0.98)),
        ("shell", "/.bash_history", "cd /\nls", (True, 0.7)),
    ],
)
def test_validators(spark, validator, path, body, expected):
    assert verdict(spark, validator, path, body) == expected


def test_evidence_never_quotes_content(spark):
    secret = "hunter2secret"
    bodies = {"env": f"API_KEY={secret}", "git": f"fix {secret}", "aws": f"[default]\naws_access_key_id = {secret}"}
    for name, body in bodies.items():
        df = spark.createDataFrame([("/.git/COMMIT_EDITMSG", body)], "p string, b string")
        v = df.select(path_scan.validate(name, F.col("p"), F.col("b"), F.lit("OTHER")).alias("v")).first().v
        assert v.confirmed and secret not in v.evidence


def test_rule_table_shape():
    assert len(rules.PATH_RULES) == 108
    assert len({r.path for r in rules.PATH_RULES}) == 108
    assert len({r.finding_type for r in rules.PATH_RULES}) == 42
    assert {r.validator for r in rules.PATH_RULES} == {*path_scan.VALIDATORS, "none"}


@pytest.mark.parametrize("path", ["/.aws/config", "/config.php.bak"])
def test_rules_whose_validator_has_no_branch_never_confirm(spark, path):
    assert verdict(spark, "config", path, "password = 'x'\naws_secret = y") == (False, 0.0)


def test_scan_filters_dedups_and_writes_cards(spark):
    body = "[core]\n\trepositoryformatversion = 0\n"
    rows = [
        ("a.in", "https://a.in/.git/config", "/.git/config", 200, "text/plain", body, 40),
        ("a.in", "https://a.in/.git/config", "/.git/config", 200, "text/plain", body, 40),
        ("b.in", "https://b.in/.git/config", "/.git/config", 404, "text/plain", body, 40),
        ("c.in", "https://c.in/.git/config", "/.git/config", 200, "text/html", "<html>" + body, 40),
        ("d.in", "https://d.in/other", "/other", 200, "text/plain", body, 40),
    ]
    df = spark.createDataFrame(
        rows, "domain string, url string, path string, status int, content_type string, body string, body_bytes bigint"
    )
    got = path_scan.scan_paths(df).collect()
    assert [(r.domain, r.finding_type, float(r.confidence)) for r in got] == [("a.in", "GIT_REPO_EXPOSED", 0.97)]
    assert json.loads(got[0].context_snippet_safe) == {
        "finding_type": "GIT_REPO_EXPOSED", "url": "https://a.in/.git/config", "status": 200, "content_type": "text/plain",
        "body_bytes": 40, "confidence": 0.97, "evidence": "Git config section",
    }


@pytest.mark.parametrize(
    "body, kept",
    [
        ("INSERT INTO t VALUES (1, 'x');\n" * 2000 + "-- table y does not exist", True),
        ("a log line, permission denied\n" * 3000, True),
        ("table y does not exist", False),
        ("  <!DOCTYPE html><title>x</title>" + "words " * 20_000 + "page not found", False),
        ("<div><p><b>a</b></p></div> b " * 2000 + "page not found", False),
        ("x = 1; y <b> z\n" * 2000 + "page not found", True),
    ],
)
def test_phrases_count_in_messages_and_pages_only(spark, body, kept):
    df = spark.createDataFrame([(200, body, "text/plain", "LOG_FILE")], "status int, body string, content_type string, entity string")
    columns = [F.col(c) for c in ("status", "body", "content_type", "entity")]
    row = df.select(path_scan.false_positive_reason(*columns).alias("strict"), path_scan.false_positive_reason(*columns, strict=False).alias("loose")).first()
    assert (row.strict is None) == kept and row.loose is not None


def test_a_home_page_without_a_time_is_scanned(spark):
    rows = [("a.in", "https://a.in/", "/", "https", 200, "text/html", "PAN ABCPE1234F here", 20, None), ("b.in", "https://b.in/", "/", "https", 200, "text/html", "PAN ABCPE1234F here", 20, None)]
    shape = "domain string, url string, path string, scheme string, status int, content_type string, body string, body_bytes bigint, fetched_at timestamp"
    df = spark.createDataFrame(rows, shape).withColumn("headers", F.lit(None).cast("map<string,string>"))
    timed = df.withColumn("fetched_at", F.when(F.col("domain") == "b.in", F.to_timestamp(F.lit("2026-01-01 00:00:00"))))
    got = {r.domain for r in scan_candidates(timed, "salt").filter("finding_type = 'PAN_IN_CONTENT'").collect()}
    assert got == {"a.in", "b.in"}


# -- known differences: default is the strict form --------------------------


def test_tld_suffix_respects_the_dot(spark):
    df = spark.createDataFrame([("begin",), ("x.in",), ("x.co.in",)], "d string")
    assert [r[0] for r in df.select(text.in_tlds(F.col("d"), rules.COUNTRY_TLDS)).collect()] == [False, True, True]
    assert [r[0] for r in df.select(text.in_tlds(F.col("d"), rules.COUNTRY_TLDS, strict=False)).collect()] == [True, True, True]


def test_longest_tld_wins(spark):
    df = spark.createDataFrame([("x.co.in",), ("x.gov.in",), ("x.com",)], "d string")
    assert [r[0] for r in df.select(text.tld_class(F.col("d"), (".com",))).collect()] == [".co.in", ".gov.in", ".com"]
    assert df.select(text.tld_class(F.col("d"), strict=False)).first()[0] == ".in"


def test_known_network_is_compared_whole(spark):
    df = spark.createDataFrame([("x.com", "AS98291 Other")], "d string, asn string")
    none = F.lit(None).cast("struct<devanagari_content:boolean,hindi_meta:boolean,indian_phone:boolean,gst_number:boolean,payment_gateway:boolean>")
    assert corpus.origin_score(df, "d", none, "asn").first().iocs_score == 20
    assert corpus.origin_score(df, "d", none, "asn", strict=False).first().iocs_score == 30


def test_sector_head_is_optional(spark):
    df = spark.createDataFrame([("x.com", "z" * 3000 + " hospital")], "d string, h string")
    whole, head = corpus.infer_sector(F.col("d"), F.col("h")), corpus.infer_sector(F.col("d"), F.col("h"), 2000)
    assert df.select(whole, head).first()[:] == ("HEALTHCARE", "OTHER")


def test_vendor_order_and_minimum(spark):
    pages = [("wordpress and joomla",), ("Django only",), ("django csrfmiddlewaretoken",), ("PHP/8.1.2",), ("x.action?",), ("",)]
    found = corpus.fingerprint(spark.createDataFrame(pages, "h string"), "h").collect()
    assert [r.vendor for r in found] == ["WordPress", None, "Django", "PHP 8.1.2", None, None]
    for sig in rules.VENDOR_SIGNATURES:
        assert sig.gates


@pytest.mark.parametrize(
    "domain, page, strict, loose",
    [
        ("shop.example.com", "a technical community", "OTHER", "GOVERNMENT"),
        ("digital.gov.in", "", "GOVERNMENT", "GOVERNMENT"),
        ("citybank.example", "", "FINANCE", "FINANCE"),
        ("mu.ac.in", "", "EDUCATION", "EDUCATION"),
        ("emu.example", "", "OTHER", "EDUCATION"),
        ("praxis.example", "", "OTHER", "FINANCE"),
        ("a.example", "The MINISTRY of X", "GOVERNMENT", "OTHER"),
        ("a.example", None, "OTHER", "OTHER"),
        ("a.example", "river embankment", "OTHER", "FINANCE"),
        ("x.res.in", "", "RESEARCH", "RESEARCH"),
    ],
)
def test_sector_words_have_borders(spark, domain, page, strict, loose):
    df = spark.createDataFrame([(domain, page)], "d string, p string")
    row = df.select(corpus.infer_sector(F.col("d"), F.col("p")), corpus.infer_sector(F.col("d"), F.col("p"), strict=False)).first()
    assert tuple(row) == (strict, loose)


def test_numbers_in_any_script_are_found_masked_and_hashed_alike(spark):
    plain = "driving MH12 2011 0062821 abha 91-1234-5678-9012 aadhaar 234123412346 mobile 9876543210"
    rows = [(1, plain), (2, plain.translate({ord("0"): "०", ord("1"): "१", ord("2"): "2", ord("5"): "৫"}))]
    assert rows[0] != rows[1]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    hits = scan_content(docs, "text", key="doc_id", salt="s", with_context=True).collect()
    hashes = {(h.doc_id, h.rule): h.value_hash for h in hits}
    assert {r for _, r in hashes} == {"DRIVING_LICENSE", "ABHA_ID", "AADHAAR", "INDIAN_PHONE"}
    assert all(hashes[1, r] == hashes[2, r] for _, r in hashes)
    assert not any(any(unicodedata.category(c) == "Nd" for c in h.context) for h in hits)


def test_shown_urls_hold_no_secrets(spark):
    rows = [
        ("https://a.in/x?token=abc&mail=me@b.in", "https://a.in/x?[REDACTED QUERY]"),
        ("https://user:pass@a.in/x#part", "https://a.in/x?[REDACTED QUERY]"),
        ("https://a.in/me@b.in/y", "https://a.in/[REDACTED EMAIL]/y"),
        ("https://a.in/x?", "https://a.in/x?"),
        ("a.in/x@y", "a.in/x@y"),
        ("", ""),
        (None, None),
    ]
    shown = spark.createDataFrame(rows, "url string, want string").select("want", masking.display_url(F.col("url")).alias("got"))
    assert [r.got for r in shown.collect()] == [want for _, want in rows]


def test_findings_keep_the_url_as_key_and_show_it_masked(spark):
    url = "https://a.in/.git/config?token=hunter2"
    captures = spark.createDataFrame(
        [("a.in", url, "/.git/config", 200, "text/plain", "[core]\nrepositoryformatversion = 0\n" + "x" * 40, 70)],
        "domain string, url string, path string, status int, content_type string, body string, body_bytes bigint",
    )
    found = path_scan.scan_paths(captures)
    row = found.first()
    assert row.url == url and "hunter2" not in row.context_snippet_safe
    rows, _ = saving.save_findings(found.withColumn("domain_id", F.lit("1")), spark.createDataFrame([], "domain_id string, url string, finding_type string, status string"), "2026-01-01 00:00:00")
    assert rows.first().url == url and "hunter2" not in saving.audit_created(rows, "2026-01-01 00:00:00").first().details
