"""Ledger properties: idempotent saves, bounded scores, hot keys, streaming and snapshots."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidewatch.config import Settings
from tidewatch.operators import correlation, disclosure, names, risk, transitions
from tidewatch.operators import findings as saving
from tidewatch.plans import reports
from tidewatch.session import checkpoint_root, spread
from tidewatch.sources import captures, feeds, ledger
from tidewatch.streaming.detect import arriving, detect_available
from tidewatch.workload import inputs as I

AS_OF = "2026-01-01 00:00:00"


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [
        (1, "https://a.in/.env", "ENV_FILE_EXPOSED", "CRITICAL", "ENV_FILE", "0.98"),
        (1, "https://a.in/.env", "ENV_FILE_EXPOSED", "CRITICAL", "ENV_FILE", "0.70"),
        (2, "https://b.in/", "PAN_IN_CONTENT", "HIGH", "NO_SUCH_ENTITY", "0.60"),
        (3, None, "PAN_IN_CONTENT", "HIGH", "PAN", "0.60"),
        (4, "https://d.in/", "PAN_IN_CONTENT", "LOUD", "PAN", "0.60"),
    ]
    df = spark.createDataFrame(rows, "domain_id int, url string, finding_type string, severity string, entity_type string, c string")
    return df.withColumn("confidence", F.col("c").cast("decimal(4,3)")).drop("c")


def test_saving_twice_adds_nothing(spark, candidates):
    none = spark.createDataFrame([], "domain_id int, url string, finding_type string, status string")
    first, bad = saving.save_findings(candidates, none, AS_OF)
    got = {r.domain_id: r for r in first.collect()}
    assert set(got) == {1, 2} and float(got[1].final_confidence) == 0.98 and got[2].entity_type == "OTHER"
    assert {r.problem for r in bad.collect()} == {"url missing", "unknown severity"}
    again, _ = saving.save_findings(candidates, first, AS_OF)
    assert again.count() == 0
    closed = first.withColumn("status", F.lit("RESOLVED"))
    reopened, _ = saving.save_findings(candidates, closed, AS_OF)
    assert reopened.count() == 2
    assert reopened.unionByName(closed).select("finding_id").distinct().count() == 4
    assert saving.save_findings(candidates, closed.unionByName(reopened), AS_OF)[0].count() == 0


def test_findings_of_unknown_domains_are_quarantined(spark, candidates):
    none = spark.createDataFrame([], "domain_id int, url string, finding_type string, status string")
    rows, bad = saving.save_findings(candidates, none, AS_OF, spark.createDataFrame([(1,)], "domain_id int"))
    assert {r.domain_id for r in rows.collect()} == {1}
    assert "unknown domain" in {r.problem for r in bad.collect()}


def test_audit_details_are_json(spark, candidates):
    none = spark.createDataFrame([], "domain_id int, url string, finding_type string, status string")
    rows, _ = saving.save_findings(candidates, none, AS_OF)
    log = saving.audit_created(rows, AS_OF).filter("details LIKE '%ENV_FILE_EXPOSED%'").first()
    assert '"severity":"CRITICAL"' in log.details and log.actor == "SCANNER"


def _risk(spark, n_critical, vendor="none", sector="GOVERNMENT"):
    domains = spark.createDataFrame([(1, "ACTIVE", 90, vendor, sector)], "domain_id int, status string, iocs_score int, vendor_fingerprint string, sector string")
    rows = [(i, 1, "CRITICAL", "NEW", False, None) for i in range(n_critical)]
    found = spark.createDataFrame(rows, "finding_id int, domain_id int, severity string, status string, dark_web_confirmed boolean, disclosure_sla_due timestamp")
    return risk.risk_scores(domains, found, AS_OF).first().risk_score


def test_risk_is_bounded_and_monotone(spark):
    scores = [_risk(spark, n) for n in (0, 1, 2, 5)]
    assert scores == sorted(scores) and all(0 <= s <= 100 for s in scores)
    assert _risk(spark, 5, "WordPress 6") > _risk(spark, 5, "none") or _risk(spark, 5, "WordPress 6") == 100


def test_dashed_vendor_names_count(spark):
    assert _risk(spark, 0, "NIC-eGov", "OTHER") == int(90 / 4 * 1.2)
    assert _risk(spark, 0, "Spring-Boot 2", None) == int(90 / 4 * 1.1)


def test_breach_note_is_added_once(spark):
    evidence = spark.createDataFrame([(1, "[note a]", None)], "domain_id int, breach_note string, vuln_note string")
    rows = [(1, 1, "HIGH", "NEW", False, "old", 0), (2, 1, "LOW", "NEW", False, "old", 0), (3, 1, "HIGH", "RESOLVED", False, None, 2)]
    found = spark.createDataFrame(rows, "finding_id int, domain_id int, severity string, status string, dark_web_confirmed boolean, context_snippet_safe string, escalation_level int")
    once = risk.mark_breached(found, evidence)
    twice = risk.mark_breached(once, evidence)
    got = {r.finding_id: (r.dark_web_confirmed, r.context_snippet_safe, r.escalation_level) for r in twice.collect()}
    assert got == {1: (True, "old\n[note a]", 1), 2: (False, "old", 0), 3: (False, None, 2)}


def test_vendor_match_equals_substring_search(spark):
    rng = random.Random(3)
    alphabet = "abAB 1"
    vendors = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))).strip() or "a" for _ in range(30)})
    prints = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(60)})
    expected = {(v, p) for v in vendors for p in prints if v.split()[0].lower() in p.lower()}
    got = correlation.match_vendors(
        spark.createDataFrame([(v,) for v in vendors], "vendor string"),
        spark.createDataFrame([(p,) for p in prints], "vendor_fingerprint string"),
    )
    assert {tuple(r) for r in got.select("vendor", "vendor_fingerprint").collect()} == expected


def test_candidate_names_equal_the_product(spark):
    words, roots = ["www", "api", "a.b"], ["x.in", "y.co.in"]
    resolved = ["www.x.in", "api.y.co.in", "a.b.x.in", "b.x.in", "www.z.in", "x.in"]
    df = names.candidate_names(
        spark.createDataFrame([(w,) for w in words], "word string"),
        spark.createDataFrame([(r,) for r in roots], "root string"),
        spark.createDataFrame([(n,) for n in resolved], "name string"),
    )
    expected = {(r, f"{w}.{r}") for w in words for r in roots if f"{w}.{r}" in resolved}
    assert {tuple(r) for r in df.collect()} == expected


def test_postgres_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "domain_id int, iocs_score int")
    def order(key):
        return [r.domain_id for r in reports.page_of(df, [reports.DOMAIN_SORTS[key](), F.col("domain_id")]).collect()]

    assert order("iocs_desc") == [1, 3, 2] and order("iocs_asc") == [2, 3, 1]
    with pytest.raises(ValueError):
        reports.page_of(df, [F.col("domain_id")], per_page=101)


def test_token_only_on_the_first_finding_and_copies_for_government(spark):
    found = I.findings(spark, "/root/testdata/sf0.001")
    domains = I.domains(spark, "/root/testdata/sf0.001").withColumn("contact_source", F.lit("stored"))
    plan = disclosure.disclosure_plan(found, domains, Settings("k", "national@team.example", "government@team.example"), AS_OF)
    tokens = plan.events.filter("ack_token IS NOT NULL")
    assert tokens.count() == plan.notices.count() == tokens.select("ack_token").distinct().count()
    copied = plan.events.filter("recipient_type = 'CC_NIC'").join(found, "finding_id").join(domains.select("domain_id", "domain"), "domain_id")
    assert copied.filter("NOT (domain LIKE '%.gov.in' OR domain LIKE '%.nic.in')").count() == 0 and copied.count() > 0
    assert plan.findings.filter("status <> 'DISCLOSED'").count() == 0


def test_second_acknowledgement_is_a_no_op(spark):
    events = spark.createDataFrame([("t1", 1, None), ("t2", 2, "2025-01-01")], "ack_token string, finding_id int, a string")
    events = events.withColumn("acknowledged_at", F.col("a").cast("timestamp")).drop("a")
    acks = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("zz",)], "ack_token string")
    first = transitions.acknowledge_events(events, acks, AS_OF)
    assert {r.ack_token: r.was_acknowledged for r in first.collect()} == {"t1": False, "t2": True}
    second = transitions.acknowledge_events(first.drop("was_acknowledged"), acks, "2026-02-01 00:00:00")
    assert {r.ack_token: str(r.acknowledged_at) for r in second.collect()} == {"t1": "2026-01-01 00:00:00", "t2": "2025-01-01 00:00:00"}


def test_hot_domain_is_cut_before_it_is_gathered(spark):
    """A third of all findings on one domain: the text is the same, and only few rows per domain are collected."""
    base = I.findings(spark, "/root/testdata/sf0.001")
    hot = base.withColumn("domain_id", F.when(F.col("finding_id") % 3 == 0, F.lit(-1)).otherwise(F.col("domain_id")))
    row = disclosure.batch_summary(hot, AS_OF).filter("domain_id = -1").first()
    assert row.n_findings == hot.filter("domain_id = -1").count() and len(row.lines_text.split("\n")) == 5
    plan = reports.recent_jobs_per_domain(I.scan_jobs(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_findings_stay_on_plan_without_cross_joins(spark):
    sf = "/root/testdata/sf0.001"
    plan = correlation.correlate_vendors(I.domains(spark, sf), I.findings(spark, sf), AS_OF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_best_capture_and_max_chars(spark):
    path = tempfile.mkdtemp(prefix="tidewatch-captures-") + "/c"
    I.captures(spark, "/root/testdata/sf0.001").write.parquet(path)
    whole, cut = captures.read_captures(spark, path), captures.read_captures(spark, path, max_chars=100)
    assert whole.agg(F.max(F.length("body"))).first()[0] > 100 == cut.agg(F.max(F.length("body"))).first()[0]
    assert captures.best_capture(whole).count() == whole.select("domain").distinct().count()


def test_ct_entries_can_be_limited_by_id(spark):
    df = spark.createDataFrame([(2, "*.b.example\nB.example"), (1, "a.example")], "entry_id long, name_value string")
    assert {r[0] for r in feeds.ct_names(df).collect()} == {"a.example", "b.example"}
    assert {r[0] for r in feeds.ct_names(df, max_entries=1).collect()} == {"a.example"}


def test_snapshots_are_written_beside(spark):
    base = tempfile.mkdtemp(prefix="tidewatch-snapshot-") + "/domains"
    ledger.write_snapshot(spark.range(3), base, 1)
    ledger.write_snapshot(ledger.read_snapshot(spark, base, 1).filter("id > 0"), base, 2)
    assert (ledger.read_snapshot(spark, base, 1).count(), ledger.read_snapshot(spark, base, 2).count()) == (3, 2)


def test_ledger_tables_round_trip(spark):
    path = tempfile.mkdtemp(prefix="tidewatch-ledger-") + "/audit"
    rows = spark.sql("SELECT 1L id, 'SYSTEM_INIT' event_type, 'SYSTEM' actor, '' target_type, '' target_id, '{}' details, '' ip_address, timestamp'2026-01-01' event_at")
    ledger.append(rows, path)
    ledger.append(rows, path)
    assert ledger.read_table(spark, path, "audit_logs").count() == 2


def test_stream_writes_each_key_once_over_batches(spark):
    base = tempfile.mkdtemp(prefix="tidewatch-stream-")
    for i, ids in enumerate([(1, 2), (2, 3)]):
        spark.createDataFrame([(x, "v") for x in ids], "id int, v string").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = arriving(spark, f"{base}/in", "id int, v string", files_per_batch=1)
        detect_available(stream, f"{base}/out", f"{base}/state", lambda b: b.select("id"), ["id"])
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").select("id").collect()) == [1, 2, 3]


def test_spread_shuffles_only_when_the_session_asks(spark):
    coarse = spark.range(0, 10, 1, 1)
    assert spread(coarse, "id") is coarse
    spark.conf.set("tidewatch.scanPartitions", "16")
    try:
        assert spread(coarse, "id").rdd.getNumPartitions() == 16
    finally:
        spark.conf.unset("tidewatch.scanPartitions")


def test_correlating_twice_adds_nothing(spark):
    sf = "/root/testdata/sf0.001"
    domains, found = I.domains(spark, sf), I.findings(spark, sf).withColumn("vendor_fingerprint", F.lit(None).cast("string"))
    first = correlation.correlate_vendors(domains, found, AS_OF)
    assert first.count() == first.select("finding_id").distinct().count() > 0
    both = found.withColumn("finding_id", F.col("finding_id").cast("string")).unionByName(first, allowMissingColumns=True)
    assert correlation.correlate_vendors(domains, both, AS_OF).count() == 0


def test_a_finding_keeps_its_own_vendor(spark):
    domains = spark.createDataFrame([(1, "Joomla 4"), (2, None)], "domain_id int, vendor_fingerprint string")
    rows = [(10, 1, "HIGH", "NEW", "A", None), (11, 1, "CRITICAL", "NEW", "B", "Drupal 9"), (12, 2, "CRITICAL", "NEW", "C", None),
            (13, 1, "CRITICAL", "RESOLVED", "D", None)]
    found = spark.createDataFrame(rows, "finding_id int, domain_id int, severity string, status string, finding_type string, vendor_fingerprint string")
    got = {r.vendor: (r.severity, r.finding_type) for r in correlation.vendor_representatives(found, domains).collect()}
    assert got == {"Joomla 4": ("HIGH", "A"), "Drupal 9": ("CRITICAL", "B")}


def test_one_finding_for_each_domain_and_vendor_word(spark):
    vendors = ["WordPress 6.1", "WordPress 5.8", "wordpress", "Drupal 9 on WordPress hosting", None, "", "Joomla"]
    domains = spark.createDataFrame(
        [(i, f"d{i}.in", v, "ACTIVE") for i, v in enumerate(vendors)] + [(50, "off.in", "WordPress 6.1", "REMOVED")],
        "domain_id int, domain string, vendor_fingerprint string, status string",
    )
    shape = "finding_id string, domain_id int, severity string, status string, finding_type string, vendor_fingerprint string"
    found = spark.createDataFrame(
        [("1", 0, "HIGH", "NEW", "A", "WordPress 6.1"), ("2", 1, "CRITICAL", "NEW", "B", "WordPress 5.8"), ("3", 3, "HIGH", "NEW", "C", "Drupal 9")], shape
    )
    rows = correlation.correlate_vendor_words(domains, found, AS_OF)
    got = {(r.domain_id, r.vendor_word): (r.vendor_fingerprint, r.vendors) for r in rows.collect()}
    wordpress = {(i, "wordpress"): ("WordPress 5.8", 2) for i in range(4)}
    assert got == wordpress | {(3, "drupal"): ("Drupal 9", 1)} and rows.count() == 5
    assert "and 1 more with its name" in rows.filter("domain_id = 0").first().context_snippet_safe
    assert correlation.correlate_vendor_words(domains, found.unionByName(rows.select(found.columns)), AS_OF).count() == 0


def test_the_word_join_spreads_a_name_that_most_domains_have(spark):
    domains = spark.range(4000).selectExpr(
        "CAST(id AS INT) AS domain_id", "concat('d', id) AS domain", "'WordPress' AS vendor_fingerprint", "'ACTIVE' AS status"
    )
    shape = "finding_id string, domain_id int, severity string, status string, finding_type string, vendor_fingerprint string"
    found = spark.createDataFrame([("1", 0, "HIGH", "NEW", "A", "WordPress 6.1")], shape)
    assert correlation.correlate_vendor_words(domains, found, AS_OF).count() == 4000
    salts = domains.groupBy(F.pmod(F.xxhash64("domain_id"), F.lit(correlation.SALTS))).count().collect()
    assert len(salts) == correlation.SALTS and max(r["count"] for r in salts) < 500


def test_the_escalation_audit_names_all_types(spark):
    domains = spark.createDataFrame(
        [(1, "a.in", "OTHER", None, 10, None, None)],
        "domain_id int, domain string, sector string, ip_address string, iocs_score int, vendor_fingerprint string, contact_email string",
    )
    found = I.findings(spark, "/root/testdata/sf0.001").limit(9)
    kinds = found.withColumns(
        {
            "domain_id": F.lit(1), "status": F.lit("NEW"), "severity": F.lit("HIGH"), "dark_web_confirmed": F.lit(True), "escalation_level": F.lit(0),
            "finding_type": F.concat(F.lit("TYPE_"), F.col("finding_id").cast("string")),
        }
    )
    plan = disclosure.escalation_plan(kinds, domains, I.SETTINGS, AS_OF)
    triggers = plan.audit.select(F.from_json("details", "triggers array<string>")["triggers"]).first()[0]
    assert sorted(triggers) == sorted(r.finding_type for r in kinds.collect()) and len(triggers) == 9
    assert plan.notices.first().triggers.count(",") == 4


def _rows_read(df):
    df.collect()
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_a_deep_page_reads_no_more_than_the_first(spark):
    rows = spark.range(200_000).selectExpr("id", "CAST(IF(id % 50 = 0, NULL, id % 1000) AS INT) AS score")
    paged = reports.write_paged(rows, f"{checkpoint_root(spark)}/paged-{random.random()}", F.col("score"), "id", files=40)
    everything = paged.orderBy(F.col("score").asc_nulls_last(), "id").collect()
    for at in (0, 60_000, 195_990, 196_010, 199_990):
        after = (everything[at].score, everything[at].id)
        page = reports.page_after(paged, "id", after, per_page=10)
        assert page.collect() == everything[at + 1 : at + 11]
    last = everything[195_000]
    assert _rows_read(reports.page_after(paged, "id", (last.score, last.id))) < 20_000
    with pytest.raises(ValueError):
        reports.page_after(paged, "id", per_page=101)


def test_feeds_are_parsed_in_one_pass(spark):
    rows = [(n, "a.in", '{"subdomains":["x"],"events":["y.a.in"]}') for n, shape, _ in feeds.FEEDS if shape in ("labels", "events", "plain_names")]
    payloads = spark.createDataFrame(rows, "source string, root string, payload string")
    payloads.write.mode("overwrite").parquet(path := f"{checkpoint_root(spark)}/feeds-{random.random()}")
    parsed = feeds.parse_feeds(spark.read.parquet(path), configured=tuple(n for n, _, _ in feeds.FEEDS))
    shape = {n: s for n, s, _ in feeds.FEEDS}
    got = {(shape[r.source], r.name) for r in parsed.collect()}
    assert got <= {("labels", "x.a.in"), ("events", "y.a.in")} and got
    assert parsed._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_a_row_far_down_a_list_is_found_in_its_file(spark):
    rows = [(i, None if i % 10 == 0 else float(i % 7)) for i in range(500)] + [(None, 3.0), (7, 0.0)]
    df = spark.createDataFrame(rows, "finding_id long, value double")
    paged = reports.write_paged(df, f"{tempfile.mkdtemp()}/paged", F.col("value"), "finding_id", 9)
    order = [F.col("sort_value").asc_nulls_last(), F.col("finding_id").asc()]
    want = [(r.sort_value, r.finding_id) for r in paged.orderBy(*order).collect()]
    for n in (1, 2, 57, 250, 449, 500, 502):
        assert reports.row_at(paged, "finding_id", n) == want[n - 1]
    assert reports.row_at(paged, "finding_id", 503) is None
