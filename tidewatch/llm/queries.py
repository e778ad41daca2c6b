"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, hard_negatives, langid, mixing, packing, sharding, simhash, substring_dedup, token_counts, topk, url_filter, warc, whitening
from tidewatch.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op1_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


def op2_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op4_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, limit=1024)


def op6_byte_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs, model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, scale=64)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(table(spark, sf_dir, "documents"), TOKENIZER, capacity=1024, end_id=2)


def op10_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=0).drop("payload")


def op11_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), (5, 2, 1), 1.5, most=2, block=64, shards=64, seed=11)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op12_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", noisy)
    return hard_negatives.mine(vectors, vectors.filter("vec_id % 100 = 0"), 5, 5, floor=80, scale=256)


def op13_polarised_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"), 16, scale=64, offset=1_000_000)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_phrase_automata,
        op2_string_tiling,
        op3_histogram_shards,
        op4_simhash_bk_trees,
        op5_token_counts,
        op6_byte_gru,
        op7_bit_sliced_top_k,
        op8_url_rules,
        op9_best_fit,
        op10_warc_segments,
        op11_sainte_lague,
        op12_slot_negatives,
        op13_polarised_whitening,
    )
}

def _below(x: str, blocks: str, quota: str, phase: str, rest_times: str) -> str:
    """SQL for the words that a line of blocks of 64 words gives before position ``x``."""

    def picked(b: str) -> str:
        n = f"greatest({blocks}, 1)"
        return f"(({b}) * ({quota} // {n}) + (({b}) * ({quota} % {n}) + {phase}) // {n})"

    b = f"least(({x}) // 64, {blocks})"
    times = f"CASE WHEN {b} < {blocks} THEN {picked(b + ' + 1')} - {picked(b)} ELSE {rest_times} END"
    return f"({picked(b)} * 64 + ({times}) * (({x}) - {b} * 64))"


_MAIN, _REST = ("blocks", "line_quota", "phase", "0"), ("rest_blocks", "rest_quota", "rest_phase", "rest_times")
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
SQL: dict[str, str] = {
    "op12_slot_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike,
                   CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole a JOIN whole r ON r.vec_id <> a.vec_id AND len(r.v) = len(a.v)
            WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT * FROM scored WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
               n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n
          ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 5""",
    "op11_sainte_lague": f"""
        WITH sized AS (
            SELECT doc_id, coalesce('=' || source, 'null') AS sid,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
            FROM documents),
        hashed AS (
            SELECT *, CAST('0x' || substr(md5('11|' || coalesce('=' || doc_id, 'null') || '|=' || size), 1, 15) AS BIGINT) AS h FROM sized),
        placed AS (
            SELECT *, h % 64 AS shard,
                   CAST(sum(size) OVER (PARTITION BY sid, h % 64 ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS first
            FROM hashed),
        shards AS (
            SELECT sid, shard, CAST(sum(size) AS BIGINT) AS words, CAST(sum(size) AS BIGINT) // 64 AS blocks,
                   CAST(sum(size) AS BIGINT) % 64 AS tail
            FROM placed GROUP BY sid, shard),
        tails AS (
            SELECT *, CAST(sum(tail) OVER (PARTITION BY sid ORDER BY shard) AS BIGINT) - tail AS rest_start FROM shards),
        sources AS (
            SELECT sid, CAST(sum(words) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) + CAST(sum(tail) AS BIGINT) // 64 AS blocks,
                   CAST(sum(tail) AS BIGINT) // 64 AS rest_blocks, CAST(sum(tail) AS BIGINT) % 64 AS rest,
                   row_number() OVER (ORDER BY sid) AS number,
                   CASE (row_number() OVER (ORDER BY sid) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
            FROM shards GROUP BY sid),
        levels AS (
            SELECT number, 2.0::DOUBLE * source_size / weight AS limit_level,
                   (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
                    - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, number
                                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, number
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
            FROM sources),
        final AS (SELECT coalesce(first(level ORDER BY limit_level, number), 0) AS level FROM levels WHERE level < limit_level),
        targets AS (
            SELECT s.*, weight * level >= 2.0::DOUBLE * source_size AS "full",
                   CASE WHEN weight * level >= 2.0::DOUBLE * source_size THEN 2.0::DOUBLE * source_size ELSE weight * level END AS target
            FROM sources s, final),
        seats AS (SELECT CAST(floor(sum(target) / 64 + 0.5) AS BIGINT) AS seats FROM targets WHERE NOT "full" AND target > 0),
        quotients AS (
            SELECT number, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, number, seat) AS place
            FROM (SELECT number, target, unnest(range(1, seats + 1)) AS seat FROM targets, seats WHERE NOT "full" AND target > 0)),
        given AS (SELECT number, count(*) AS given FROM quotients, seats WHERE place <= seats GROUP BY number),
        quotas AS (
            SELECT t.*, CASE WHEN "full" THEN 2 * blocks ELSE least(coalesce(given, 0), 2 * blocks) END AS quota
            FROM targets t LEFT JOIN given USING (number)),
        rests AS (
            SELECT *, CASE WHEN abs(target - quota * 64) <= least(abs(target - quota * 64 - rest), abs(target - quota * 64 - 2 * rest)) THEN 0
                           WHEN abs(target - quota * 64 - rest) <= abs(target - quota * 64 - 2 * rest) THEN 1 ELSE 2 END AS rest_times
            FROM quotas),
        lines AS (
            SELECT sid, shard, blocks FROM shards UNION ALL SELECT sid, 64, rest_blocks FROM rests),
        line_quotients AS (
            SELECT sid, shard, row_number() OVER (PARTITION BY sid ORDER BY blocks / (2 * seat - 1) DESC, shard, seat) AS place
            FROM (SELECT sid, shard, blocks, unnest(range(1, 2 * blocks + 1)) AS seat FROM lines)),
        line_quotas AS (
            SELECT q.sid, shard, count(*) AS line_quota FROM line_quotients q JOIN rests r ON q.sid = r.sid AND place <= quota GROUP BY ALL),
        drawn AS (
            SELECT l.*, coalesce(line_quota, 0) AS line_quota,
                   CAST('0x' || substr(md5('11|=' || sid || '|=' || shard), 1, 15) AS BIGINT) % greatest(blocks, 1) AS phase
            FROM lines l LEFT JOIN line_quotas USING (sid, shard)),
        params AS (
            SELECT d.*, rest_start, r.source_size, r.target, r.rest_times, r.rest_blocks, e.line_quota AS rest_quota, e.phase AS rest_phase
            FROM drawn d JOIN tails USING (sid, shard) JOIN rests r USING (sid) JOIN drawn e ON e.sid = d.sid AND e.shard = 64),
        ends AS (
            SELECT doc_id, size, p.*, least(first, 64 * blocks) AS m0, least(first + size, 64 * blocks) AS m1,
                   greatest(first - 64 * blocks, 0) + rest_start AS r0, greatest(first + size - 64 * blocks, 0) + rest_start AS r1
            FROM placed JOIN params p USING (sid, shard))
        SELECT doc_id, size, source_size, target,
               CAST({_below("m1", *_MAIN)} - {_below("m0", *_MAIN)}
                    + {_below("r1", *_REST)} - {_below("r0", *_REST)} AS BIGINT) AS taken
        FROM ends""",
    "op7_bit_sliced_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op10_warc_segments": """
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
        coded AS (
            SELECT page_id, payload, list_aggregate(list_transform(range(32), lambda i:
                       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS UBIGINT)
                                    >> CAST(35 - 5 * (i % 8) AS UBIGINT)) & 31 AS BIGINT) + 1, 1)),
                       'string_agg', '') AS payload_digest
            FROM payloads),
        last AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS last_page FROM coded)
        SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = last_page THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last_page THEN last_page END AS refers_to
        FROM last""",
    "op8_url_rules": f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
        parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        fitting AS (
            SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict AS verdict,
                   row_number() OVER (PARTITION BY p.page_id
                                      ORDER BY length(r.rule_host) DESC, length(r.rule_path) DESC) AS place
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE place = 1""",
}
