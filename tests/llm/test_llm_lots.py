"""What the last round of near duplicates ships, and what a written table leaves on the executors' disks."""

import time
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import common, simhash


def _met(shards):
    """Pairs that a shard compares: of two sides, or of side OWN."""
    by_shard = {}
    for r in shards.collect():
        by_shard.setdefault(r.shard, []).append((r.side, r.node))
    return {tuple(sorted((m, n))) for rows in by_shard.values() for (a, m), (b, n) in combinations(rows, 2) if m != n and (a != b or a == simhash.OWN)}


def test_trees_of_one_group_are_shipped_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    # 12 trees lack a few each of 48 texts, of which a third are singles; one tree is of another group, one is small.
    trees = {t: [n for n in range(48) if n % 13 != t] for t in range(12)} | {20: list(range(100, 130)), 21: [200, 201, 202]}
    root = {n: n if n % 3 == 2 else 0 for n in range(48)} | {n: 100 if n < 120 else n for n in range(100, 130)} | {n: n for n in range(200, 203)}
    rows = spark.createDataFrame([(t, n, 1.0) for t, nodes in trees.items() for n in nodes], "tree long, node long, weight double")
    roots = spark.createDataFrame([(n, r) for n, r in root.items() if n != r], "node long, root long")
    shards = simhash._crossing(rows, roots).cache()
    wanted = {p for nodes in trees.values() for p in combinations(nodes, 2) if root[p[0]] != root[p[1]]}
    assert wanted <= _met(shards)
    assert shards.count() == 48 * 6 + 30 * 4 + 3  # 12 trees of 44 or 45 made 44 * 6 rows each
    shards.unpersist()


def test_far_trees_under_one_root_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rows = [(t, n, 1.0, 9 if n % 30 < 15 else n) for t in range(3) for n in range(30 * t, 30 * t + 30)]
    rooted = spark.createDataFrame(rows, "tree long, node long, weight double, root long")
    mixed = spark.createDataFrame([(t, 30.0, 15.0, 9) for t in range(3)], "tree long, members double, strays double, most long")
    trees, members = simhash._merged(mixed, rooted)
    assert sorted(map(tuple, trees.select(*mixed.columns).collect())) == [(t, 30.0, 15.0, 9) for t in range(3)]
    assert members.count() == 90


def test_lots_find_what_one_lot_finds(spark):
    runs = [(n, np.unique(np.arange(100 * (n // 2), 100 * (n // 2) + 50 - n % 2, dtype=np.uint64)).tobytes()) for n in range(40)]
    runs = spark.createDataFrame(runs, "node long, runs binary")
    shards = spark.range(40).select(F.xxhash64(F.expr("id div 4")).alias("shard"), F.lit(simhash.OWN).alias("side"), F.col("id").alias("node"))
    one, four = ({tuple(r) for r in simhash._links(shards, runs, None, 0.8, lots).collect()} for lots in (1, 4))
    assert one == four == {(n, n + 1) for n in range(0, 40, 2)}


def test_a_kept_table_leaves_no_shuffle_files(spark):
    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    counts = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffled(), spark.conf.get(common.FREED)
    for write in (common.keep, lambda df, name: common.lend(df, name)[0]):
        assert write(counts, "counts").count() == 7
    until = time.time() + 10
    while (left := {n for n in shuffled() - before if n.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert len(left) <= 2  # of the two counts in this test, which are no writes
    assert spark.conf.get(common.FREED) == setting
