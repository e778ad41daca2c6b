"""What a stage leaves on the shared disk, and how many rows its joins make."""

from tidewatch import session
from tidewatch.llm import common, simhash


def test_near_duplicates_leave_no_shingle_hashes_on_disk(spark, tmp_path, monkeypatch):
    for module in (session, common):
        monkeypatch.setattr(module, "checkpoint_root", lambda _: str(tmp_path), raising=False)
    rows = [(i, " ".join(f"w{(i // 2) * 100 + k}" for k in range(60 - i % 2))) for i in range(20)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    (runs,) = tmp_path.glob("llm-runs-*")
    assert spark.read.schema("node long, runs binary").parquet(str(runs)).count() == 0
    assert {r.doc_id: r.component_id for r in got.collect()} == {d: d - d % 2 for d, _ in rows}


def test_prefix_trees_and_blocks_are_filtered_once(spark):
    """Trees meet their members in ``_met`` alone; blocks leave small trees out that are not marked."""
    trees = spark.createDataFrame([(1, n, 1.0, True) for n in range(3)] + [(2, n, 1.0, False) for n in range(5)] + [(3, 9, 1.0, True)]
        + [(4, n, 1.0, False) for n in range(simhash.BLOCK + 1)], "tree long, node long, weight double, small boolean")
    blocks = simhash._blocks(trees)
    own = blocks.filter(f"side = {simhash.OWN}")
    assert own.count() == 3 + simhash.BLOCK + 1
    assert own.select("shard").distinct().count() == 3
    assert simhash._met(trees.drop("small")).count() == 3 + 5 + simhash.BLOCK + 1
