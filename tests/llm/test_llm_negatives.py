"""Hard negatives against all pairs on small tables with nulls, ties, repeats, odd lengths and large components."""

import math
import random
from collections import Counter

import pytest

from tidewatch.llm import hard_negatives
from tidewatch.llm.common import ready

COLUMNS = "vec_id long, embedding array<double>, label int, id long, v string, limits int, number string"


def _all_pairs(rows, wanted, positives, negatives, floor, scale):
    whole = [
        (i, label, [math.floor(c * scale) for c in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = Counter()
    for i, label, v in {(i, label, tuple(v)) for i, label, v in whole if wanted(i)}:
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in whole if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: s[:2])
        for upper, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and floor * -upper <= 100 * -s[0] <= 100 * -upper][:negatives]
            for rank, (score, negative, _) in enumerate(fit, 1):
                out[i, positive, rank, negative, -upper, -score] += 1
    return out


def _mined(spark, rows, wanted_sql, **more):
    df = ready(spark).createDataFrame([(*r, 1, "x", 2, "y") for r in rows], COLUMNS).repartition(4)
    got = hard_negatives.mine(df, df.filter(wanted_sql), **more).collect()
    assert len(got) == len(set(map(tuple, got))) or len({r[0] for r in rows}) < len(rows)
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7, "pack_rows": 2, "round_bytes": 100}])
def test_equals_all_pairs(spark, sizes):
    rng = random.Random(9)
    rows = [(i, [rng.randrange(-1, 3) / 4 for _ in range(3)], rng.choice([0, 0, 0, 1, 2])) for i in range(120)]
    rows += rows[-3:]  # repeated rows
    rows += [(300, None, 0), (301, [1.0, None, 1.0], 0), (302, [math.nan] * 3, 1), (303, [math.inf, 0.0, 0.0], 1), (304, [1.0] * 3, None)]
    rows += [(None, [1.0] * 3, 0), (310, [], 0), (320, [], 1), (330, [1.0, 1.0], 0), (331, [1.0, 0.5], 0), (340, [1.0, 0.4], 1)]
    want = _all_pairs(rows, lambda i: i % 10 == 0, 5, 4, 80, 16)
    assert len(want) > 100
    assert _mined(spark, rows, "vec_id % 10 = 0", positives=5, negatives=4, scale=16, **sizes) == want


@pytest.mark.parametrize("size", [2.0**24, 2.0**28])
def test_scores_beyond_doubles_are_exact(spark, size):
    rng = random.Random(2)
    rows = [(i, [size + rng.randrange(50) / 4, rng.randrange(50) / 4], i % 3) for i in range(60)]
    want = _all_pairs(rows, lambda i: i % 20 == 0, 5, 5, 80, 4)
    assert len(want) == 75
    assert _mined(spark, rows, "vec_id % 20 = 0", scale=4) == want


def test_one_label_holds_most_rows_and_windows_share_a_score(spark):
    rows = [(i, [1.0, i % 2 / 8], 7) for i in range(400)] + [(1000 + i, [0.5 + i / 64, 0.0], 8) for i in range(40)]
    want = _all_pairs(rows, lambda i: i == 0 or i == 1000, 5, 5, 80, 256)
    assert {k[0] for k in want} == {0, 1000}
    assert _mined(spark, rows, "vec_id IN (0, 1000)", block_rows=50) == want


def test_nothing_gives_nothing(spark):
    alone = [(1, [1.0], 0), (2, [1.0], 1), (3, [-1.0], 1)]
    assert not _mined(spark, [], "true")
    assert not _mined(spark, alone, "vec_id = 99")
    assert not _mined(spark, alone, "vec_id = 1")  # no positive
    assert not _mined(spark, alone, "vec_id = 2")  # the positive's score is negative
