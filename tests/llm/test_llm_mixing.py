"""Mixing: against its SQL on a table with nulls, blanks, ties and repeats, and apportionment against plain highest quotients."""

import heapq
import random
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tidewatch.llm import mixing
from tidewatch.llm.common import ready
from tidewatch.llm.queries import SQL

COLUMNS = "doc_id long, text string, source string, size long, target string, shard int, h long, copies int"


def _rows():
    rng = random.Random(3)
    sources = ["b", "a", "", None, "ü", "null", "=a", "ä"]
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n\x0b", None), (None, "one two", "a"), (None, "one two", "a"), (4, "x " * 20_000, "b")]
    rows += [(10 + i, "w " * rng.randrange(0, 300), rng.choice(sources)) for i in range(150)]
    rows += [rows[-1]] * 9 + [(10, "ten words " * 5, "a"), (10, "ten words " * 4, "a")]
    return rows


def _mixed(spark, rows, parts=3, **more):
    df = ready(spark).createDataFrame([(*r, 1, "t", 2, 3, 4) for r in rows], COLUMNS)
    return mixing.mix_sources(df.repartition(parts), **more)


@pytest.mark.parametrize("copies", [4096, 4])
def test_mix_equals_sql(spark, monkeypatch, copies):
    monkeypatch.setattr(mixing, "COPIES", copies)
    monkeypatch.setattr(mixing, "PIECE_UNITS", 1)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = _rows()
    got = _mixed(spark, rows).collect()
    for r in got:
        assert sum((s.end - s.start) * s.times for s in r.spans) == r.taken <= 2 * r["size"]
        assert all(0 <= s.start < s.end <= r["size"] for s in r.spans)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = con.execute(SQL["op11_sainte_lague"]).fetchall()
    assert Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in got) == Counter(want)
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert len(by_source) == 8 and all(abs(target - taken) <= 2 * 64 for target, taken in by_source.values())
    assert Counter(map(str, _mixed(spark, rows, parts=7).collect())) == Counter(map(str, got))


def test_mix_of_nothing(spark):
    assert _mixed(spark, []).count() == 0
    assert [(r.taken, r.target, list(r.spans)) for r in _mixed(spark, [(1, None, None), (2, " ", "a")]).collect()] == [(0, 0.0, [])] * 2


def _highest_quotients(votes, seats):
    """Seats one after the other to the highest votes / (2 j - 1)."""
    given, heap = dict.fromkeys(votes, 0), [(-v, n) for n, v in votes.items()]
    heapq.heapify(heap)
    for _ in range(seats):
        _, n = heapq.heappop(heap)
        given[n] += 1
        heapq.heappush(heap, (-votes[n] / (2 * given[n] + 1), n))
    return given


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_equals_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = {n: float(rng.choice([1, 3, 50, 50, 5000]) * rng.randrange(1, 40)) for n in range(1, 30)}
    rows = [(n, False, v, 10**6, 0) for n, v in votes.items()] + [(40, True, 640.0, 5, 0), (41, False, 0.0, 0, 0)]
    df = ready(spark).createDataFrame(rows, "number long, full boolean, target double, blocks long, rest long")
    got = {r.number: r.quota for r in mixing.apportion_sources(df, 64, 2).collect()}
    assert got == _highest_quotients(votes, int(sum(votes.values()) / 64 + 0.5)) | {40: 10, 41: 0}

    blocks = {s: rng.choice([0, 1, 2, 7, 400]) for s in range(20)}
    total = sum(blocks.values())
    for quota in (0, 1, total // 3, total + 5, 2 * total - 1, 2 * total):
        lines = spark.createDataFrame([(1, s, b, total, quota) for s, b in blocks.items()], "number long, shard int, blocks long, source_blocks long, quota long")
        got = {r.shard: r.line_quota for r in mixing.apportion_lines(lines).collect()}
        assert got == _highest_quotients(blocks, quota)
        assert all(got[s] <= 2 * b for s, b in blocks.items())
