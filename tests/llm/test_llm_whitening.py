"""Whitening against plain fractions: every covariance, deviation and component."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_DIR

from tidewatch.llm import whitening
from tidewatch.llm.common import ready, table
from tidewatch.llm.queries import QUERIES


def _covariance(vectors):
    n, width = len(vectors), len(vectors[0])
    mean = [Fraction(sum(v[d] for v in vectors), n) for d in range(width)]
    centred = [[x - m for x, m in zip(v, mean, strict=True)] for v in vectors]
    return [[sum(c[i] * c[j] for c in centred) / n for j in range(width)] for i in range(width)], mean


def _check(rows, got, scale, offset, most):
    """``rows`` (id, vector) that remain; ``got`` the result's rows."""
    whole = [(i, [math.floor(scale * float(c)) + offset for c in v]) for i, v in rows]
    fit = [list(v) for v in {tuple(v) for _, v in whole}]
    exact, mean = _covariance(fit)
    matrix = np.array([[float(c) for c in row] for row in exact])
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    n, count = len(fit), min(most, int((values > values[0] * 1e-12).sum()))
    sums = [sum(v[d] for v in fit) for d in range(len(mean))]
    assert len(got) == len(rows) * count
    by_id = defaultdict(list)
    for r in sorted(got, key=lambda r: r.component):
        by_id[r.vec_id].append(r)
    signs = None
    for i, x in whole:
        own = by_id[i]
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert {(r.n, int(r.deviation)) for r in own} == {(n, deviation)}
        plain = np.array([float(a - m) for a, m in zip(x, mean, strict=True)]) @ vectors[:, :count] / np.sqrt(values[:count])
        white = np.array([r.whitened for r in own[:count]])
        if signs is None:
            signs = np.sign(plain * white)
        assert np.allclose(white, plain * signs, rtol=1e-6, atol=1e-6)
        assert np.allclose([r.explained for r in own[:count]], values[:count] / np.trace(matrix), rtol=1e-6)
    assert all(0 <= r.identity_error < 1e-9 for r in got)


def test_query_equals_fractions(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF_DIR, "embeddings").collect()]
    got = QUERIES["op13_polarised_whitening"](spark, SF_DIR)
    assert dict(got.dtypes)["deviation"] == dict(got.dtypes)["n"] == "bigint"
    _check(rows, got.collect(), 64, 1_000_000, 16)


def test_nulls_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1] + [0, 1e4, 0, -7, 0]).tolist()) for i in range(40)]
    rows += [(100, rows[0][1]), (101, rows[1][1]), (102, [c + 1e-9 for c in rows[2][1]])]
    bad = [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] + [0.0] * 4), (204, [])]
    df = ready(spark).createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows + bad], "vec_id long, embedding array<double>, n long, component string, x double")
    got = whitening.whiten(df.repartition(5), 16).collect()
    _check(rows, got, 64, 1_000_000, 16)
    null_key = df.selectExpr("CAST(NULL AS bigint) AS vec_id", "embedding")
    assert whitening.whiten(null_key, 2).filter("vec_id IS NULL").count() == 2 * len(rows)


@pytest.mark.parametrize("size", [1e3, 1e9, 1e16])
def test_large_components_and_small_variances(spark, size):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 4)) * [1e3, 10, 1, 0.05] + size
    rows = list(enumerate(base.tolist()))
    df = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    _check(rows, whitening.whiten(df).collect(), 64, 1_000_000, 16)


def test_lengths_are_fits_of_their_own_and_nothing_gives_nothing(spark):
    rows = [(1, [1.0, 2.0]), (2, [2.0, 0.5]), (3, [0.1, 0.2]), (4, [1.0]), (5, [2.0]), (6, [7.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    for ids, width in (({1, 2, 3}, 2), ({4, 5, 6}, 1)):
        _check([r for r in rows if r[0] in ids], [r for r in got if r.vec_id in ids], 64, 1_000_000, 16)
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 5, 6}
    for some in (df.limit(0), df.filter("vec_id = 1"), df.filter("vec_id = 8")):
        empty = whitening.whiten(some)
        assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "component", "n"]
