"""Whitened embeddings against a standard eigensolver and exact integers."""

import math

import numpy as np
import pytest
from lodestone.llm import queries
from lodestone.llm.common import table
from lodestone.llm.spectral import components
from lodestone.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>, id int, x string, component int"


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, 0, "x", 7) for i, v in rows], SCHEMA)


def brute(rows):
    """What the result must be, by id and component: n, deviation, |whitened|, explained."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    steps = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in usable]
    fit = sorted({tuple(x) for _, x in steps})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * x - s) / n for x, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in steps:
        exact = [n * a - s for a, s in zip(x, sums)]
        for c in range(1, min(16, len(sums)) + 1):
            white = np.array(exact) / n @ vectors[:, -c] / math.sqrt(values[-c]) if values[-c] > 1e-9 else 0.0
            share = values[-c] / values.sum() if values[-c] > 1e-9 else 0.0
            out.append((i, c, n, sum(e * e for e in exact), abs(white), share))
    return out


def same(got, want):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=order)
    want = sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in (4, 5):
        assert np.allclose([r[k] for r in got], [r[k] for r in want], rtol=1e-6, atol=1e-6)


def test_query_against_a_standard_solver(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    got = queries.QUERIES["op11_whiten"](spark, sf).collect()
    same(got, brute(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    # signs are the same for all rows: every component has mean 0 over distinct rows
    white = np.array([r.whitened for r in sorted(got, key=lambda r: (r.component, r.vec_id))]).reshape(16, -1)
    assert np.abs(white @ white.T / white.shape[1] - np.eye(16)).max() < 1e-6


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(5) * [9, 5, 2, 1, .3]]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5),
           (104, [float("inf")] + [1.0] * 4), (None, rows[0][1]), (0, rows[0][1]), (7, rows[7][1]), (105, rows[7][1])]
    got = whiten(frame(spark, rows + odd)).collect()
    same(got, brute(rows + odd))
    assert got[0].n == len({tuple(math.floor(64 * float(np.float32(c))) for c in v) for _, v in rows})
    assert whiten(frame(spark, rows).limit(0)).collect() == []
    assert whiten(frame(spark, odd[:5])).collect() == []
    with pytest.raises(ValueError, match="dimensions"):
        whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    named = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 1.0])], "vec_id string, embedding array<double>")
    assert {r.vec_id for r in whiten(named).collect()} == {"a", "b"}


def test_no_variance(spark):
    one = whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] \
        == [(1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)] * 2
    flat = [(i, [float(i), 2.0 * i, 3.0]) for i in range(20)]  # one direction only
    got = whiten(frame(spark, flat)).collect()
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 1)
    assert got[0].identity_error < 1e-9 and {round(r.explained, 9) for r in got if r.component == 1} == {1}


def test_values_beyond_the_bound(spark):
    got = whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
    assert got[0].identity_error < 1e-4


@pytest.mark.parametrize("kind", ["full", "rank", "whole", "graded", "clustered", "ties"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_components(kind, n):
    rng = np.random.default_rng(n)
    basis, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"full": rng.random(n), "rank": np.where(np.arange(n) < n // 2, rng.random(n), 0.0),
              "whole": np.round(rng.standard_normal(n)), "graded": 10.0 ** -np.arange(n).clip(0, 14),
              "clustered": 1 + 1e-13 * rng.random(n), "ties": np.ones(n)}[kind]
    a = np.diag(values) if kind == "whole" else basis @ np.diag(values) @ basis.T
    found, vectors = components(a)
    scale = max(1.0, np.abs(values).max())
    assert np.allclose(found, np.sort(values)[::-1], atol=1e-13 * scale)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * found).max() < 1e-13 * scale
