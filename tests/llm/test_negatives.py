"""Hard negatives against all pairs in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int, no int, block string, id int, x int"


def frame(spark, rows):
    """Rows with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, v, l, 1, "b", 2, 3) for i, v, l in rows], SCHEMA)


def brute(rows, k=5, low=80, high=100):
    held = {(i, l, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, l in rows
            if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)}
    out = []
    for i, label, x in held:
        if i % 10:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in held if j != i))
        for s, p, _ in [t for t in scored if t[2] == label][:k]:
            found = [(n, -t) for t, n, m in scored if m != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, p, r + 1, n, -s, t) for r, (n, t) in enumerate(found)]
    return Counter(out)


def rows_of(n, dim, seed, spread=1.0, labels=4):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "anchor_bytes": 700}])
def test_against_all_pairs(spark, sizes):
    rows = rows_of(300, 20, 1)
    base = rows[10][1]
    rows += [(1000 + i, base, i % 3) for i in range(40)]  # ties, and positives of the highest score
    rows += [(10, base, rows[10][2]), (10, base, rows[10][2]), (20, [1.0] * 20, 1), (7, [0.1] * 20, 2)]  # repeated rows and ids
    rows += [(50 + i, [0.0] * 20, i % 2) for i in range(10)]  # no product at all
    rows += [(None, base, 1), (2000, None, 1), (2001, base, None), (2002, [], 1), (2003, [float("nan")] * 20, 1),
             (2004, [None] + base[1:], 1), (2010, [float("inf")] * 20, 0), (-30, base, 1), (-7, base, 2)]
    got = negatives.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, **sizes).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = rows_of(80, 70, 2, spread=9000.0, labels=2)  # beyond what doubles add exactly
    got = negatives.mine(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_few_rows(spark):
    every = F.col("vec_id") % 10 == 0
    assert negatives.mine(frame(spark, rows_of(9, 3, 1)).limit(0), every).collect() == []
    assert negatives.mine(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), every).collect() == []  # no anchor
    assert negatives.mine(frame(spark, [(0, [1.0], 1)]), every).collect() == []
    assert [tuple(r) for r in negatives.mine(frame(spark, [(0, [1.0], 1), (1, [2.0], 1), (3, [1.9], 0)]), every).collect()] \
        == [(0, 1, 1, 3, 131072, 124416)]
    with pytest.raises(ValueError, match="dimensions"):
        negatives.mine(frame(spark, [(0, [1.0], 1), (1, [2.0, 1.0], 1)]), every)


def test_bounds_drop_rows_before_the_last_dimension():
    rng = np.random.default_rng(1)
    columns = (rng.standard_normal((32, 4000)) * 100 / (1 + np.arange(32))[:, None] ** 2).astype(np.int32)
    block = negatives.Block(np.arange(4000).tobytes(), (np.arange(4000) % 2).tobytes(), [c.tobytes() for c in columns])
    seen = []
    query = columns[:, 7].astype(np.int64)

    def needed(low, high):
        seen.append(len(low))
        return high >= negatives.kth_largest(low, 5) if len(low) > 5 else np.ones(len(low), bool)

    rows, scores = block.scan(query, np.arange(4000), needed)
    exact = query @ columns
    assert (scores == exact[rows]).all() and seen[-1] < seen[0] / 4
    assert set(np.argsort(-exact)[:5]) <= set(rows)
