"""Repeated passages against a plain scan of all windows."""

import hashlib
import random
from collections import Counter

import pytest
from lodestone.llm.repeats import COVERS, cover_for, find_repeats


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, length, **options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted((tuple(r) for r in find_repeats(df, length=length, **options).collect()), key=repr)


def test_covers_reach_every_difference():
    for v, members in COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))
    assert cover_for(200)[0] == 133 and cover_for(1)[0] == 1


@pytest.mark.parametrize("length", [3, 20, 60])
def test_random_texts(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choices("abé ", k=rng.randint(length // 2, 3 * length))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < .6 else "".join(rng.choices("xyz\n", k=rng.randint(0, length)))
                        for _ in range(rng.randint(0, 5)))) for i in range(60)]
    assert found(spark, rows, length, block_bytes=2000) == brute(rows, length)


def test_edges(spark):
    # null, empty, too short, a run that overlaps itself, repeated rows, null and repeated ids
    rows = [(1, None), (2, ""), (3, "short"), (4, "a" * 50), (5, "b" * 19 + "c" * 20), (6, "same text " * 4),
            (6, "same text " * 4), (None, "q" * 20), (None, None), (7, "x" * 19)]
    assert found(spark, rows, 20) == brute(rows, 20)
    assert found(spark, [], 20) == []


def test_long_and_wide(spark):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh ", k=300_000))
    df = spark.createDataFrame([(1, long, "x", 1), (2, long[1000:200_000], "y", 2)],
                               "doc_id bigint, text string, block string, mark int")
    got = {r["doc_id"]: r for r in find_repeats(df).collect()}
    assert (got[1]["n_removed"], got[1]["n_spans"]) == (199_000, 1) and got[2]["n_removed"] == 199_000


def test_passes_hash_the_bytes_of_their_windows_only(monkeypatch):
    """A pass over a block of which little is open hashed all of it, and all names, again."""
    import numpy as np
    from lodestone.llm import repeats
    from lodestone.llm.blocks import Block, to_bits
    data = np.random.default_rng(3).integers(0, 256, 300_000).astype(np.uint8)
    block = Block([1, 2], data, np.array([0, 100_000]), np.array([100_000, 300_000]), np.zeros(2))
    hashed, plain = [], repeats.Stretches
    monkeypatch.setattr(repeats, "Stretches", lambda part, seed: hashed.append(len(part)) or plain(part, seed))
    view = repeats._View(block, 200)
    flags = np.zeros(len(view.cover), bool)
    flags[[5, 6, 9000]] = True
    repeated = view.repeated({"ranks kept": [to_bits(flags)]})
    starts = view.around(repeated, {"marks": [to_bits(np.ones(3, bool))]})
    hi, lo = view.keys(starts)
    assert len(starts) > 100 and sum(hashed) < 5000
    whole = plain(data, 1).of(starts, starts + 200)
    assert (hi == whole).all() and (lo == plain(data, 2).of(starts, starts + 200) >> np.uint64(32)).all()
    want = np.zeros(len(data), bool)
    for s in starts.tolist():
        want[s:s + 200] = True
    assert (view.covered(starts) == want).all()
    near = (view.cover[:, None] + np.arange(-132, 1))[flags]
    assert starts.tolist() == sorted({int(x) for x in near.ravel() if x >= 0})
