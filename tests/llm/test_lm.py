"""Interpolated scores against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestone.llm import lm
from lodestone.llm.common import table
from lodestone.llm.lm import learn_weights, score_texts


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute_base(rows):
    train = Counter(t for i, x in rows if zlib.crc32(str(i).encode()) % 10 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    return {i: (zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n,
                sum(math.log10((train[t] + .1) / (n + .1 * (v + 1))) for t in tokens(x))) for i, x in rows}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, sf, order):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_base(rows)
    got = score_texts(docs, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # the mixture predicts better


def test_probabilities_sum_to_one(spark):
    # after "a" in training: every continuation, seen or not, must share one unit
    docs = [(i, "a b" if i % 2 else "a c") for i in range(200)]
    probes = [(1000 + k, t) for k, t in enumerate(["a", "b", "c"])]
    got = {r["doc_id"]: r["score"] for r in score_texts(
        spark.createDataFrame(docs + probes, "doc_id bigint, text string")).collect()}
    assert got[1] > got[1000] and got[1] > got[1001]


def test_em_finds_the_source():
    # estimates of order 1 that explain everything take all the weight
    rates = np.array([3, 5, 8])
    codes = rates  # bucket 0, order 1 only
    w = learn_weights(codes, np.array([50.0, 30.0, 20.0]), 1, 1e-9)
    assert w[0, 1] > 0.999


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "word " * 50_000), (4, "É é")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, block int, mark string")
    got = score_texts(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_tokens"] == 1 and by[3]["n_tokens"] == 50_001 and by[4]["n_tokens"] == 3
    assert score_texts(df.limit(0)).collect() == []


def test_weights_are_learned_from_blocks_of_their_own(spark, monkeypatch):
    """Estimates for the mixture open the deleted part's blocks, not all texts."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 30))) for i in range(400)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r["doc_id"]: r["score"] for r in score_texts(docs).collect() if r["doc_id"] not in (7, None)}
    read, plain = [], lm.per_block

    def seen(staged, answers, fn, schema):
        if fn.__name__ == "estimates":
            read.append({r["mark"] for r in staged.rows.select("mark").distinct().collect()})
        return plain(staged, answers, fn, schema)

    monkeypatch.setattr(lm, "SCORED_BYTES", 4000)
    monkeypatch.setattr(lm, "per_block", seen)
    got = {r["doc_id"]: r["score"] for r in score_texts(docs).collect() if r["doc_id"] not in (7, None)}
    assert read == [{lm.DELETED}] and got == pytest.approx(want, rel=1e-9)


def test_counts_take_the_room_they_need():
    """Large counts stay whole, small ones take a byte, and blocks outside the deleted part get no counts of it."""
    keys = np.array([3, 9, 1 << 63], np.uint64)
    sent = [lm._asked(keys, np.array([5, 1 << 33, 0]), False), lm._asked(keys[:2], np.array([2, 3]), True),
            lm._asked(keys[2:], np.array([0]), False)]
    assert len(sent[1]) == 2 + 2 * 9
    first, second, third = lm._add(sent)
    assert np.frombuffer(first[:32], np.uint64).tolist() == [10 + (1 << 33), 2, 5, 2]
    at = np.arange(3)
    assert lm._counts([first], at, 0).tolist() == [7, 3 + (1 << 33), 0] and len(first) == 34 + 3 * 8
    assert lm._counts([second], at[:2], 0).tolist() == [7, 3 + (1 << 33)] and lm._counts([second], at[:2], 1).tolist() == [2, 3]
    assert lm._counts([third, second], np.array([0, 2]), 0).tolist() == [0, 3 + (1 << 33)] and len(third) == 34 + 1
