"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of every order
and a uniform one. The weights of the mixture depend on how often the longest context
seen was seen, in buckets of powers of two. They are learned by expectation-maximisation
on one part of the training documents, against counts from which that part is deleted;
scores then use the counts of all training documents.

Counts are exchanged between blocks and owners of key ranges (see ``blocks``): a frequent
n-gram leaves a block once, with its count.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import Block, per_block, round_of, sent, split, stage
from .common import fold, quoted
from .hashing import distinct, from_planes, hashes, lowered, mixed, planes, word_bounds

END, START, CHAIN = 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0xD6E8FEB86659FD93
FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: context frequencies 2**k to 2**(k+1)-1 share weights; the last bucket is open
FREQUENCIES = 16
#: estimates are told apart by tenths of a decade when weights are learned
STEP, LOWEST = 0.1, 120
FLOOR = 1e-6
#: a block's n-grams stand in memory beside their answers, and an owner holds every block's
#: n-grams of its range, most of them different: many times these bytes of text
SCORED_BYTES, COUNTED_BYTES = 2 << 20, 8 << 20


class _Tokens:
    """The n-grams of a block: one row per token, words and ends."""

    def __init__(self, b: Block, order: int):
        data = lowered(b.data)
        first, last = word_bounds(data, b.starts, b.ends)
        words = hashes(data, first, last, 3)
        doc = np.searchsorted(b.ends, first, side="right")
        self.sizes = np.bincount(doc, minlength=len(b.ids)) + 1
        close = np.cumsum(self.sizes) - 1
        token = np.full(int(self.sizes.sum()), END, np.uint64)
        token[np.arange(len(first)) + doc] = words
        self.doc = np.repeat(np.arange(len(b.ids)), self.sizes)
        self.opens = np.zeros(len(token), bool)
        self.opens[close - self.sizes + 1] = True
        self.mark = b.marks[self.doc]
        self.keys = [token]
        for _ in range(order - 1):
            before = self.shifted(self.keys[-1], START)
            self.keys.append(mixed(before * np.uint64(CHAIN) + token))

    def shifted(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before, ``at_start`` for a text's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.opens] = at_start
        return out


def _width(counts: np.ndarray) -> int:
    """Bytes that hold each of the counts."""
    most = int(counts.max(initial=0))
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)


def _asked(keys: np.ndarray, counts: np.ndarray, deleted: bool) -> bytes:
    """The counts' width, whether they are of the deleted part, keys and counts."""
    w = _width(counts)
    return bytes([w, deleted]) + planes(keys) + planes(counts.astype(f"u{w}"))


def _add(payloads: list[bytes]) -> list[bytes]:
    """Sums of the blocks' counts for each key, after the range's totals; those of the deleted part to its blocks only."""
    views = [memoryview(p)[2:] for p in payloads]
    sizes = [len(x) // (8 + p[0]) for x, p in zip(views, payloads)]
    heads, place = distinct(np.concatenate([from_planes(x[:8 * n], np.uint64) for x, n in zip(views, sizes)]))
    total, deleted = np.zeros(len(heads), np.uint64), np.zeros(len(heads), np.uint64)
    owns = list(split(place, sizes))
    for p, x, n, own in zip(payloads, views, sizes, owns):
        counts = from_planes(x[8 * n:], f"u{p[0]}")
        total[own] += counts  # a block names a key once
        if p[1]:
            deleted[own] += counts
    head = np.array([total.sum(), (total > 0).sum(), deleted.sum(), (total > deleted).sum()], np.uint64).tobytes()
    out = []
    for p, own in zip(payloads, owns):
        both = [total[own], deleted[own]] if p[1] else [total[own]]
        w = _width(both[0])
        out.append(head + bytes([w, len(both)]) + b"".join(planes(c.astype(f"u{w}")) for c in both))
    return out


def _counts(payloads: list[bytes], place: np.ndarray, k: int) -> np.ndarray:
    """All (``k`` 0) or deleted (1) counts for each token's n-gram."""
    found = []
    for p in payloads:
        w, size = p[32], (len(p) - 34) // p[33]
        found.append(from_planes(memoryview(p)[34 + k * size:34 + (k + 1) * size], f"u{w}"))
    return np.concatenate(found).astype(np.float64)[place] if found else np.zeros(len(place))


def _totals(answers: DataFrame) -> dict:
    heads = answers.where("kind = 'order1'").groupBy("part").agg(F.min(F.substring("payload", 1, 32)).alias("head"))

    def parse(frames):
        for f in frames:
            rows = [np.frombuffer(h, np.uint64).astype(np.int64) for h in f["head"]]
            yield pd.DataFrame(np.array(rows, np.int64).reshape(-1, 4), columns=["n", "v", "n_deleted", "v_rest"])

    row = heads.mapInPandas(parse, "n bigint, v bigint, n_deleted bigint, v_rest bigint") \
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_deleted", "v_rest")]).first()
    return row.asDict()


def _estimates(counts: list[np.ndarray], t: _Tokens, n: float, v: float, docs: float) -> tuple[list, np.ndarray]:
    """Maximum-likelihood estimates from order 1 up, and the bucket of each token's context."""
    rates, bucket = [counts[0] / max(n, 1)], np.zeros(len(t.doc), np.int64)
    for k in range(1, len(counts)):
        context = t.shifted(counts[k - 1], docs)
        rates.append(np.divide(counts[k], context, out=np.zeros(len(context)), where=context > 0))
        seen = context > 0
        level = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), FREQUENCIES - 1)
        bucket = np.where(seen, 1 + (k - 1) * FREQUENCIES + level, bucket)
    return rates, bucket


def learn_weights(codes: np.ndarray, n: np.ndarray, order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket: uniform first, then orders from 1 up; EM on counted estimates."""
    buckets = 1 + (order - 1) * FREQUENCIES
    pooled = np.full(order + 1, 1 / (order + 1))
    weights = np.tile(pooled, (buckets, 1))
    if not len(codes):
        return weights
    rest, steps = codes.copy(), []
    for _ in range(order):
        steps.append(rest % (LOWEST + 2))
        rest //= LOWEST + 2
    rates = np.stack([np.full(len(codes), uniform)] + [np.where(s > LOWEST, 0.0, 10.0 ** (-s * STEP)) for s in steps], 1)

    def step(w: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        post = w[of] * rates
        post *= (n / np.maximum(post.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(of, post[:, k], size) for k in range(order + 1)], 1)
        total = sums.sum(1, keepdims=True)
        new = np.where(total > 0, sums / np.maximum(total, 1e-300), w)
        new = np.maximum(new, FLOOR)
        return new / new.sum(1, keepdims=True)

    for _ in range(rounds):
        pooled = step(pooled[None], np.zeros(len(codes), np.int64), 1)[0]
    weights[:] = pooled
    for _ in range(rounds):
        weights = step(weights, rest, buckets)
    return weights


def score_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words between blanks, tabs and line ends, A-Z lower-cased, and one end per
    text. Documents whose crc32(id as text) modulo 10 is 0 are held out of all learning;
    those where it is 1 teach the mixture weights. ``base_score`` is additive unigrams,
    ``score`` the interpolated model, both sums of log10 over the tokens. Null and empty
    texts have the end only. Without training documents counts are 0 and the mixture is
    uniform; without documents for the weights, all weights are equal. Repeated rows
    count and are answered each; extra columns are not read; an empty table gives no rows.
    """
    if order < 1:
        raise ValueError("order must be positive")
    staged = stage(docs, id, text, mark=fold(quoted([id])[0], FOLDS), block_bytes=SCORED_BYTES, range_bytes=COUNTED_BYTES,
                   apart=DELETED)
    # blocks below ``apart`` are of the deleted part alone, which no other block has
    ranges, apart = staged.ranges, staged.apart

    def sender(k: int):
        def send(block: int, b: Block, got: dict) -> pa.Table:
            t = _Tokens(b, k)
            keys = t.keys[k - 1]
            heads, place = distinct(keys)
            hi = keys[heads]
            total = np.bincount(place[t.mark != HELD_OUT], minlength=len(heads))
            return sent(block, hi, ranges, lambda s: _asked(hi[s], total[s], block < apart))
        return send

    answers = None
    for k in range(1, order + 1):
        answers = round_of(staged, sender(k), _add, answers, f"order{k}")
    sums = _totals(answers)
    n, v = sums["n"], sums["v"]
    marks = staged.rows.agg(F.count(F.when(F.col("mark") != HELD_OUT, 1)).alias("train"),
                            F.count(F.when(F.col("mark") == DELETED, 1)).alias("deleted")).first()
    train, rest = marks["train"], marks["train"] - marks["deleted"]
    n_rest, v_rest = n - sums["n_deleted"], sums["v_rest"]

    def looked_up(b: Block, got: dict, without_deleted: bool) -> tuple[_Tokens, list]:
        t, counts = _Tokens(b, order), []
        for k in range(order):
            payloads, place = got.get(f"order{k + 1}", []), distinct(t.keys[k])[1]
            counts.append(_counts(payloads, place, 0))
            if without_deleted:
                counts[-1] -= _counts(payloads, place, 1)
        return t, counts

    def estimates(block: int, b: Block, got: dict) -> pa.Table:
        t, counts = looked_up(b, got, True)
        rates, code = _estimates(counts, t, n_rest, v_rest, rest)
        for r in reversed(rates):
            q = np.full(len(r), LOWEST + 1, np.int64)
            np.clip(np.rint(-np.log10(r, out=np.zeros(len(r)), where=r > 0) / STEP), 0, LOWEST, out=q, where=r > 0, casting="unsafe")
            code = code * (LOWEST + 2) + q
        codes, times = np.unique(code, return_counts=True)
        return pa.table({"code": pa.array(codes, pa.int64()), "n": pa.array(times, pa.int64())})

    # the deleted part stands in blocks of its own, so that no other text or answer is read;
    # buckets times steps: a table of bounded size, whatever the corpus
    part = replace(staged, rows=staged.rows.where(F.col("block") < staged.apart))
    learned = per_block(part, answers.where(F.col("block") < staged.apart), estimates, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(learned["code"].to_numpy(np.int64), learned["n"].to_numpy(np.float64), order, 1 / (v_rest + 1))

    kind = docs.schema[id].dataType
    id_type = to_arrow_type(kind)

    def score(block: int, b: Block, got: dict) -> pa.Table:
        t, counts = looked_up(b, got, False)
        rates, bucket = _estimates(counts, t, n, v, train)
        p = weights[bucket, 0] / (v + 1)
        for k, r in enumerate(rates):
            p += weights[bucket, k + 1] * r
        size, known, base, model = len(b.ids), counts[0] > 0, np.log10((counts[0] + 0.1) / (n + 0.1 * (v + 1))), np.log10(p)
        return pa.table({"doc_id": pa.array(b.ids, id_type), "held_out": pa.array(b.marks == HELD_OUT),
                         "n_tokens": pa.array(t.sizes, pa.int64()),
                         "n_known": pa.array(np.bincount(t.doc, known, size).astype(np.int64)),
                         "train_tokens": pa.array([n] * size, pa.int64()),
                         "base_score": pa.array(np.bincount(t.doc, base, size)),
                         "score": pa.array(np.bincount(t.doc, model, size))})

    return per_block(staged, answers, score, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, "
                     "train_tokens bigint, base_score double, score double")
