"""Quality classifier: a convolutional network over the bytes of the whole text.

Filters look at overlapping chunks of ``WIDTH`` bytes, one chunk every ``STRIDE`` bytes,
from the first byte to the last. Besides its value a byte carries one bit: whether the
bytes before it repeat what stands a short distance earlier. The largest response of each
filter over all chunks goes into one logistic output. The network is trained with NumPy
on a bounded sample of labelled texts; scoring reads every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .common import fold, fresh, quoted

WIDTH, STRIDE, FILTERS = 12, 4, 24
#: distances at which a repetition counts, and how many bytes must repeat
LAGS, RUN = range(2, 25), 6
#: the training sample: at most so many texts, of each a window of so many characters
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 2000
EPOCHS, BATCH, RATE = 8, 32, 0.004
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


@dataclass
class Net:
    filters: np.ndarray  # (WIDTH, 512, FILTERS): byte value, plus 256 if it ends a repetition
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def symbols(text: str | None) -> np.ndarray:
    """Bytes 0-255, plus 256 where the last ``RUN`` bytes stand a short distance earlier too.

    Two bytes each, as the driver holds the whole sample in this form.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    if n < RUN:
        return raw.astype(np.int16)
    word = np.zeros(n, np.uint64)
    for k in range(RUN):
        word[k:] |= raw[:n - k].astype(np.uint64) << np.uint64(8 * k)
    again = np.zeros(n, bool)
    for lag in LAGS:
        if n > lag + RUN:
            again[lag + RUN:] |= word[lag + RUN:] == word[RUN:-lag]
    return raw + again.astype(np.int16) * np.int16(256)


def chunk_count(n: int) -> int:
    return max(1, -(-(n - WIDTH) // STRIDE) + 1) if n > WIDTH else 1


def pooled(net: Net, seq: np.ndarray, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter, and the chunk that gave it."""
    n = chunk_count(len(seq))
    full = np.zeros((n - 1) * STRIDE + WIDTH, np.int64)
    full[:len(seq)] = seq
    best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
    for low in range(0, n, step):
        m = min(step, n - low)
        acc = np.zeros((m, FILTERS), np.float32)
        for k in range(WIDTH):
            acc += net.filters[k][full[low * STRIDE + k:(low + m - 1) * STRIDE + k + 1:STRIDE]]
        top = acc.argmax(0)
        value = acc[top, np.arange(FILTERS)]
        better = value > best
        best[better], where[better] = value[better], top[better] + low
    return best + net.bias, where


def probability(net: Net, text: str | None) -> float:
    best, _ = pooled(net, symbols(text))
    z = float(np.maximum(best, 0) @ net.out + net.out_bias)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Net:
    """Adam on the log loss. Only the pooled chunks get gradients."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.05, (WIDTH, 512, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
              np.where(np.arange(FILTERS) % 2 == 0, 0.5, -0.5).astype(np.float32), 0.0)
    if not len(texts) or labels.min() == labels.max():
        net.out[:] = 0
        net.out_bias = float(np.clip(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)), -5, 5)) if len(texts) else 0.0
        return net
    net.out_bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seqs = [symbols(t) for t in texts]
    moments = [np.zeros_like(net.filters), np.zeros_like(net.filters)]
    small = np.zeros((2, 2 * FILTERS + 1))
    epochs = max(EPOCHS, min(40, EPOCHS * 1500 // len(texts)))  # small samples need more steps
    count = 0
    for epoch in range(epochs):
        order = rng.permutation(len(seqs))
        rate = RATE * (1 - epoch / epochs) + 2e-4
        for low in range(0, len(order), BATCH):
            grad = np.zeros_like(net.filters)
            grad_small = np.zeros(2 * FILTERS + 1)
            batch = order[low:low + BATCH]
            for i in batch:
                best, where = pooled(net, seqs[i])
                act = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.out_bias, -30, 30)))
                d = (p - labels[i]) / len(batch)
                grad_small += np.concatenate([d * net.out * (best > 0), d * act, [d]])
                for f in np.flatnonzero(best > 0):
                    at = where[f] * STRIDE
                    piece = seqs[i][at:at + WIDTH]
                    grad[np.arange(len(piece)), piece, f] += d * net.out[f]
            count += 1
            for m, g, k in ((moments, grad, 1), (small, grad_small, 0)):
                m[0][...] = 0.9 * m[0] + 0.1 * g
                m[1][...] = 0.99 * m[1] + 0.01 * g * g
                step = rate * (m[0] / (1 - 0.9 ** count)) / (np.sqrt(m[1] / (1 - 0.99 ** count)) + 1e-6)
                if k:
                    net.filters -= step.astype(np.float32)
                else:
                    net.bias -= step[:FILTERS].astype(np.float32)
                    net.out -= step[FILTERS:-1].astype(np.float32)
                    net.out_bias -= float(step[-1])
    return net


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Net:
    """Train on at most ``rows`` labelled texts outside the held-out fold, chosen by hash.

    A text longer than ``chars`` gives a window of that length at a place that the hash
    chooses, so the sample that reaches the driver is bounded. Null labels are left out.
    """
    key, content = quoted([id, text])
    known = labels.select(quoted([id])[0].alias("k"), quoted([label])[0].cast("int").alias("y")).where("y is not null")
    chosen = known.where(fold(F.col("k"), FOLDS) != HELD_OUT).withColumn("at", F.xxhash64("k")) \
        .orderBy("at", "k").limit(rows)
    own = docs.select(key.alias("k"), F.coalesce(content, F.lit("")).alias("t"))
    low = F.pmod(F.col("at"), F.greatest(F.lit(1), F.char_length("t") - chars)) + 1
    sample = own.join(F.broadcast(chosen), "k").select("k", "y", "at", F.substr("t", low.cast("int"), F.lit(chars)).alias("t")) \
        .orderBy("at", "k", "t").limit(rows).collect()
    return train([r["t"] for r in sample], np.array([float(r["y"]) for r in sample]))


def with_score(docs: DataFrame, net: Net, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the probability of label 1, for every whole text (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast((net.filters, net.bias, net.out, net.out_bias))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Net(*shared.value)
        for texts in batches:
            yield texts.map(lambda t: probability(own, t), na_action=None).astype(float)

    return docs.withColumn(name, F.pandas_udf(score, T.DoubleType())(F.coalesce(quoted([text])[0], F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
             label: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Labels are learned only from documents whose crc32(id as text) modulo 5 isn't 0; the
    others are ``held_out``. A score needs the text alone. Null texts count as empty and
    have the score of no bytes; equal texts have equal scores; repeated rows are scored
    each. Without labels of both kinds every text has the same score. An empty table gives
    no rows; extra columns are not read.
    """
    net = fit(docs, labels, id, text, label)
    key, content = quoted([id, text])
    rows = docs.select(key.alias("doc_id"), fold(key, FOLDS).alias("f"), content.alias("text"))
    return with_score(rows, net).select("doc_id", (F.col("f") == HELD_OUT).alias("held_out"), "score",
                                        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
              label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, columns as they were."""
    net, name = fit(docs, labels, id, text, label), fresh(docs, "quality_score")
    return with_score(docs, net, text, name).where(F.col(name) >= THRESHOLD).drop(name)
