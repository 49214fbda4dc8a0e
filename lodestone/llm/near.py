"""Near duplicates by DartMinHash over word shingles.

Each shingle owns a region whose width is its weight. Darts, hashed per shingle and
region cell, fall on it at rate one per unit of area, at a rank (height) that is hashed
too. Only darts below a height that leaves about ``k ln k + 2k`` of them per text are
looked at; each falls on one of ``k`` coordinates, and the lowest dart of a coordinate is
its signature value. Two texts agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates make buckets; candidates are verified
on their shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, checkpointed, fresh, quoted
from .hashing import Stretches, distinct, lowered, mixed, word_bounds
from .links import link_groups

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: longs of parities that a set is compared by first
WORDS = 16
GOLDEN = 0x9E3779B97F4A7C15
#: bytes of texts that a task works on at once; its arrays take some 60 times as much
SLICE_BYTES = 512 << 10
#: chances that a cell of area one holds at most 0, 1, 2, ... darts (Poisson, mean 1)
AT_MOST = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def dart_signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures ``(n, k)`` of ``n`` weighted sets; ``owner`` says whose each element is.

    Empty sets have a signature of zeros. Coordinates that no dart reached are tried
    again below twice the height.
    """
    out = np.zeros((n, k), np.uint64)
    mass = np.bincount(owner, weights, n)
    height = np.divide(k * np.log(k) + 2 * k, mass, out=np.zeros(n), where=mass > 0)
    todo = mass > 0
    while todo.any():
        use = todo[owner]
        own, key, weight = owner[use], keys[use], weights[use]
        # columns of the plane: [0,1), [1,2), [2,4), [4,8), ... up to the weight
        columns = np.where(weight <= 1, 1, 2 + np.floor(np.log2(np.maximum(weight, 1) - 1e-12)).astype(np.int64))
        at = np.repeat(np.arange(len(own)), columns)
        nu = np.arange(len(at)) - np.repeat(np.cumsum(columns) - columns, columns)
        left = np.where(nu == 0, 0.0, 2.0 ** (nu - 1))
        width = np.where(nu == 0, 1.0, left)
        # cells of area one, stacked from rank 0 up to the height
        cells = np.ceil(height[own[at]] * width).astype(np.int64)
        cell = np.repeat(np.arange(len(at)), cells)
        rho = np.arange(len(cell)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mixed(key[at[cell]] + np.uint64(GOLDEN) * (nu[cell] * 1_000_003 + rho + 1).astype(np.uint64))
        darts = np.searchsorted(AT_MOST, _unit(seed), side="right")
        dart = np.repeat(np.arange(len(cell)), darts)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = mixed(seed[dart] ^ mixed(nth.astype(np.uint64) + np.uint64(77)))
        col = cell[dart]
        x = left[col] + width[col] * _unit(mixed(name ^ np.uint64(GOLDEN)))
        rank = (rho[dart] + _unit(mixed(name + np.uint64(GOLDEN)))) / width[col]
        own_dart = own[at[col]]
        good = (x < weight[at[col]]) & (rank < height[own_dart])
        own_dart, name, rank = own_dart[good], name[good], rank[good]
        place = own_dart * k + (name % np.uint64(k)).astype(np.int64)
        order = np.lexsort((name, rank))[::-1]  # the lowest dart is written last
        flat = np.zeros(n * k, np.uint64)
        flat[place[order]] = name[order] | np.uint64(1)
        flat = flat.reshape(n, k)
        full = todo & (flat != 0).all(1)
        # below twice the height the darts seen so far stay the lowest
        out[todo] = flat[todo]
        todo &= ~full
        height[todo] *= 2
    return out


def shingles_of(texts: list[bytes], size: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: owner, key, weight. Texts of fewer words are one shingle."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = lowered(np.frombuffer(b"".join(texts), np.uint8))
    first, last = word_bounds(data, ends - lengths, ends)
    words = Stretches(data, 5).of(first, last)
    doc = np.searchsorted(ends, first, side="right")
    many = np.bincount(doc, minlength=len(texts))
    starts = np.cumsum(many) - many
    used = np.minimum(many, size)
    rows = np.maximum(many - size + 1, np.minimum(many, 1))
    owner = np.repeat(np.arange(len(texts)), rows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows) + starts[owner]
    key = np.zeros(len(owner), np.uint64)
    for k in range(size):
        inside = k < used[owner]
        word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else key
        key = np.where(inside, mixed(key * np.uint64(GOLDEN) + word), key)
    heads, place = distinct(owner.astype(np.uint64), key)
    weight = np.bincount(place, minlength=len(heads)).astype(np.float64) if counted else np.ones(len(heads))
    return owner[heads], key[heads], weight


def _slices(texts: Iterable[str]) -> Iterator[tuple[slice, list[bytes]]]:
    """Neighbouring texts as bytes, together little: a longer text stands alone."""
    low, size, held = 0, 0, []
    for k, text in enumerate(texts):
        body = text.encode("utf-8", "replace")
        if held and size + len(body) > SLICE_BYTES:
            yield slice(low, k), held
            low, size, held = k, 0, []
        size += len(body)
        held.append(body)
    if held:
        yield slice(low, low + len(held)), held


def similar(rows: pd.DataFrame) -> np.ndarray:
    """Weighted Jaccard similarity of the pairs in ``set_a``, ``set_b`` (keys, then weights)."""
    out = np.zeros(len(rows))
    for i, (a, b) in enumerate(zip(rows["set_a"], rows["set_b"])):
        a, b = np.frombuffer(a, np.uint64).reshape(2, -1), np.frombuffer(b, np.uint64).reshape(2, -1)
        _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        common = np.minimum(a[1][at_a], b[1][at_b]).sum()
        out[i] = common / max(float(a[1].sum() + b[1].sum() - common), 1.0)
    return out


def find_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                counted: bool = True) -> DataFrame:
    """One row per document: ``doc_id, class_id, class_size, n_links, kept``.

    Documents are linked if the Jaccard similarity of their shingles of ``shingle`` words,
    each weighed by its occurrences, is at least ``similarity``, and equal texts (A-Z
    lower-cased) always; classes are the components. Without ``counted`` all weights are 1. ``class_id`` is the smallest id of the class, whose row is ``kept``.
    ``n_links`` counts verified links of a document's text with different texts; links
    inside a component that were already implied need not be among them.

    Texts of fewer words are one shingle. Texts without words, null included, are linked
    only to equal ones. Rows that repeat an id and a text share their class, and one of
    equal ids is kept as often as it is there. An empty table gives no rows; extra
    columns are not read.
    """
    key, content = quoted([id, text])
    plain = docs.select(key.alias("doc_id"), ascii_lower(F.coalesce(content, F.lit(""))).alias("body"))
    hashed = plain.select("doc_id", F.sha2("body", 256).alias("sha"), "body")
    k = bands * rows

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, bodies in _slices(frame["body"]):
                owner, keys, weights = shingles_of(bodies, shingle, counted)
                n = part.stop - part.start
                sig = dart_signatures(owner, keys, weights, n, k).reshape(n, bands, rows)
                band = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    band = mixed(band * np.uint64(GOLDEN) + sig[:, :, r])
                some = np.bincount(owner, minlength=n) > 0
                yield frame.iloc[part][["doc_id", "sha"]].assign(
                    bands=[b.tolist() if s else [] for b, s in zip(band.view(np.int64), some)])

    id_type = docs.schema[id].dataType.simpleString()
    signed = checkpointed(hashed.mapInPandas(sign, f"doc_id {id_type}, sha string, bands array<bigint>"), "signatures")
    # one node per different text; the number is fixed by writing it
    nodes = checkpointed(signed.groupBy("sha").agg(F.first("bands").alias("bands"), F.min("doc_id").alias("rep"))
                         .withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))

    def describe(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        wanted = nodes.join(asked, "node").select("node", "sha", "rep")

        def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part, bodies in _slices(frame["body"]):
                    n = part.stop - part.start
                    owner, keys, weights = shingles_of(bodies, shingle, counted)
                    at = np.searchsorted(owner, np.arange(n + 1))
                    # the k-th occurrence of a shingle is an element of its own, so that
                    # the bound by parities and sizes holds for weights too
                    times = weights.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    element = np.repeat(keys, times) + np.uint64(GOLDEN) * nth.astype(np.uint64)
                    cells = np.repeat(owner, times) * (64 * WORDS) + (mixed(element) % np.uint64(64 * WORDS)).astype(np.int64)
                    odd = np.bincount(cells, minlength=n * 64 * WORDS).astype(np.uint8) & 1
                    yield frame.iloc[part][["node"]].assign(
                        set=[keys[i:j].tobytes() + weights[i:j].astype(np.uint64).tobytes() for i, j in zip(at, at[1:])],
                        marks=list(np.packbits(odd).view(np.int64).reshape(n, WORDS)),
                        size=np.bincount(owner, weights, n))

        # a text's first row stands for its copies
        texts = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["rep"])).where(F.sha2("body", 256) == F.col("sha")) \
            .select("node", "body")
        sets = checkpointed(texts.mapInPandas(pack, "node bigint, set binary, marks array<bigint>, size double").groupBy("node")
                            .agg(F.min("set").alias("set"), F.min("marks").alias("marks"), F.min("size").alias("size")), "sets")
        return sets.select("node", "set"), sets.select("node", "size", "marks")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[similar(frame) >= similarity, ["a", "b"]]

    roots, links = link_groups(members, describe, lambda pairs: pairs.mapInPandas(compare, "a bigint, b bigint"),
                               similarity, WORDS)
    degree = links.select(F.col("a").alias("node")).unionAll(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.select("sha", "node").join(roots, "node", "left").join(degree, "node", "left") \
        .select("sha", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    answered = checkpointed(signed.select("doc_id", "sha").join(placed, "sha"), "placed")
    classes = answered.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return answered.join(classes, "root").select(
        "doc_id", "class_id", "class_size", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row of ``docs`` with the smallest id of each class, columns as they were.

    Rows that repeat that id all stay.
    """
    name = fresh(docs, "kept_id")
    kept = find_groups(docs, id, text, **options).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, quoted([id])[0].eqNullSafe(F.col(name)), "left_semi")
