"""Hard negatives by a vertical scan with bounds (BOND).

Vectors stand in blocks, one array for each dimension. For an anchor, a block's
dimensions are read in the order of the anchor's magnitudes. After a few of them, the
block's minima and maxima bound what the rest can add to each row's inner product, and
rows that can't reach any result any more leave the candidates; the others' products are
exact at the end. A first scan finds each anchor's positives, a second the negatives
inside the windows that the positives' scores set.

Anchors and blocks meet in groups of bounded size, and each group sends only its best
rows for each anchor, so that no pair of rows is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import checkpointed, part_count, quoted

SCALE = 256
#: scaled components are held within this bound, so that products are exact
BOUND = 1 << 24
BLOCK_BYTES = 32 << 20
ANCHOR_BYTES = 16 << 20
#: dimensions read between two looks at the bounds
STRIDE = 8
MOST_PARTITIONS = 20_000
_EXACT = 1 << 53

BLOCKS = "block int, ids binary, labels binary, columns array<binary>"
FOUND = "no bigint, goal bigint, id bigint, score bigint"
_FOUND = pa.schema([(name, pa.int64()) for name in ("no", "goal", "id", "score")])


def taking_part(df: DataFrame, id: str, label: str, vector: str) -> DataFrame:
    """``id, label, x`` of the rows with all three and only finite components, each once."""
    key, group, content = quoted([id, label, vector])
    finite = F.forall(content, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(content, lambda c: F.floor(F.greatest(F.lit(float(-BOUND)), F.least(
        F.lit(float(BOUND)), F.lit(float(SCALE)) * c.cast("double")))).cast("int"))
    return df.where(key.isNotNull() & group.isNotNull() & F.coalesce((F.size(content) > 0) & finite, F.lit(False))) \
        .select(key.cast("bigint").alias("id"), group.cast("bigint").alias("label"), scaled.alias("x")).distinct()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stand(table: pa.Table) -> pa.Table:
    """The rows of a block as one array for each dimension."""
    columns = np.ascontiguousarray(_matrix(table["x"]).astype(np.int32).T)
    return pa.table({
        "block": pa.array([table["block"][0].as_py()], pa.int32()),
        "ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "labels": pa.array([table["label"].to_numpy().astype(np.int64).tobytes()], pa.binary()),
        "columns": pa.array([[c.tobytes() for c in columns]], pa.list_(pa.binary()))})


def vertical(rows: DataFrame, n: int, dim: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The rows in written blocks of about equal size, and their number: one for each core or more."""
    blocks = max(min(n, part_count(rows.sparkSession)), math.ceil(n * (4 * dim + 16) / block_bytes), 1)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "x"), F.lit(blocks)).cast("int"))
    return checkpointed(dealt.groupBy("block").applyInArrow(_stand, BLOCKS), "vertical"), blocks


class Block:
    """A block in memory, with what each dimension can contribute at least and at most."""

    def __init__(self, ids: bytes, labels: bytes, columns: list[bytes]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        whole = np.frombuffer(b"".join(columns), np.int32).reshape(len(columns), -1)
        self.low, self.high = whole.min(axis=1).astype(np.int64), whole.max(axis=1).astype(np.int64)
        self.most = int(max(-self.low.min(), self.high.max(), 0))
        self.whole = whole.astype(np.float64)

    def columns(self, query: np.ndarray) -> np.ndarray:
        """Doubles where all sums are exact in them, else longs."""
        safe = int(np.abs(query).max(initial=0)) * self.most * len(query) < _EXACT
        return self.whole if safe else self.whole.astype(np.int64)

    def scan(self, query: np.ndarray, rows: np.ndarray,
             needed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be needed, with their exact inner products.

        ``needed`` gets the least and greatest products that candidates can still reach and
        tells which of them stay.
        """
        columns = self.columns(query)
        order = np.argsort(-np.abs(query), kind="stable")
        ends = np.stack([query * self.low, query * self.high])[:, order]
        rest_low, rest_high = ([*np.cumsum(e[::-1])[::-1], 0] for e in (ends.min(axis=0), ends.max(axis=0)))
        sums = np.zeros(len(rows), columns.dtype)
        weights = query.astype(columns.dtype)
        for at in range(0, len(order), STRIDE):
            dims = order[at:at + STRIDE]
            # a gather costs more than it saves while most rows are candidates
            if 2 * len(rows) > columns.shape[1]:
                sums += (weights[dims] @ columns[dims])[rows]
            else:
                sums += weights[dims] @ columns[dims[:, None], rows]
            done = min(at + STRIDE, len(order))
            stay = needed(sums + rest_low[done], sums + rest_high[done])
            if not stay.all():
                rows, sums = rows[stay], sums[stay]
            if not len(rows):
                break
        return rows, sums.astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first k: higher scores first, then smaller ids."""
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[first]], scores[first]


def kth_largest(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def first_of(block: Block, anchor: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best k rows of the anchor's label, but for its own."""
    rows = np.flatnonzero((block.labels == anchor["label"]) & (block.ids != anchor["id"]))

    def needed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= kth_largest(low, k) if len(low) > k else np.ones(len(low), bool)

    yield 0, *block.best(*block.scan(anchor["x"], rows, needed), k)


def window(goal: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores ``s`` with ``low*goal <= 100*s <= high*goal``: first and last; none if the first is greater."""
    return -((-low * goal) // 100), (high * goal) // 100


def inside_of(block: Block, anchor: dict, k: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The best k rows of other labels inside each of the anchor's windows."""
    windows = [(goal, *window(goal, low, high)) for goal in anchor["goals"]]
    windows = [w for w in windows if w[1] <= w[2]]
    if not windows:
        return

    def needed(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(least), bool)
        for _, first, last in windows:
            # k rows that are surely inside set the score that others must reach
            sure = least[(least >= first) & (most <= last)]
            reach = max(first, kth_largest(sure, k)) if len(sure) >= k else first
            stay |= (most >= reach) & (least <= last)
        return stay

    rows = np.flatnonzero((block.labels != anchor["label"]) & (block.ids != anchor["id"]))
    rows, scores = block.scan(anchor["x"], rows, needed)
    for goal, first, last in windows:
        held = (scores >= first) & (scores <= last)
        yield goal, *block.best(rows[held], scores[held], k)


def meet(anchors: DataFrame, parts: int, blocks: DataFrame, count: int, find: Callable) -> DataFrame:
    """``find`` over every anchor and every block, a group of anchors and a block at a time."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = anchors.withColumn("block", every(count)), blocks.withColumn("part", every(parts))
    tasks = min(parts * count, MOST_PARTITIONS)

    def score(few: pa.Table, block: pa.Table) -> pa.Table:
        out: list = []
        if few.num_rows and block.num_rows:
            at = Block(*(block[c][0].as_py() for c in ("ids", "labels", "columns")))
            matrix = _matrix(few["x"]).astype(np.int64)
            goals = few["goals"].to_pylist() if "goals" in few.column_names else [None] * few.num_rows
            for no, id, label, x, goal in zip(*(few[c].to_pylist() for c in ("no", "id", "label")), matrix, goals):
                for g, ids, scores in find(at, {"id": id, "label": label, "x": x, "goals": goal}):
                    out.append(np.stack([np.full(len(ids), no), np.full(len(ids), g), ids, scores], axis=1))
        found = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in found.T], schema=_FOUND)

    keys = ["block", "part"]
    # by number: small groups of long work are not to be put together
    return left.repartition(tasks, *keys).groupBy(*keys).cogroup(right.repartition(tasks, *keys).groupBy(*keys)) \
        .applyInArrow(score, FOUND)


def mine(embeddings: DataFrame, anchor: Column, id: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become whole 256ths, rounded down, held within 2**24 of them. A score is the
    inner product with the anchor; higher scores come first, ties by smaller id. Anchors are
    the rows for which ``anchor`` is true (null: false). An anchor's positives are the first
    rows of its label, its negatives for a positive the first rows of other labels with a
    score from ``low`` to ``high`` percent of the positive's. All of them if there are fewer.

    Rows without an id or a label, and those whose vector is null or empty or holds a null or
    non-finite component, take no part. Rows that agree in id, label and vector count once;
    other rows with the anchor's id are neither its positives nor its negatives. Vectors
    of several dimensions fail. An empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = checkpointed(taking_part(embeddings, id, label, vector), "vectors")
    n, least, dim = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n and least != dim:
        raise ValueError(f"vectors of {least} to {dim} dimensions")
    chosen = taking_part(embeddings.where(F.coalesce(anchor, F.lit(False))), id, label, vector)
    anchors = checkpointed(chosen.withColumn("no", F.monotonically_increasing_id()), "anchors")
    blocks, count = vertical(rows, n, dim or 0, block_bytes)
    parts = max(1, math.ceil(anchors.count() * (8 * (dim or 0) + 64) / anchor_bytes))
    anchors = anchors.withColumn("part", F.pmod(F.xxhash64("no"), F.lit(parts)).cast("int"))

    def ranked(found: DataFrame, *group: str, k: int) -> DataFrame:
        order = W.partitionBy(*group).orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = meet(anchors, parts, blocks, count, lambda block, a: first_of(block, a, positives))
    best = checkpointed(ranked(first, "no", k=positives).select(
        "no", F.col("id").alias("positive_id"), F.col("score").alias("goal")), "positives")
    # at most as many scores as positives for each anchor
    goals = best.groupBy("no").agg(F.collect_set("goal").alias("goals"))
    inside = meet(anchors.join(goals, "no"), parts, blocks, count,
                  lambda block, a: inside_of(block, a, negatives, low, high))
    held = ranked(inside, "no", "goal", k=negatives)
    return best.join(held, ["no", "goal"]).join(anchors.select("no", F.col("id").alias("anchor_id")), "no").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))
