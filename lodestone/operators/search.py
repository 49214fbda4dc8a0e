"""Cosine top-k of many queries over a table of vectors.

Scores are computed in blocks inside tasks and only the best k per query and source
leave a task, so pairs are never rows. Few queries go to the corpus, as a broadcast
of checked size, and the corpus is read once without a shuffle. Beyond that bound
both sides are cut into blocks that meet by equi-join keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from .vectors import checked_dimension

# similarities are rounded to this many digits before ranking, ties go by id
DIGITS = 6
# size bounds of what one task holds: queries sent to all, a block, a cell
BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 32 << 20
CELL_BYTES = 256 << 20
_TILE_QUERIES = 1024
# rows that a tile meets first, rows it meets at once, and pairs scored at once in double precision
_FIRST, _STRIP, _PAIRS = 4096, 512, 1 << 16
# directions that queries and rows are ordered by, and the queries and rounds they are learned from
_PIVOTS, _PIVOT_SAMPLE, _PIVOT_ROUNDS = 16, 2048, 4
TASKS_PER_CORE = 4
# best hits that all tasks may hand on when each has all queries, and pairs that make a group of its own worthwhile
BROADCAST_HITS = 1 << 22
_GROUP_PAIRS = 1 << 24
_SIM = "sim"


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.astype(np.float64).reshape(-1, dim))


def _plain(column) -> np.ndarray:
    """Arrow values as a NumPy array that sorts like Spark does."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


_SCALE = 10 ** DIGITS
_NONE = np.int64(-2 * _SCALE)


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k highest scores per row, earlier columns first among equals."""
    n, width = scores.shape
    if width <= k:
        return np.broadcast_to(np.arange(width), scores.shape)
    return np.argpartition(np.arange(width) - scores * width, k - 1, axis=1)[:, :k]


def _first(scores: np.ndarray, rank: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which hits are among the k best of their row, by score, then rank; and their places there."""
    order = np.lexsort((rank, rows * (4 * _SCALE) - scores))
    row = rows[order]
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
    keep = place < k
    return order[keep], place[keep]


class _Best:
    """The best k hits of each query for one source, over the rows seen so far.

    Hits wait until there are about k for every second query of a tile and are merged then.
    ``floor`` is a score that a query's hit must reach to count among its best.
    """

    def __init__(self, n_queries: int, k: int, id_type: np.dtype):
        self.k = k
        self.scores = np.full((n_queries, k), _NONE, np.int32)
        self.ids = np.zeros((n_queries, k), id_type)
        self.floor = np.full(n_queries, _NONE)
        self.waiting: dict[int, list] = {}

    def add(self, tile: int, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take hits of queries of one tile: a query's row, a score and an id each."""
        parts = self.waiting.setdefault(tile, [])
        parts.append((rows, scores, ids))
        if 2 * sum(len(p[0]) for p in parts) >= self.k * min(_TILE_QUERIES, len(self.floor)):
            self._merge(tile)

    def _merge(self, tile: int) -> None:
        rows, scores, ids = (np.concatenate(x) for x in zip(*self.waiting.pop(tile)))
        if ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        start, k = tile * _TILE_QUERIES, self.k
        own = slice(start, start + _TILE_QUERIES)
        n = len(self.floor[own])
        rows = (rows - start).astype(np.int16)
        counts = np.bincount(rows, minlength=n)
        if counts.max() > 8 * k:  # a few queries have most of the hits
            keep, _ = _first(scores.astype(np.int64), ids, rows.astype(np.int64), k)
            rows, scores, ids = rows[keep], scores[keep], ids[keep]
            counts = np.bincount(rows, minlength=n)
        order = np.argsort(rows, kind="stable")
        rows, scores, ids = rows[order], scores[order], ids[order]
        # a line for each query: its best so far, then its new hits
        place = k + np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
        lines = np.full((n, k + counts.max()), _NONE, np.int32)
        names = np.zeros(lines.shape, self.ids.dtype)
        lines[:, :k], names[:, :k] = self.scores[own], self.ids[own]
        lines[rows, place], names[rows, place] = scores, ids
        floor = np.partition(lines, lines.shape[1] - k, axis=1)[:, lines.shape[1] - k]
        keep = lines > floor[:, None]
        equal = (lines == floor[:, None]) & (floor > _NONE)[:, None]
        free = k - keep.sum(axis=1)
        tied = np.flatnonzero(equal.sum(axis=1) > free)
        if len(tied):  # those of the smallest ids
            at, col = np.nonzero(equal[tied])
            order = np.lexsort((names[tied[at], col], at))
            at, col = at[order], col[order]
            late = np.arange(len(at)) - np.searchsorted(at, np.arange(len(tied)))[at] >= free[tied[at]]
            equal[tied[at[late]], col[late]] = False
        at, col = np.nonzero(keep | equal)
        place = np.arange(len(at)) - np.searchsorted(at, np.arange(n))[at]
        self.scores[own] = _NONE
        self.scores[start + at, place], self.ids[start + at, place] = lines[at, col], names[at, col]
        self.floor[own] = floor

    def flush(self) -> None:
        for tile in list(self.waiting):
            self._merge(tile)


def _pivots(matrix: np.ndarray) -> np.ndarray:
    """A few unit vectors near which the rows of a matrix lie: none for few rows. They decide what is cheap, never what is found."""
    held = matrix[np.linspace(0, len(matrix) - 1, min(len(matrix), _PIVOT_SAMPLE)).astype(int)] if len(matrix) else matrix
    held = held[np.isfinite(held).all(axis=1)]
    if len(held) < 8 * _PIVOTS:
        return np.zeros((0, matrix.shape[1]))
    at = held[np.linspace(0, len(held) - 1, _PIVOTS).astype(int)]
    for _ in range(_PIVOT_ROUNDS):
        near = (held @ at.T).argmax(axis=1)
        at = _unit(np.stack([held[near == j].sum(axis=0) if (near == j).any() else at[j] for j in range(len(at))]))
    return at


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1, 1))


@dataclass
class _Tile:
    """Some queries: their places, vectors in single precision and angles to the pivots."""
    rows: np.ndarray
    rough: np.ndarray
    angles: np.ndarray

    @property
    def number(self) -> int:
        return int(self.rows[0]) // _TILE_QUERIES


@dataclass
class _Strip:
    """Some corpus rows in the order of their ids, and between which angles to a pivot they lie."""
    names: np.ndarray
    exact: np.ndarray
    rough: np.ndarray
    pivot: int = -1
    low: float = 0.0
    high: float = 0.0

    @staticmethod
    def joined(strips: list[_Strip]) -> _Strip:
        names = np.concatenate([s.names for s in strips])
        order = np.argsort(names, kind="stable")
        return _Strip(names[order], np.concatenate([s.exact for s in strips])[order],
                      np.concatenate([s.rough for s in strips])[order])

    def highest(self, angles: np.ndarray) -> np.ndarray | float:
        """What the similarity of a query, by its angles to the pivots, and any of the rows can't exceed."""
        if self.pivot < 0:
            return 1.0
        to = angles[..., self.pivot]
        return np.cos(np.maximum(np.maximum(to - self.high, self.low - to), 0))


class _Scorer:
    """Scores batches of corpus rows against a fixed block of queries.

    Queries and rows are ordered by their angles to a few pivots. Rows that by the triangle
    inequality can't reach the ``floor`` of any query of a tile are passed over. The others are looked at
    in single precision: pairs that can't reach the query's ``floor``, by a bound on that
    precision's error, are left out; the rest are scored in double precision.
    """

    def __init__(self, ids, matrix: np.ndarray, limits, k: int, not_self: bool):
        self.pivots = _pivots(matrix)
        angles = _angles(matrix, self.pivots)
        if len(self.pivots):
            near = angles.argmin(axis=1)
            order = np.lexsort((angles.min(axis=1), near))
            ids, matrix, angles = ids[order], matrix[order], angles[order]
            limits = None if limits is None else [limits[i] for i in order]
        self.ids, self.matrix, self.limits, self.angles = ids, matrix, limits, angles
        self.rough = matrix.astype(np.float32)
        # products of unit vectors: the sums' error is below n + 2 roundings of 2**-24, here doubled
        self.slack = (matrix.shape[1] + 4) * 2.0 ** -23
        self.k, self.not_self = k, not_self
        self.scored = 0  # pairs scored in double precision
        self.looked = 0  # pairs looked at in single precision
        self.best: dict = {}
        self.allowed: dict = {}

    def _tiles(self, limit) -> list[_Tile]:
        """The queries that allow a limit, in tiles."""
        if limit is None or self.limits is None:
            limit = None
        if limit not in self.allowed:
            rows = np.arange(len(self.ids)) if limit is None else \
                np.flatnonzero([q is None or q == limit for q in self.limits])
            tiles = rows // _TILE_QUERIES
            parts = [rows[tiles == t] for t in np.unique(tiles)]
            self.allowed[limit] = [_Tile(part, self.rough[part], self.angles[part]) for part in parts]
        return self.allowed[limit]

    def _strips(self, names: np.ndarray, vectors: np.ndarray) -> list[_Strip]:
        """Rows that come in the order of their ids, cut by the nearest pivot and the angle to it."""
        rough = vectors.astype(np.float32)
        good = ~np.isnan(rough).any(axis=1)
        if not good.all():
            names, vectors, rough = names[good], vectors[good], rough[good]
        if len(names) == 0:
            return []
        if not len(self.pivots):
            return [_Strip(names[i:i + _STRIP], vectors[i:i + _STRIP], rough[i:i + _STRIP])
                    for i in range(0, len(names), _STRIP)]
        angles = _angles(vectors, self.pivots)
        near = angles.argmin(axis=1)
        angle = angles[np.arange(len(near)), near]
        order = np.lexsort((angle, near))
        bounds = np.searchsorted(near[order], np.arange(len(self.pivots) + 1))
        out = []
        for pivot, (first, last) in enumerate(zip(bounds, bounds[1:])):
            pieces = max(1, -(-(last - first) // _STRIP)) if last > first else 0
            for part in np.array_split(order[first:last], pieces) if pieces else []:
                low, high = angle[part[0]], angle[part[-1]]
                part = np.sort(part)
                out.append(_Strip(names[part], vectors[part], rough[part], pivot, low - 1e-6, high + 1e-6))
        return out

    def add(self, ids: np.ndarray, vectors: np.ndarray, groups: list, limits: list) -> None:
        """``groups``: source values per row; ``limits``: the value a query must allow."""
        order = np.argsort(ids, kind="stable")
        cells: dict = {}
        if groups.count(groups[0]) == len(ids) == limits.count(limits[0]):
            cells[groups[0], limits[0]] = order
        else:
            for i in order:
                cells.setdefault((groups[i], limits[i]), []).append(i)
        for (group, limit), rows in cells.items():
            tiles = self._tiles(limit)
            if not tiles:
                continue
            best = self.best.setdefault(group, _Best(len(self.ids), self.k, ids.dtype))
            strips = self._strips(ids[rows], vectors[rows])
            for tile in tiles:
                # the nearest first: floors rise before most rows are looked at
                middle = tile.angles.mean(axis=0)
                left = sorted(strips, key=lambda s: -s.highest(middle))
                if best.floor[tile.rows[0]] == _NONE:
                    sizes = np.cumsum([len(s.names) for s in left])
                    n = np.searchsorted(sizes, _FIRST) + 1
                    left = [_Strip.joined(left[:n]), *left[n:]] if left else left
                for strip in left:
                    self._strip(best, tile, strip)

    def _strip(self, best: _Best, tile: _Tile, strip: _Strip) -> None:
        """Score some corpus rows against a tile of queries."""
        least = (best.floor[tile.rows] - 0.5) / _SCALE - self.slack - 1e-6
        queries, rough = tile.rows, tile.rough
        if strip.pivot >= 0:
            may = np.flatnonzero(strip.highest(tile.angles) + 1e-6 >= least)
            if len(may) == 0:
                return
            if len(may) < 0.8 * len(queries):
                queries, rough, least = queries[may], rough[may], least[may]
        pairs = rough @ strip.rough.T
        self.looked += pairs.size
        least = least.astype(np.float32) - np.float32(1e-6)
        some = np.flatnonzero(pairs.max(axis=1) >= least)
        if len(some) == 0:
            return
        names, k = strip.names, self.k
        rows = pairs[some]
        near = rows >= least[some][:, None]
        many = np.count_nonzero(near)
        last = len(names) - k - 1  # one more than the best k, as a query's own row may be among them
        if many > 2 * k * len(some) and last > 0:
            # rows that are not among the strip's best by more than both roundings can't be among its best
            reached = np.partition(rows, last, axis=1)[:, last] - np.float32(2 * self.slack + 4e-6)
            near = rows >= np.maximum(least[some], reached)[:, None]
            many = np.count_nonzero(near)
        dense = 4 * many > pairs.size
        self.scored += pairs.size if dense else many
        if dense:
            scores = np.rint(self.matrix[queries] @ strip.exact.T * _SCALE).astype(np.int64)
            if self.not_self:
                scores[self.ids[queries][:, None] == names[None, :]] = _NONE
            col = _top(scores, k)
            scores = np.take_along_axis(scores, col, 1)
            at, place = np.nonzero(scores > _NONE)
            best.add(tile.number, queries[at], scores[at, place], names[col[at, place]])
            return
        at, col = np.divmod(np.flatnonzero(near), len(names))
        at = some[at]
        if self.not_self:
            other = self.ids[queries[at]] != names[col]
            at, col = at[other], col[other]
        scores = np.empty(len(at), np.int64)
        for low in range(0, len(at), _PAIRS):
            part = slice(low, low + _PAIRS)
            exact = np.einsum("ij,ij->i", self.matrix[queries[at[part]]], strip.exact[col[part]])
            scores[part] = np.rint(exact * _SCALE).astype(np.int64)
        good = scores >= best.floor[queries[at]]
        at, col, scores = at[good], col[good], scores[good]
        if len(at) > k * len(queries):
            keep, _ = _first(scores, col, at, k)
            at, col, scores = at[keep], col[keep], scores[keep]
        if len(at):
            best.add(tile.number, queries[at], scores, names[col])

    def hits(self):
        """(source values, query ids, corpus ids, similarities) per source."""
        for group, best in self.best.items():
            best.flush()
            at, col = np.nonzero(best.scores > _NONE)
            yield group, self.ids[at], best.ids[at, col], best.scores[at, col] / _SCALE


def _columns(table, by, limit):
    groups = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * table.num_rows
    limits = table.column(limit).to_pylist() if limit else [None] * table.num_rows
    return groups, limits


def _emit(scorer: _Scorer, schema: pa.Schema, query_id: str, by, corpus_id: str):
    for group, qids, cids, sims in scorer.hits():
        arrays = {query_id: pa.array(qids.tolist(), schema.field(query_id).type),
                  corpus_id: pa.array(cids.tolist(), schema.field(corpus_id).type),
                  _SIM: pa.array(sims, pa.float64())}
        for name, value in zip(by, group):
            arrays[name] = pa.array([value] * len(qids), schema.field(name).type)
        yield [arrays[f.name] for f in schema]


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
          corpus_id: str = "chunk_id", vector: str = "vec", by: Sequence[str] = (),
          limit: tuple[str, str] | None = None, not_self: bool = False,
          dim: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The k most similar corpus rows per query and per value of ``by``.

    Result: ``query_id``, ``by``, ``corpus_id``, ``sim``, ``rank``. ``limit`` names a
    query column and a corpus column; a pair counts only if they are equal or one of
    them is null. ``not_self`` leaves out the pair of equal ids. Null vectors are left
    out; one of another dimension than ``dim`` on either side fails the query. If ``dim``
    is not given, it is that of the first query vector, other queries fail, and corpus
    rows of another one are left out: ``vectors.wrong_dimension`` has them.
    """
    limit_q, limit_c = limit if limit else (None, None)
    wanted = queries.where(F.col(vector).isNotNull()).select(
        query_id, vector, *([limit_q] if limit else []))
    if dim is None:
        first = wanted.select(F.size(vector)).first()
        dim = first[0] if first else 0
        held = corpus.where(F.size(vector) == dim)
    else:
        held = checked_dimension(corpus.where(F.col(vector).isNotNull()), dim, vector)
    wanted = checked_dimension(wanted, dim, vector)
    rows = held.select(
        corpus_id, vector, *by, *([limit_c] if limit and limit_c not in by else []))
    out = T.StructType([wanted.schema[query_id], *[rows.schema[c] for c in by],
                        rows.schema[corpus_id], T.StructField(_SIM, T.DoubleType())])
    # the size check: at most this many queries are brought to every task, which hands on its best k of each
    tasks = TASKS_PER_CORE * corpus.sparkSession.sparkContext.defaultParallelism
    most = min(broadcast_bytes // (8 * max(dim, 1)), BROADCAST_HITS // max(k * tasks, 1))
    if queries.count() <= most:
        hits = _by_broadcast(wanted.toArrow(), rows, k, query_id, corpus_id, vector, list(by), limit_q, limit_c,
                             not_self, dim, out)
    else:
        hits = blocked_top_k(wanted, rows, [], k, query_id, corpus_id, vector, list(by), limit_q,
                             limit_c, not_self, dim, out)
    return ranked(hits, k, [query_id, *by], corpus_id)


def ranked(hits: DataFrame, k: int, group: Sequence[str], corpus_id: str) -> DataFrame:
    """The best k hits of each group; the rank limit is applied before the shuffle too."""
    window = W.partitionBy(*group).orderBy(F.desc(_SIM), corpus_id)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _by_broadcast(few: pa.Table, rows, k, query_id, corpus_id, vector, by, limit_q, limit_c,
                  not_self, dim, out):
    shared = rows.sparkSession.sparkContext.broadcast((
        _plain(few.column(query_id)), _matrix(few.column(vector), dim),
        few.column(limit_q).to_pylist() if limit_q else None))
    schema = _arrow_schema(out)

    def score(batches):
        ids, matrix, limits = shared.value
        scorer = _Scorer(ids, matrix, limits, k, not_self)
        for batch in batches:
            if batch.num_rows:
                groups, allowed = _columns(batch, by, limit_c)
                scorer.add(_plain(batch.column(corpus_id)), _matrix(batch.column(vector), dim),
                           groups, allowed)
        for arrays in _emit(scorer, schema, query_id, by, corpus_id):
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    # every task hands on its own best: read in a bounded number of tasks, however many
    # splits the corpus has, so that what is left to merge does not grow with it
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(tasks).mapInArrow(score, out)


def _layout(n_queries: int, n_rows: int, k: int, tasks: int, block_queries: int, cell_rows: int) -> tuple[int, int]:
    """Numbers of blocks and cells: within their sizes, and enough groups for the tasks.

    A row is sent to every block and a query's best are handed on by every cell, so of
    the numbers that give enough groups those that make the fewest of both are taken.
    """
    blocks, cells = max(1, -(-n_queries // block_queries)), max(1, -(-n_rows // cell_rows))
    tasks = min(tasks, -(-n_queries * n_rows // _GROUP_PAIRS))
    if tasks > blocks * cells:
        best = round((tasks * n_queries * k / n_rows) ** 0.5)
        blocks = max(blocks, min(best, n_queries, -(-tasks // cells)))
        cells = max(cells, -(-tasks // blocks))
    return blocks, cells


def _labels(spark, n: int) -> list[int]:
    """A number for each of n groups, so that hashing them into n partitions leaves none without a group."""
    place = F.pmod(F.hash("id"), F.lit(n))
    found = spark.range(n * (10 + n.bit_length())).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()
    labels = [r["id"] for r in found]
    return labels + [-1 - i for i in range(n - len(labels))]


def blocked_top_k(queries: DataFrame, corpus: DataFrame, keys: list[str], k: int, query_id: str,
                  corpus_id: str, vector: str, by: list[str], limit_q: str | None,
                  limit_c: str | None, not_self: bool, dim: int, out: T.StructType,
                  block_queries: int | None = None, cell_rows: int | None = None) -> DataFrame:
    """Best k per query among corpus rows with the same ``keys``, block by block.

    Each key's queries are cut into blocks and its corpus rows into cells of bounded
    size, however many rows share the key; each block meets each cell in one group.
    Without keys every query meets every row. There must be few distinct keys: their
    sizes are broadcast.
    """
    block_queries = block_queries or max(1, BLOCK_BYTES // (8 * dim))
    cell_rows = cell_rows or max(1, CELL_BYTES // (8 * dim))

    def parts(n, size: int):
        return F.ceil(n / size).cast("int")

    def counted(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(parts(F.count(F.lit(1)), size).alias(name))

    def sized(df: DataFrame) -> DataFrame:
        if keys:
            return df.join(sizes, keys)
        return df.withColumns({"_blocks": F.lit(blocks), "_cells": F.lit(cells)})

    if keys:
        sizes = F.broadcast(counted(queries, block_queries, "_blocks")
                            .join(counted(corpus, cell_rows, "_cells"), keys))
    else:
        spark = corpus.sparkSession
        blocks, cells = _layout(queries.count(), corpus.count(), k, TASKS_PER_CORE * spark.sparkContext.defaultParallelism,
                                block_queries, cell_rows)

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(column: str, n: str):
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    q = sized(queries).withColumn("_block", one(query_id, "_blocks")) \
        .withColumn("_cell", every("_cells")).drop("_blocks", "_cells")
    c = sized(corpus).withColumn("_cell", one(corpus_id, "_cells")) \
        .withColumn("_block", every("_blocks")).drop("_blocks", "_cells")
    schema = _arrow_schema(out)
    group = [*keys, "_block", "_cell"]
    if not keys:
        # groups are few and large: each gets a task of its own
        labels, group = F.array(*map(F.lit, _labels(spark, blocks * cells))), ["_group"]
        number = F.col("_block") * cells + F.col("_cell") + 1
        q, c = (df.withColumn("_group", F.element_at(labels, number).cast("bigint")).repartition(blocks * cells, "_group")
                for df in (q, c))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        scorer = _Scorer(_plain(left.column(query_id)), _matrix(left.column(vector), dim),
                         left.column(limit_q).to_pylist() if limit_q else None, k, not_self)
        if left.num_rows:
            for batch in right.to_batches(max_chunksize=8192):
                groups, allowed = _columns(batch, by, limit_c)
                scorer.add(_plain(batch.column(corpus_id)), _matrix(batch.column(vector), dim),
                           groups, allowed)
        return pa.Table.from_batches(
            [pa.RecordBatch.from_arrays(a, schema=schema)
             for a in _emit(scorer, schema, query_id, by, corpus_id)], schema)

    return q.groupBy(*group).cogroup(c.groupBy(*group)).applyInArrow(score, out)


def hyperplane_keys(df: DataFrame, vector: str, dim: int, tables: int, bits: int,
                    seed: int, beside: bool = False) -> DataFrame:
    """One row per hash table: ``_table`` and ``_bucket``, the signs of random projections.

    With ``beside``, also a row for each bucket that differs in one sign.
    """
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
    schema = T.StructType([*df.schema.fields, T.StructField("_table", T.IntegerType()),
                           T.StructField("_bucket", T.IntegerType())])
    arrow = _arrow_schema(schema)
    powers = (1 << np.arange(bits)).astype(np.int64)

    def sign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = (_matrix(batch.column(vector), dim) @ planes > 0).reshape(-1, tables, bits)
            buckets = (signs * powers).sum(axis=2)
            for t, flip in product(range(tables), [0, *powers.tolist()] if beside else [0]):
                extra = [pa.array(np.full(batch.num_rows, t), pa.int32()),
                         pa.array(buckets[:, t] ^ flip, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=arrow)

    return df.mapInArrow(sign, schema)


def approximate_top_k(queries: DataFrame, corpus: DataFrame, k: int, *, query_id: str = "query_id",
                      corpus_id: str = "chunk_id", vector: str = "vec", by: Sequence[str] = (),
                      dim: int, tables: int = 8, bits: int = 6, seed: int = 7) -> DataFrame:
    """Top k among the corpus rows that share a sign bucket with the query, but for one sign.

    More tables find more neighbours, more bits compare fewer rows. A bucket of any
    size is scored whole, in cells. Vectors are left out or fail the query as in ``top_k``.
    """
    held, asked = (checked_dimension(df.where(F.col(vector).isNotNull()), dim, vector) for df in (corpus, queries))
    q = hyperplane_keys(asked.select(query_id, vector), vector, dim, tables, bits, seed, beside=True)
    rows = held.select(corpus_id, vector, *by)
    c = hyperplane_keys(rows, vector, dim, tables, bits, seed)
    out = T.StructType([q.schema[query_id], *[rows.schema[x] for x in by],
                        rows.schema[corpus_id], T.StructField(_SIM, T.DoubleType())])
    hits = blocked_top_k(q, c, ["_table", "_bucket"], k, query_id, corpus_id, vector, list(by),
                         None, None, False, dim, out)
    # the same pair may meet in several tables
    return ranked(hits.distinct(), k, [query_id, *by], corpus_id)
