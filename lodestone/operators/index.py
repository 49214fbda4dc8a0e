"""A stored inverted-file index for approximate cosine search.

Centroids are fitted on a bounded sample; every vector is stored in the partition of its
nearest centroid, with a code of the signs of fixed random projections. A query reads only
the partitions of its nearest centroids. There the codes are compared first, bit by bit,
and only rows that agree in enough bits are scored. How many were is reported, and the
index never leaves out a row of a cell it reads for the size of the cell.

All choices are functions of ids and vectors (hashes order the sample, signs are digits
of hashes), so that an index built twice is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import checkpointed, overridden
from .search import DIGITS, _arrow_schema, _matrix, ranked
from .vectors import checked_dimension

#: vectors that centroids are fitted on, about: a share of all by hash, whole below the bound
SAMPLE_ROWS = 50_000
#: centroids are sent to all tasks, so they are few
MOST_CELLS = 4096
#: rows of a cell that one task scores at a time
SPLIT_ROWS = 200_000
SPLIT_QUERIES = 20_000
_WHOLE = float(1 << 20)
_SCALE = 10 ** DIGITS


def planes(dim: int, bits: int) -> np.ndarray:
    """Signs by the first digit of a hash of bit and dimension."""
    first = [[hashlib.md5(f"{b}/{i}".encode()).hexdigest()[0] < "8" for b in range(bits)] for i in range(dim)]
    return np.where(first, 1.0, -1.0)


def codes_of(unit: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sign bits of projections; entries are whole numbers first, so that sums are exact."""
    return np.packbits(np.rint(unit * _WHOLE) @ signs > 0, axis=1)


def nearest_cells(unit: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n most similar centroids of each row, by rounded similarity, then by number."""
    scores = np.rint(unit @ centroids.T * _SCALE).astype(np.int64) * len(centroids) - np.arange(len(centroids))
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _hash(id: str):
    return F.md5(F.encode(F.col(id).cast("string"), "UTF-8"))


def fit_centroids(vectors: DataFrame, id: str, vector: str, dim: int, cells: int, rounds: int = 2,
                  sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids by ``rounds`` of spherical k-means over a sample of about ``sample_rows``.

    The sample is a share of the rows by the hash of their id; its first rows by that hash
    are the seeds. A centroid without rows stays. The driver gets the seeds and the means.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"between 1 and {MOST_CELLS} cells, not {cells}")
    n = vectors.count()
    hashed = vectors.select(F.col(vector).alias("vec"), _hash(id).alias("hash"))
    if n > sample_rows:
        share = int(sample_rows / n * 0x1_0000_0000)
        hashed = hashed.where(F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint") < share)
    sample = checkpointed(hashed, "sample")
    seeds = sample.orderBy("hash", "vec").limit(cells).select("vec").toArrow()
    centroids = _matrix(seeds.column(0), dim) if seeds.num_rows else np.zeros((0, dim))
    spark = vectors.sparkSession
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    unit = _matrix(batch.column(0), dim)
                    cell = nearest_cells(unit, shared.value, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell, pa.int32()), pa.array(unit.tolist(), pa.list_(pa.float64()))], names=["cell", "unit"])

        means = sample.select("vec").mapInArrow(assign, "cell int, unit array<double>") \
            .select("cell", F.posexplode("unit").alias("i", "x")).groupBy("cell", "i").agg(F.avg("x").alias("m")).toArrow()
        moved = centroids.copy()
        moved[means["cell"].to_numpy(), means["i"].to_numpy()] = means["m"].to_numpy()
        centroids = _unit_rows(moved)
    return centroids


@dataclass(frozen=True)
class Index:
    """A stored index: rows by cell, centroids, and the widths they were made with."""
    spark: SparkSession
    path: str
    id: str
    dim: int
    bits: int
    # of the stored rows; read from the files if not given
    schema: T.StructType | None = None

    def centroids(self) -> np.ndarray:
        stored = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("cell").select("centroid").toArrow()
        return _matrix(stored.column(0), self.dim) if stored.num_rows else np.zeros((0, self.dim))

    def rows(self, cells: Sequence[int] | None = None) -> DataFrame:
        """The stored rows; with ``cells`` only their partitions are read."""
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        stored = reader.parquet(f"{self.path}/rows")
        return stored if cells is None else stored.where(F.col("cell").isin(list(cells)))


def build_index(corpus: DataFrame, path: str, *, id: str = "chunk_id", vector: str = "vec", by: Sequence[str] = (),
                dim: int, cells: int, bits: int = 256, rounds: int = 2, sample_rows: int = SAMPLE_ROWS) -> Index:
    """Write an index of all rows with a vector below ``path``; a wrong dimension fails.

    ``by`` are columns kept beside the vectors. Rows are gathered by cell before the
    write, and a cell too large for one task is split there.
    """
    spark = corpus.sparkSession
    held = checked_dimension(corpus.where(F.col(vector).isNotNull()), dim, vector).select(
        id, F.col(vector).alias("vec"), *by)
    centroids = fit_centroids(held, id, "vec", dim, cells, rounds, sample_rows)
    shared = spark.sparkContext.broadcast((centroids, planes(dim, bits)))
    schema = T.StructType([*held.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    arrow = _arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, signs = shared.value
        for batch in batches:
            if batch.num_rows:
                unit = _matrix(batch.column(1), dim)
                codes = codes_of(unit, signs)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(nearest_cells(unit, centroids, 1)[:, 0], pa.int32())], schema=arrow)

    with overridden(spark, "spark.sql.sources.partitionOverwriteMode", "static"):
        held.mapInArrow(place, schema).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>") \
        .coalesce(1).write.parquet(f"{path}/centroids")
    return Index(spark, path, id, dim, bits, schema)


def probe(index: Index, queries: DataFrame, k: int, *, query_id: str = "query_id", vector: str = "vec",
          by: Sequence[str] = (), probes: int, agree: int) -> DataFrame:
    """The k most similar found rows of each query and value of ``by``: as ``search.top_k``, and ``n_scored``.

    A query reads its ``probes`` nearest cells and scores the rows whose code agrees with its
    own in at least ``agree`` bits; ``n_scored`` says how many these were. With all
    cells and 0 bits the search is exact. Null vectors are left out, another dimension fails.
    """
    spark, dim, id = index.spark, index.dim, index.id
    asked = checked_dimension(queries.where(F.col(vector).isNotNull()), dim, vector).select(query_id, F.col(vector).alias("vec"))
    shared = spark.sparkContext.broadcast((index.centroids(), planes(dim, index.bits)))
    schema = T.StructType([*asked.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())])
    arrow = _arrow_schema(schema)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, signs = shared.value
        for batch in batches:
            if batch.num_rows and len(centroids):
                unit = _matrix(batch.column(1), dim)
                cells = nearest_cells(unit, centroids, probes)
                each = pa.array(np.repeat(np.arange(len(unit)), cells.shape[1]))
                codes = pa.array([c.tobytes() for c in codes_of(unit, signs)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(each) for c in batch.columns), codes.take(each),
                                                  pa.array(cells.reshape(-1), pa.int32())], schema=arrow)

    # a row for each query and cell; the cells are few, so their list prunes the partitions
    visits = checkpointed(asked.mapInArrow(spread, schema), "visits")
    cells = [r["cell"] for r in visits.select("cell").distinct().collect()]
    rows = index.rows(cells).select(id, "vec", *by, "code", "cell")
    # a cell of any size is scored whole: its rows in splits, its queries in parts
    sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count("*") / SPLIT_ROWS).cast("int").alias("splits")).join(
        visits.groupBy("cell").agg(F.ceil(F.count("*") / SPLIT_QUERIES).cast("int").alias("parts")), "cell"))

    def one(column: str, n: str):
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    keys = ["cell", "split", "part"]
    left = visits.join(sizes, "cell").withColumn("part", one(query_id, "parts")).withColumn("split", every("splits")).drop("splits", "parts")
    right = rows.join(sizes, "cell").withColumn("split", one(id, "splits")).withColumn("part", every("parts")).drop("splits", "parts")
    out = T.StructType([asked.schema[query_id], *[rows.schema[c] for c in by], rows.schema[id],
                        T.StructField("sim", T.DoubleType()), T.StructField("n_scored", T.LongType())])
    result = _arrow_schema(out)

    def score(some: pa.Table, cell: pa.Table) -> pa.Table:
        found = {name: [] for name in result.names}
        if some.num_rows and cell.num_rows:
            corpus, asking = _matrix(cell["vec"], dim), _matrix(some["vec"], dim)
            kept, wanted = (np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1) for t in (cell, some))
            ids = cell[id].to_pylist()
            places = np.argsort(np.argsort(np.array(ids, dtype=object if isinstance(ids[0], str) else None), kind="stable"))
            groups = list(zip(*[cell[c].to_pylist() for c in by])) if by else [()] * len(ids)
            names = sorted(set(groups), key=repr)
            members = {g: np.array([h == g for h in groups]) for g in names}
            for row, query in enumerate(some[query_id].to_pylist()):
                same = 8 * kept.shape[1] - np.bitwise_count(kept ^ wanted[row]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(same >= agree)
                sims = np.rint(corpus[near] @ asking[row] * _SCALE).astype(np.int64)
                for name, value in ((query_id, query), (id, None), ("sim", None), ("n_scored", len(near)), *((c, None) for c in by)):
                    found[name].append(value)
                for group in names:
                    held = members[group][near]
                    best = np.lexsort((places[near[held]], -sims[held]))[:k]
                    for at, sim in zip(near[held][best], sims[held][best]):
                        for name, value in ((query_id, query), (id, ids[at]), ("sim", sim / _SCALE), ("n_scored", 0), *zip(by, group)):
                            found[name].append(value)
        return pa.table({name: pa.array(values, result.field(name).type) for name, values in found.items()})

    hits = checkpointed(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out), "probed")
    totals = hits.where(F.col(id).isNull()).groupBy(query_id).agg(F.sum("n_scored").alias("n_scored"))
    best = ranked(hits.where(F.col(id).isNotNull()).drop("n_scored"), k, [query_id, *by], id)
    return best.join(totals, query_id)
