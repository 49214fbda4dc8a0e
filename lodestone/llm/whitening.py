"""Embedding whitening: rows projected on the components of their covariance.

Three passes over the distinct quantised vectors give their sums, their centred second
moments and the check of the result; each task sends one partial sum for each dimension or
pair of dimensions. The driver sees only what has the size of a vector or of the
covariance. Its components come from spectral divide and conquer (``spectral``) and go to
all tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, quoted
from .spectral import EPS, components

MOST_COMPONENTS = 16
STEP = 64
#: whole steps are held within this bound; below it all sums and products here are exact
BOUND = 1 << 40
_LONGEST = 2.0 ** 63
SUMS = "i int, s decimal(38,0)"
MOMENTS = "i int, j int, v double"


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def steps(vector: Column) -> Column:
    """Entries as whole numbers of 1/64, rounded down. An offset common to all entries
    would leave every result as it is, so none is added."""
    bound = float(BOUND)
    return F.transform(vector, lambda c: F.floor(
        F.greatest(F.lit(-bound), F.least(F.lit(bound), F.lit(float(STEP)) * c.cast("double")))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each dimension; -1 has the number of vectors."""
    total, n = None, 0
    for batch in batches:
        if batch.num_rows:
            part = [int(v) for v in _matrix(batch.column(0)).sum(axis=0)]
            total = part if total is None else [a + b for a, b in zip(total, part)]
            n += batch.num_rows
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, len(total)), pa.int32()),
             pa.array([Decimal(v) for v in [n, *total]], pa.decimal128(38, 0))], names=["i", "s"])


def _products(centre: np.ndarray, along: np.ndarray | None) -> Callable:
    """Sums of products of the centred vectors, or of their projections; ``j`` = -1 has plain sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(0)) - centre
                rows = rows if along is None else rows @ along
                total, plain = total + rows.T @ rows, plain + rows.sum(axis=0)
        if np.ndim(total):
            i, j = np.triu_indices(len(total))
            single = np.arange(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([i, single]), pa.int32()),
                 pa.array(np.concatenate([j, np.full(len(single), -1)]), pa.int32()),
                 pa.array(np.concatenate([total[i, j], plain]), pa.float64())], names=["i", "j", "v"])
    return run


def _covariance(fit: DataFrame, n: int, centre: np.ndarray, along: np.ndarray | None = None) -> np.ndarray:
    """Covariance over the fit list, divisor n. The driver gets one row for each pair of dimensions."""
    sums = fit.mapInArrow(_products(centre, along), MOMENTS).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (sums[c].to_numpy() for c in ("i", "j", "v"))
    size = len(centre) if along is None else along.shape[1]
    second, mean = np.zeros((size, size)), np.zeros(size)
    mean[i[j < 0]] = v[j < 0] / n
    second[i[j >= 0], j[j >= 0]] = v[j >= 0] / n
    second = np.triu(second) + np.triu(second, 1).T
    # the rows were centred before; what is left of the mean is rounding
    return second - np.outer(mean, mean)


def _squares(x: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Sums over dimensions of ``(n*x - S)**2``; None beyond 64 bits."""
    most = float(n) * float(np.abs(x).max(initial=0)) + max([0.0, *(abs(float(s)) for s in sums)])
    if most * most * x.shape[1] < _LONGEST / 2:
        return list((((n * x - sums.astype(np.int64)) ** 2).sum(axis=1)).tolist())
    exact = [int(v) for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
    return [v if v < _LONGEST else None for v in exact]


def whiten(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding",
           most: int = MOST_COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component.

    Entries become whole 64ths, rounded down, held within 2**40 of them. The fit list has each
    distinct vector of these once; ``n`` is its length. Components are the unit eigenvectors
    of its covariance, numbered from 1 by falling eigenvalue, at most ``most``; their entry
    of largest magnitude is positive. ``whitened`` is the centred row projected on the
    component, over the root of the eigenvalue, ``explained`` the eigenvalue's share of the
    trace, ``deviation`` the row's sum of squared ``n*x - S``, exact, null beyond 64 bits.
    ``identity_error`` is the largest entry of whitened's covariance minus the identity.

    Rows whose vector is null or empty, or holds a null or non-finite entry, are left out;
    a table without other rows gives no rows. Repeated rows and a null id give rows like any
    other. A component without variance (an eigenvalue that is zero but for rounding, as
    with a single distinct vector) has ``whitened`` and ``explained`` 0 and does not count
    for ``identity_error``. Vectors of several dimensions fail. Other columns are not read.
    """
    spark = embeddings.sparkSession
    key, content = quoted([id, vector])
    rows = embeddings.where(usable(content)).select(key.alias("id"), steps(content).alias("x"))
    fit = checkpointed(rows.select("x").distinct(), "fit-list")
    kind = embeddings.schema[id].dataType
    schema = T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    dims = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if dims[0] is None:
        return spark.createDataFrame([], schema)
    if dims[0] != dims[1]:
        raise ValueError(f"vectors of {dims[0]} to {dims[1]} dimensions")

    found = {r["i"]: int(r["s"]) for r in fit.mapInArrow(_sums, SUMS).groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n, sums = found[-1], np.array([found[i] for i in range(dims[0])], object)
    centre = np.array([s / n for s in sums], float)
    covariance = _covariance(fit, n, centre)
    values, vectors = components(covariance)
    trace = float(np.trace(covariance))
    values, vectors = values[:most], vectors[:, :most]
    live = values > dims[0] * EPS * max(trace, 0.0)
    along = vectors * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0)
    shares = np.where(live, values, 0.0) / (trace if trace > 0 else 1.0)
    off = _covariance(fit, n, centre, along) - np.diag(live.astype(float))
    error = float(np.abs(off).max(initial=0.0))

    shared = spark.sparkContext.broadcast((centre, along, shares, sums))
    id_type, width = to_arrow_type(kind), len(values)
    fields = [pa.field("vec_id", id_type), *(pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields[1:])]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, along, shares, sums = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1))
                ids, m = part.column(0), len(x)
                each = pa.array(np.repeat(np.arange(m), width))
                yield pa.RecordBatch.from_arrays([
                    ids.take(each).cast(id_type),
                    pa.array(np.tile(np.arange(1, width + 1), m), pa.int32()),
                    pa.array(np.full(m * width, n), pa.int64()),
                    pa.array(_squares(x, n, sums), pa.int64()).take(each),
                    pa.array(((x - centre) @ along).reshape(-1), pa.float64()),
                    pa.array(np.tile(shares, m), pa.float64()),
                    pa.array(np.full(m * width, error), pa.float64())], schema=pa.schema(fields))

    return rows.mapInArrow(project, schema)
