"""Chunk tables as served: one vector column, lists as JSON, bounded strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.embed import Model
from ..functions.patterns import pattern_names
from ..functions.text import wrap_list
from ..operators.vectors import checked_dimension
from .schemas import SERVED_COLUMNS, SERVED_LISTS


def model_registry(spark, models: list[Model], active: str) -> DataFrame:
    """``name``, ``model_column``, ``dim``, ``active`` of the configured models."""
    if active not in {m.column for m in models}:
        raise ValueError(f"active column {active} is not among the models")
    return spark.createDataFrame([(m.name, m.column, m.dim, m.column == active) for m in models],
                                 "name string, model_column string, dim int, active boolean")


def vectors_of(vectors: DataFrame, model_column: str, dim: int) -> DataFrame:
    """One model's vectors; fails if the model has none, or on a wrong dimension."""
    own = vectors.where(F.col("model_column") == model_column)
    if own.isEmpty():
        raise ValueError(f"no vectors in column {model_column}: embed first")
    return checked_dimension(own, dim)


def serving_export(table: str, chunks: DataFrame, vectors: DataFrame, model_column: str, dim: int,
                   version: str | None = None) -> DataFrame:
    """The rows to load: ``embedding`` and the served columns, no chunk id.

    Chunks without a vector are kept with a null embedding. Problems are served by
    their names.
    """
    if version:
        chunks = chunks.where(F.col("spark_version") == version)
    lists = SERVED_LISTS[table]

    def served(name: str, limit: int):
        column = F.col(name)
        if name == "problem_indicators":
            column = pattern_names(column)
        if lists.get(name):
            column = wrap_list(column, lists[name])
        elif name in lists:
            column = F.to_json(column)
        elif limit:
            column = F.left(column, F.lit(limit))
        return column.alias(name)

    own = vectors_of(vectors, model_column, dim).select("chunk_id", F.col("vec").alias("embedding"))
    return chunks.join(own, "chunk_id", "left").select(
        "embedding", *[served(n, limit) for n, limit in SERVED_COLUMNS[table].items()])
