"""Vector columns beside the chunks: one partition per model, content never rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.embed import Model


def embed(df: DataFrame, text: str, model: Model, column: str = "vec") -> DataFrame:
    """Vectors of a text column."""
    return df.withColumn(column, model.embed(F.col(text)))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, model: Model) -> DataFrame:
    """Chunks that have no vector of this model yet."""
    done = vectors.where((F.col("model_column") == model.column) & F.col("vec").isNotNull())
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def fill_vectors(chunks: DataFrame, vectors: DataFrame, model: Model,
                 text: str = "content") -> DataFrame:
    """The rows to append to the vector table; none when all chunks have vectors.

    Equal chunk ids have equal content, so each id is embedded once.
    """
    todo = missing_vectors(chunks.select("chunk_id", text), vectors, model)
    once = todo.groupBy("chunk_id").agg(F.any_value(text).alias(text))
    return embed(once, text, model).select("chunk_id", "vec", F.lit(model.column).alias("model_column"))


def merge_vectors(chunks: DataFrame, vectors: DataFrame, model: Model) -> DataFrame:
    """Chunks with the model's vectors as a column of its name, null where missing."""
    own = vectors.where(F.col("model_column") == model.column) \
        .select("chunk_id", F.col("vec").alias(model.column))
    return chunks.join(own, "chunk_id", "left")


def is_wrong(vector: str, dim: int) -> Column:
    """Whether a vector is missing or has another dimension."""
    return F.coalesce(F.size(vector) != dim, F.lit(True))


def wrong_dimension(vectors: DataFrame, dim: int, vector: str = "vec") -> DataFrame:
    """The rows to reject."""
    return vectors.where(is_wrong(vector, dim))


def checked_dimension(vectors: DataFrame, dim: int, vector: str = "vec") -> DataFrame:
    """The same rows; reading one without a vector of this dimension fails the query."""
    found = F.coalesce(F.size(vector).cast("string"), F.lit("none"))
    wrong = F.raise_error(F.concat(F.lit(f"vector of dimension other than {dim}: "), found))
    return vectors.where(F.when(F.size(vector) == dim, True).otherwise(wrong.cast("boolean")))
