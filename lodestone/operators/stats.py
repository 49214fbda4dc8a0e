"""Counts over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def corpus_stats(chunks: DataFrame, *kinds: str, content: str = "content") -> DataFrame:
    """Chunks, characters and tokens in total and by each of ``kinds``, in one pass.

    Result: ``kind`` (a column name, or ``total``), ``value``, ``n_chunks``,
    ``n_chars``, ``n_tokens`` (a quarter of the characters).
    """
    counted = chunks.groupBy(*kinds).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(content)).alias("c"))
    # the counted rows are as few as the value combinations
    entries = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")),
        *[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("value"))
          for k in kinds])
    return (
        counted.select(F.inline(entries), "n", "c").groupBy("kind", "value")
        .agg(F.sum("n").alias("n_chunks"), F.sum("c").alias("n_chars"))
        .withColumn("n_tokens", F.floor(F.col("n_chars") / 4).cast("bigint"))
    )


def top_values(chunks: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; equal counts by value."""
    return chunks.groupBy(column).agg(F.count(F.lit(1)).alias("n_chunks")) \
        .orderBy(F.desc("n_chunks"), column).limit(n)


def chunks_per(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))


def versions_across(**tables: DataFrame) -> DataFrame:
    """Chunks per version and table, joined on the version.

    Each table is counted first, so the join has one row per version on either side
    instead of every pair of chunks.
    """
    joined = None
    for name, df in tables.items():
        counts = df.groupBy("spark_version").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        joined = counts if joined is None else joined.join(counts, "spark_version")
    return joined


def threads_to_code(qa: DataFrame, code: DataFrame) -> DataFrame:
    """Pairs of thread and code name where the thread mentions the name as an API.

    The mentions are exploded and joined by equality. Names are counted first, so a
    name that many units share is one row of the join.
    """
    names = code.groupBy(F.col("qualified_name").alias("api")).agg(F.count(F.lit(1)).alias("n_units"))
    mentions = (
        qa.select("question_id", "score", F.explode(F.array_distinct("spark_apis_mentioned")).alias("api"))
        .groupBy("question_id", "score", "api").agg(F.count(F.lit(1)).alias("n_messages"))
    )
    return mentions.join(names, "api")
