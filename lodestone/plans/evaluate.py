"""Retrieval quality over held-out queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.embed import Model
from ..operators.search import top_k
from ..session import checkpointed


def judged(hits: DataFrame, query_labels: DataFrame, corpus_labels: DataFrame) -> DataFrame:
    """Hits with ``relevant``: whether query and corpus row have the same label.

    ``hits``: query_id, chunk_id, rank. ``query_labels``: query_id, query_label.
    ``corpus_labels``: chunk_id, label.
    """
    return (hits.join(query_labels, "query_id").join(corpus_labels, "chunk_id")
            .withColumn("relevant", F.col("query_label") == F.col("label")))


def recall_at(hits: DataFrame, query_labels: DataFrame, corpus_labels: DataFrame,
              cuts=(10, 50), not_self: bool = False) -> DataFrame:
    """Per query, the share of all relevant rows within the first hits: ``recall_<k>``.

    With ``not_self`` the query is a row of the corpus that its search left out: it
    doesn't count as relevant, and a query without other relevant rows has no recall.
    """
    counted = F.nullif(F.count(F.lit(1)) - 1, F.lit(0)) if not_self else F.count(F.lit(1))
    sizes = corpus_labels.groupBy(F.col("label").alias("query_label")).agg(counted.alias("n_relevant"))
    found = judged(hits, query_labels, corpus_labels).groupBy("query_id").agg(*[
        F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("bigint")).alias(f"_{k}") for k in cuts])
    return (
        query_labels.join(sizes, "query_label").join(found, "query_id", "left")
        .select("query_id", "n_relevant", *[
            (F.coalesce(F.col(f"_{k}"), F.lit(0)) / F.col("n_relevant")).alias(f"recall_{k}") for k in cuts])
    )


def reciprocal_rank(hits: DataFrame, query_labels: DataFrame, corpus_labels: DataFrame) -> DataFrame:
    """Per query, one over the rank of the first relevant hit, 0 without one."""
    found = judged(hits, query_labels, corpus_labels).where("relevant").groupBy("query_id").agg(
        (F.lit(1.0) / F.min("rank")).alias("rr"))
    return query_labels.join(found, "query_id", "left").select(
        "query_id", F.coalesce("rr", F.lit(0.0)).alias("reciprocal_rank"))


def summary(recalls: DataFrame, ranks: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Means over all queries: one row, or one per group of ``groups`` (``query_id``, keys)."""
    names = [c for c in recalls.columns if c.startswith("recall_")]
    rows = recalls.join(ranks, "query_id")
    keys = []
    if groups is not None:
        rows = rows.join(groups, "query_id")
        keys = [c for c in groups.columns if c != "query_id"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.avg(c).alias(c) for c in names], F.avg("reciprocal_rank").alias("mrr"))


def compare_models(corpus: DataFrame, models: Sequence[Model], *, id: str, text: str, label: str, dataset: str,
                   folds: int = 10, cuts: Sequence[int] = (10, 50)) -> DataFrame:
    """Recall and MRR of each model on each data set, over held-out rows of the corpus.

    The rows whose id hashes into the first of ``folds`` folds are the queries. Each is
    searched among all rows but itself; those of its label are relevant. Every
    model embeds the corpus once.
    """
    held = F.conv(F.substring(F.md5(F.encode(F.col(id).cast("string"), "UTF-8")), 1, 8), 16, 10).cast("bigint") % folds == 0
    rows = corpus.select(F.col(id).alias("chunk_id"), F.col(text).alias("text"), F.col(label).alias("label"),
                         F.col(dataset).alias("dataset"), F.col(id).alias("query_id"), held.alias("held"))
    labels = rows.select("chunk_id", "label")
    asked = rows.where("held").select("query_id", F.col("label").alias("query_label"))
    groups = rows.where("held").select("query_id", "dataset")
    out = None
    for model in models:
        vectors = checkpointed(rows.select("chunk_id", "query_id", "held", model.embed(F.col("text")).alias("vec")), "vectors")
        hits = checkpointed(top_k(vectors.where("held").select("query_id", "vec"), vectors.select("chunk_id", "vec"),
                                  max(cuts), not_self=True, dim=model.dim), "hits")
        part = summary(recall_at(hits, asked, labels, cuts, not_self=True), reciprocal_rank(hits, asked, labels), groups)
        part = part.select(F.lit(model.name).alias("model"), *part.columns)
        out = part if out is None else out.unionByName(part)
    return out
