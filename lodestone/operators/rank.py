"""Re-ranking of hits and merging over sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.text import as_list


def source_weight(input_type: Column, source: Column, weights=None) -> Column:
    """Weight of a source for an input type; unknown pairs get the default."""
    found = F.lit(rules.DEFAULT_WEIGHT)
    for kind, by_source in (weights or rules.SOURCE_WEIGHTS).items():
        for name, weight in by_source.items():
            found = F.when((input_type == kind) & (source == name), weight).otherwise(found)
    return found


def rerank_score(sim: Column, input_type: Column, source: Column, request_apis: Column,
                 hit_apis: Column, votes: Column, accepted: Column, state: Column,
                 versions: Column, target: Column, weights=None) -> Column:
    """Similarity times source weight, plus the boosts that apply to the source."""
    overlap = F.size(F.array_intersect(as_list(request_apis), as_list(hit_apis)))
    mentioned = F.exists(as_list(versions), lambda v: F.contains(v, target)) & (target != "")

    def boost(test: Column, amount) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), amount).otherwise(0.0)

    score = sim * source_weight(input_type, source, weights)
    score = score + boost(source.isin("code", "qa") & (overlap > 0), F.lit(rules.API_BOOST) * overlap)
    score = score + boost((source == "qa") & (votes > rules.VOTES_OVER), rules.VOTES_BOOST)
    score = score + boost((source == "qa") & accepted, rules.ACCEPTED_BOOST)
    score = score + boost((source == "issues") & (state == "closed"), rules.CLOSED_BOOST)
    return score + boost(source.isin("qa", "issues") & mentioned, rules.VERSION_BOOST)


def source_position(source: Column, order: Sequence[str] = rules.SOURCE_ORDER) -> Column:
    position = F.lit(len(order))
    for i, name in enumerate(order):
        position = F.when(source == name, i).otherwise(position)
    return position


def merge_hits(hits: DataFrame, total: int = rules.TOP_TOTAL, key: str = "request_id",
               order: Sequence[str] = rules.SOURCE_ORDER) -> DataFrame:
    """The best ``total`` hits per request over all sources, as ``position`` 1, 2, ...

    Equal scores keep the order of the sources, then the rank within the source.
    """
    window = W.partitionBy(key).orderBy(F.desc("score"), source_position(F.col("source"), order), "rank")
    return hits.withColumn("position", F.row_number().over(window)).where(F.col("position") <= total)


def hits_by_source(hits: DataFrame, source: str) -> DataFrame:
    return hits.where(F.col("source") == source)


def version_allowed(version: str | None, source: Column, spark_version: Column) -> Column:
    """The version filter: exact for code and docs, none for threads and issues."""
    if not version or version == "all":
        return F.lit(True)
    return ~source.isin("code", "docs") | (spark_version == version)
