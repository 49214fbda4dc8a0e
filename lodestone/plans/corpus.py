"""The chunk tables that a search runs over, one per source.

A search names the sources it wants. Only their tables are opened, and a table that the
catalog lacks is skipped, so that a source left out costs no scan. The ranking sees ids
and vectors, then the few facts that re-ranking needs; texts and each source's own columns
are fetched last, for the hits alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..functions.embed import Model
from ..functions.patterns import pattern_names
from ..session import checkpointed
from ..sources.schemas import SERVED_COLUMNS
from ..sources.tables import ChunkStore

#: distinct hits whose ids are sent to all tasks at most; more meet the tables in a shuffle
BROADCAST_HITS = 500_000

# The table of each source.
TABLE_OF = {"code": "code_chunks", "docs": "doc_chunks", "qa": "qa_chunks", "issues": "issue_chunks"}

# sources whose rows belong to one version
VERSIONED = ("code", "docs")

# what re-ranking reads, with its type, and the column that holds it in each source
_FACTS = {
    "apis": ("array<string>", {"code": "spark_apis", "qa": "spark_apis_mentioned"}),
    "votes": ("bigint", {"qa": "score"}),
    "accepted": ("boolean", {"qa": "is_accepted"}),
    "state": ("string", {"issues": "state"}),
    "versions": ("array<string>", {"qa": "spark_versions_mentioned", "issues": "spark_versions_mentioned"}),
}

# columns that name a hit's place, beside the JSON of all of its source's columns
PLACES = {"spark_version": "string", "file_path": "string", "doc_url": "string", "question_id": "bigint",
          "issue_number": "bigint"}


@dataclass(frozen=True)
class Source:
    """A source's chunk table, and its vectors (``chunk_id``, ``vec``) if they stand elsewhere."""
    chunks: DataFrame
    vectors: DataFrame | None = None

    def column(self, name: str | None, kind: str) -> Column:
        known = name is not None and name in self.chunks.columns
        return (F.col(name) if known else F.lit(None)).cast(kind)


Corpus = Mapping[str, Source | None]


def names_of(sources: Sequence[str] | None) -> list[str]:
    """The sources asked for in their fixed order, others after them; all of them if none is named."""
    wanted = list(sources or rules.SOURCE_ORDER)
    return [s for s in rules.SOURCE_ORDER if s in wanted] + [s for s in wanted if s not in rules.SOURCE_ORDER]


def chosen(corpus: Corpus, sources: Sequence[str] | None = None) -> dict[str, Source]:
    """The sources asked for that there are; an absent one is skipped with a warning."""
    found = {}
    for name in names_of(sources) if sources else list(corpus):
        if corpus.get(name) is None:
            warnings.warn(f"no chunk table for source {name}: skipped", stacklevel=3)
        else:
            found[name] = corpus[name]
    return found


def from_store(store: ChunkStore, model: Model, sources: Sequence[str] | None = None) -> dict[str, Source | None]:
    """The sources of a chunk store with one model's vectors; None where the catalog has no table.

    Of the vector table only the model's partition is read.
    """
    corpus: dict[str, Source | None] = {}
    for name in names_of(sources):
        table = TABLE_OF.get(name)
        if table is None or not store.exists(table):
            corpus[name] = None
            continue
        own = store.read("chunk_vectors", ["chunk_id", "vec"],
                         (F.col("model_column") == model.column) & (F.col("table_name") == table))
        corpus[name] = Source(store.read(table), own)
    return corpus


def _united(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def search_rows(corpus: dict[str, Source]) -> DataFrame | None:
    """``chunk_id, source, vec, only_version`` of all sources: what the ranking reads.

    A missing version equals none that is asked for, but passes where all are.
    """
    parts = []
    for name, source in corpus.items():
        version = F.coalesce(source.column("spark_version", "string"), F.lit("")) if name in VERSIONED \
            else F.lit(None).cast("string")
        rows = source.chunks
        if source.vectors is not None:
            rows = rows.select("chunk_id", version.alias("only_version")).join(source.vectors, "chunk_id") \
                if name in VERSIONED else source.vectors.withColumn("only_version", version)
        else:
            rows = rows.withColumn("only_version", version)
        parts.append(rows.select("chunk_id", F.lit(name).alias("source"), "vec", "only_version"))
    return _united(parts)


def _asked(hits: DataFrame, corpus: dict[str, Source]) -> dict[str, DataFrame]:
    """The distinct chunk ids of the hits by source, ready for a join with its table.

    They are written and counted; below a bound they are broadcast, so that the tables
    are scanned where they lie.
    """
    wanted = checkpointed(hits.select("source", "chunk_id").distinct(), "asked")
    sizes = {r["source"]: r["n"] for r in wanted.groupBy("source").agg(F.count("*").alias("n")).collect()}
    out = {}
    for name in corpus:
        own = wanted.where(F.col("source") == name).select("chunk_id")
        out[name] = F.broadcast(own) if sizes.get(name, 0) <= BROADCAST_HITS else own
    return out


def facts_of(hits: DataFrame, corpus: dict[str, Source]) -> DataFrame | None:
    """``source, chunk_id, apis, votes, accepted, state, versions`` of the hits."""
    asked = _asked(hits, corpus)
    return _united([
        source.chunks.select("chunk_id", *[source.column(by.get(name), kind).alias(fact)
                                           for fact, (kind, by) in _FACTS.items()])
        .join(asked[name], "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
        .withColumn("source", F.lit(name)) for name, source in corpus.items()])


def metadata(name: str, source: Source) -> Column:
    """A source's served columns but the text as JSON; problems by their names, nulls left out."""
    shown = []
    for column in SERVED_COLUMNS.get(TABLE_OF.get(name, ""), {}):
        if column != "content" and column in source.chunks.columns:
            value = F.col(column)
            shown.append((pattern_names(value) if column == "problem_indicators" else value).alias(column))
    return F.to_json(F.struct(*shown)) if shown else F.lit("{}")


def details_of(hits: DataFrame, corpus: dict[str, Source]) -> DataFrame | None:
    """``source, chunk_id, content, metadata`` of the hits, and the columns of ``PLACES``.

    Each source's table is scanned once, for its own hits and its own columns; chunks
    that repeat an id count once.
    """
    asked = _asked(hits, corpus)
    return _united([
        source.chunks.join(asked[name], "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
        .select(F.lit(name).alias("source"), "chunk_id", "content", metadata(name, source).alias("metadata"),
                *[source.column(c, kind).alias(c) for c, kind in PLACES.items()])
        for name, source in corpus.items()])
