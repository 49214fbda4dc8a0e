"""A table of requests to ranked references, in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as pt, rules, text as tx
from ..functions.embed import Model
from ..operators.rank import merge_hits, rerank_score
from ..operators.search import ranked, top_k
from ..session import checkpointed
from .corpus import PLACES, Corpus, chosen, details_of, facts_of, search_rows

# Phrases of the added queries.
API_QUERY = ("Spark ", " usage patterns and best practices")
ERROR_QUERY = ("Spark ", " cause and fix")

#: answers of this size at most, as JSON, are repeated so many times for the join with their requests
COPIED_BYTES, COPIES = 32 << 20, 16


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with an input, and rejects without one."""
    blank = tx.is_blank(F.col("input"))
    return requests.where(~blank), requests.where(blank)


def parse_requests(requests: DataFrame, baseline: str = rules.BASELINE_VERSION) -> DataFrame:
    """Input type, problems, APIs, error types and version of each request."""
    text = F.col("input")
    version = F.col("version") if "version" in requests.columns else F.lit(None).cast("string")
    return (
        requests
        .withColumn("version", F.coalesce(F.nullif(version, F.lit("")), F.lit(baseline)))
        .withColumn("input_type", tx.classify_input(text))
        .withColumn("patterns", pt.detect_patterns(text))
        .withColumn("apis", pt.api_names(pt.detect_apis(text)))
        .withColumn("error_types", tx.error_types(text))
    )


def query_texts() -> Column:
    """The query texts of a parsed request as a list: its input, and at most one more."""
    first_apis = F.array_join(F.slice("apis", 1, 5), " ")
    extra = (
        F.when((F.col("input_type") == "code") & (F.size("apis") > 0),
               F.concat(F.lit(API_QUERY[0]), first_apis, F.lit(API_QUERY[1])))
        .when((F.col("input_type") == "logs") & (F.size("error_types") > 0),
              F.concat(F.lit(ERROR_QUERY[0]), F.try_element_at("error_types", F.lit(1)),
                       F.lit(ERROR_QUERY[1])))
    )
    return F.filter(F.array(F.col("input"), extra), lambda t: t.isNotNull())


def expand_queries(parsed: DataFrame) -> DataFrame:
    """The query texts of each request: ``query_no``, ``query_text``; number 0 is the input."""
    rest = [c for c in parsed.columns if c in ("request_id", "input_type", "version")]
    return parsed.select(*rest, F.posexplode(query_texts()).alias("query_no", "query_text"))


def with_search_ids(parsed: DataFrame, model: Model, multi_query: bool = False) -> DataFrame:
    """Parsed requests with ``search_id``: a digest of what their answers depend on.

    Of a query text that is its vector alone: an embedder gives many short texts the same one.
    Vectors stand for themselves by 128 bits.
    """
    texts = [F.try_element_at(query_texts(), F.lit(i + 1)) for i in range(2 if multi_query else 1)]
    # columns of their own: each vector is made once and hashed twice
    vectors = parsed.withColumns({f"_vec_{i}": model.embed(text) for i, text in enumerate(texts)})
    prints = [F.when(text.isNotNull(), F.struct(*[F.xxhash64(F.lit(seed), f"_vec_{i}").alias(f"_{seed}") for seed in (1, 2)])).alias(f"query_{i}")
              for i, text in enumerate(texts)]
    key = F.to_json(F.struct("input_type", "patterns", "apis", "error_types", "version", *prints))
    return vectors.select(*parsed.columns, F.sha2(key, 256).alias("search_id"))


def search_references(parsed: DataFrame, corpus: Corpus, model: Model, *, sources: Sequence[str] | None = None,
                      per_source: int = rules.TOP_PER_SOURCE, total: int = rules.TOP_TOTAL,
                      weights=None, multi_query: bool = False) -> DataFrame:
    """Ranked hits per distinct request text: search_id, position, source, chunk_id, sim, score.

    ``corpus`` has the chunk table of each source; ``sources`` are those to search, all by
    default. A source without a table is skipped; without any there are no hits.
    """
    tables = chosen(corpus, sources)
    rows = search_rows(tables)
    if rows is None:
        return parsed.sparkSession.createDataFrame(
            [], "search_id string, position int, source string, chunk_id string, sim double, score double")
    queries = expand_queries(parsed.withColumnRenamed("search_id", "request_id"))
    if not multi_query:
        queries = queries.where(F.col("query_no") == 0)
    vectors = checkpointed(queries.select(
        F.concat_ws("/", "request_id", "query_no").alias("query_id"),
        F.when(F.col("version") != "all", F.col("version")).alias("only_version"),
        model.embed(F.col("query_text")).alias("vec")), "queries")
    hits = top_k(vectors, rows, per_source, by=["source"], limit=("only_version", "only_version"), dim=model.dim)
    hits = hits.withColumn("request_id", F.regexp_replace("query_id", "/[0-9]+$", ""))
    if multi_query:
        hits = hits.groupBy("request_id", "source", "chunk_id").agg(F.max("sim").alias("sim"))
        hits = ranked(hits, per_source, ["request_id", "source"], "chunk_id")
    hits = checkpointed(hits, "hits")
    asked = parsed.select(F.col("search_id").alias("request_id"), "input_type", F.col("apis").alias("asked_apis"), "version")
    # hits are many more than the chunks or requests they name: neither of these is streamed
    # past broadcast hits, whose work would stay in the few tasks that hold them
    scored = (
        hits.join(facts_of(hits, tables).hint("merge"), ["source", "chunk_id"]).join(asked.hint("merge"), "request_id")
        .withColumn("score", rerank_score(
            F.col("sim"), F.col("input_type"), F.col("source"), F.col("asked_apis"), F.col("apis"),
            F.col("votes"), F.col("accepted"), F.col("state"), F.col("versions"),
            F.col("version"), weights))
    )
    best = merge_hits(scored, total)
    return best.select(F.col("request_id").alias("search_id"), "position", "source", "chunk_id", "sim", "score")


def analyze_batch(requests: DataFrame, corpus: Corpus, model: Model, *, sources: Sequence[str] | None = None,
                  baseline: str = rules.BASELINE_VERSION,
                  shape: Callable[[DataFrame], DataFrame] | None = None, **search) -> DataFrame:
    """Answer a table of requests (``request_id``, ``input``, optionally ``version``).

    One row per request and hit: the parsed request, position, source, the start of the
    text, score, ``metadata`` (JSON of the source's own columns) and the columns that name
    the hit's place, null where its source has none. Equal inputs of equal version are parsed
    once. Requests that are parsed to the same, with queries of the same vectors, have the same
    answers: these are searched once and joined back, so such requests cost their output only.
    What is to be derived from a hit alone belongs in ``shape``: it gets the answers of the distinct
    searches, known by ``search_id``, which it must keep. Blank inputs give no rows (see ``split_requests``).
    """
    asked, _ = split_requests(requests)
    version = F.col("version") if "version" in asked.columns else F.lit("")
    asked = asked.withColumn("text_id", F.sha2(F.concat_ws(
        "\x01", F.coalesce(version, F.lit("")), F.col("input")), 256))
    columns = ["text_id", "input"] + (["version"] if "version" in asked.columns else [])
    distinct = asked.select(*columns).groupBy("text_id").agg(
        *[F.any_value(c).alias(c) for c in columns[1:]])
    known = checkpointed(with_search_ids(parse_requests(distinct, baseline), model, search.get("multi_query", False)), "known")
    # any of the inputs of a search stands for it: their vectors are equal
    parsed = checkpointed(known.groupBy("search_id").agg(*[
        F.any_value(c).alias(c) for c in known.columns if c not in ("search_id", "text_id")]), "parsed")
    tables = chosen(corpus, sources)
    hits = checkpointed(search_references(parsed, tables, model, **search), "references")
    details = details_of(hits, tables)
    if details is None:
        kinds = {"content": "string", "metadata": "string"} | PLACES
        shown = hits.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()})
    else:
        shown = hits.join(details.hint("merge"), ["source", "chunk_id"])
    shaped = (
        shown.join(parsed.select("search_id", "input_type", "patterns", "error_types", "version").hint("merge"), "search_id")
        .select("search_id", "input_type", "patterns", "error_types", "version", "position", "source",
                "chunk_id", F.left("content", F.lit(2000)).alias("content"),
                tx.half_up(F.col("score"), 4).alias("score"), "metadata", *PLACES)
    )
    asked = asked.select("request_id", "text_id").join(known.select("text_id", "search_id").hint("merge"), "text_id")
    return joined_back(asked.drop("text_id"), shaped if shape is None else shape(shaped))


def joined_back(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers of each request: ``request_id`` and the columns of ``answers`` but ``search_id``.

    The requests make many more rows than either side has, so both are shuffled and the rows
    of a search meet as one: neither side is broadcast, which would leave all requests to the
    few tasks that hold the other. The answers are written and measured: few are repeated, and
    the requests dealt over the copies, so that those of a frequent search go to several tasks.
    """
    rest = [c for c in answers.columns if c != "search_id"]
    packed = checkpointed(answers.groupBy("search_id").agg(F.collect_list(F.struct(*rest)).alias("_answers")), "answers")
    size = packed.agg(F.sum(F.length(F.to_json("_answers")))).first()[0] or 0
    copies = COPIES if size <= COPIED_BYTES else 1
    packed = packed.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = asked.withColumn("_copy", F.pmod(F.xxhash64("request_id"), F.lit(copies)).cast("int"))
    return asked.join(packed.hint("merge"), ["search_id", "_copy"]).select("request_id", F.inline("_answers"))
