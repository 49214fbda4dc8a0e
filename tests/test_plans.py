import dataclasses
import hashlib
import json

import duckdb
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions.embed import hashing_model
from lodestone.operators import stats
from lodestone.plans import analyze, context, corpus as corpora, evaluate
from lodestone.plans.corpus import Source
from lodestone.plans.registry import QUERIES
from lodestone.sources.tables import ChunkStore

MODEL = hashing_model(16)


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [(f"{s}{i}", s, "4.1.0" if i % 2 else "3.5.4", f"{s} text number {i} about collect and joins")
             for s in ("code", "docs", "qa", "issues") for i in range(30)]
    chunks = spark.createDataFrame(texts, "chunk_id string, source string, spark_version string, content string") \
        .withColumn("vec", MODEL.embed(F.col("content")))
    own = {"code": {"file_path": F.concat(F.lit("f/"), "chunk_id"), "spark_apis": F.array(F.lit("DataFrame.collect"))},
           "docs": {"doc_url": F.concat(F.lit("d/"), "chunk_id")},
           "qa": {"question_id": F.lit(7).cast("long"), "score": F.lit(20).cast("long"), "is_accepted": F.lit(True),
                  "spark_apis_mentioned": F.array(F.lit("DataFrame.collect")), "spark_versions_mentioned": F.array(F.lit("4.1.0"))},
           "issues": {"issue_number": F.lit(9).cast("long"), "state": F.lit("closed"), "spark_versions_mentioned": F.array(F.lit("4.1.0"))}}
    out = {}
    for name, columns in own.items():
        rows = chunks.where(F.col("source") == name).drop("source").withColumns(columns)
        out[name] = Source(rows if name in ("code", "docs") else rows.drop("spark_version"))
    return out


REQUESTS = [(1, "How do I join two tables?", None), (2, "How do I join two tables?", ""), (3, "df = x\ndf.collect()", "all"),
            (4, "java.lang.OutOfMemoryError\n\tat org.x.Y", "3.5.4"), (5, "   ", None), (6, "How do I join two tables?", "3.5.4")]


def asked(spark):
    return spark.createDataFrame(REQUESTS, "request_id long, input string, version string")


def test_batch_analysis(spark, corpus):
    rows = analyze.analyze_batch(asked(spark), corpus, MODEL).collect()
    by = {}
    for r in rows:
        by.setdefault(r.request_id, []).append(r)
    assert sorted(by) == [1, 2, 3, 4, 6] and all(len(v) == 20 for v in by.values())
    assert {k: (v[0].input_type, v[0].version) for k, v in by.items()} == {
        1: ("question", "4.1.0"), 2: ("question", "4.1.0"), 3: ("code", "all"), 4: ("logs", "3.5.4"), 6: ("question", "3.5.4")}
    for hits in by.values():
        hits.sort(key=lambda r: r.position)
        assert [r.position for r in hits] == list(range(1, 21))
        assert all(a.score >= b.score for a, b in zip(hits, hits[1:]))
    assert all('"spark_version":"4.1.0"' in r.metadata for r in by[1] if r.source in ("code", "docs"))
    assert all('"spark_version":"3.5.4"' in r.metadata for r in by[6] if r.source in ("code", "docs"))
    assert {p.name for p in by[3][0].patterns} == {"collect_on_large"} and by[4][0].error_types == ["OutOfMemoryError"]
    assert [r.chunk_id for r in by[1]] == [r.chunk_id for r in by[2]]
    kept, rejected = analyze.split_requests(asked(spark))
    assert kept.count() == 5 and [r.request_id for r in rejected.collect()] == [5]


def test_each_source_has_its_own_columns(spark, corpus):
    rows = analyze.analyze_batch(asked(spark), corpus, MODEL, total=40).where("request_id = 1").collect()
    fields = {"code": {"spark_version", "file_path", "spark_apis"}, "docs": {"spark_version", "doc_url"},
              "qa": {"question_id", "score", "is_accepted", "spark_apis_mentioned", "spark_versions_mentioned"},
              "issues": {"issue_number", "state", "spark_versions_mentioned"}}
    assert {r.source for r in rows} == set(fields)
    for r in rows:
        assert set(json.loads(r.metadata)) == fields[r.source]
        assert (r.file_path, r.doc_url, r.question_id, r.issue_number) == (
            f"f/{r.chunk_id}" if r.source == "code" else None, f"d/{r.chunk_id}" if r.source == "docs" else None,
            7 if r.source == "qa" else None, 9 if r.source == "issues" else None)


def test_chosen_sources(spark, corpus):
    rows = analyze.analyze_batch(asked(spark), corpus, MODEL, sources=["issues", "code"]).collect()
    assert {r.source for r in rows} == {"code", "issues"}
    with pytest.warns(UserWarning, match="no chunk table for source"):
        rows = analyze.analyze_batch(asked(spark), {**corpus, "qa": None}, MODEL, sources=["qa", "docs", "papers"]).collect()
    assert {r.source for r in rows} == {"docs"} and len(rows) == 5 * 10
    with pytest.warns(UserWarning):
        none = analyze.analyze_batch(asked(spark), {}, MODEL, sources=["qa"])
    assert none.collect() == [] and {"metadata", "file_path", "content"} <= set(none.columns)


def test_sources_of_a_store_open_only_what_is_asked_for(spark):
    store = ChunkStore.scratch(spark)
    for table in ("code_chunks", "doc_chunks", "chunk_vectors"):
        store.create(table)
    ids = spark.createDataFrame([("a", "4.1.0"), ("b", "3.5.4")], "chunk_id string, spark_version string")
    for table in ("code_chunks", "doc_chunks"):
        kinds = {f.name: f.dataType for f in spark.table(store.full_name(table)).schema}
        store.write(table, ids.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in ("chunk_id", "spark_version")})
                    .withColumn("content", F.concat(F.lit("text "), "chunk_id")))
        for model in (MODEL, hashing_model(8, "emb_other")):
            store.write("chunk_vectors", ids.select("chunk_id", F.array_repeat(F.lit(1.0), model.dim).alias("vec"),
                                                    F.lit(model.column).alias("model_column"), F.lit(table).alias("table_name")))
    found = corpora.from_store(store, MODEL)
    assert [n for n, s in found.items() if s is None] == ["qa", "issues"]
    rows = corpora.search_rows(corpora.chosen(corpora.from_store(store, MODEL, ["docs", "qa"])))
    plan = plan_of(rows)
    assert "doc_chunks" in plan and "code_chunks" not in plan and "PartitionFilters: [isnotnull(model_column" in plan
    assert {(r.chunk_id, r.source, r.only_version, len(r.vec)) for r in rows.collect()} \
        == {("a", "docs", "4.1.0", 16), ("b", "docs", "3.5.4", 16)}
    asked_one = spark.createDataFrame([(1, "text a", "all")], "request_id long, input string, version string")
    with pytest.warns(UserWarning):
        hits = analyze.analyze_batch(asked_one, found, MODEL).collect()
    assert {(r.source, r.content) for r in hits} == {(s, f"text {c}") for s in ("code", "docs") for c in "ab"}


def test_requests_meet_answers_in_a_shuffle(spark, corpus):
    plan = plan_of(analyze.analyze_batch(asked(spark), corpus, MODEL))
    # the last joins add requests and parsed columns: a broadcast there leaves them to few tasks
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert all("SortMergeJoin" in line for line in joins[:2])


def test_answers_are_shaped_once_for_equal_requests(spark, corpus):
    seen = []

    def shape(rows):
        seen.extend(r.search_id for r in rows.where("position = 1").collect())
        return rows.select("search_id", "position", F.md5("content").alias("digest"))

    rows = analyze.analyze_batch(asked(spark), corpus, MODEL, shape=shape)
    assert rows.columns == ["request_id", "position", "digest"] and rows.count() == 5 * 20
    whole = analyze.analyze_batch(asked(spark), corpus, MODEL).select("request_id", "position", F.md5("content").alias("digest"))
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.collect()))
    assert len(seen) == 4  # requests 1 and 2 differ by an empty version only


def test_searches_are_shared_by_requests_of_equal_parse_and_vectors(spark, corpus, monkeypatch):
    seen = []

    def shape(rows):
        seen.append(rows.where("position = 1").count())
        return rows

    asks = spark.createDataFrame([(1, "How do I tune user 1?", "all"), (2, "How do I tune user 2?", "all"), (3, "df.collect() user 1", "all"),
                                  (4, "How do I tune user 1?", "3.5.4")], "request_id long, input string, version string")
    alike = dataclasses.replace(MODEL, embed=lambda t: MODEL.embed(F.regexp_replace(t, "[0-9]", "")))
    for size in (analyze.COPIED_BYTES, 0):
        monkeypatch.setattr(analyze, "COPIED_BYTES", size)
        shared = analyze.analyze_batch(asks, corpus, alike, multi_query=True, shape=shape)
        assert shared.where("request_id = 1").drop("request_id").exceptAll(shared.where("request_id = 2").drop("request_id")).count() == 0
        alone = analyze.analyze_batch(asks.where("request_id = 2"), corpus, alike, multi_query=True)
        assert sorted(map(str, alone.collect())) == sorted(map(str, shared.where("request_id = 2").collect()))
        assert {r.request_id: r["count"] for r in shared.groupBy("request_id").count().collect()} == dict.fromkeys((1, 2, 3, 4), 20)
    assert seen == [3, 3]
    own = analyze.analyze_batch(asks, corpus, MODEL, shape=shape)
    assert own.count() == 80 and seen[2] == 4


def test_late_columns_come_by_broadcast(spark, corpus):
    hits = spark.createDataFrame([("code", "code1"), ("code", "code1"), ("qa", "qa2")], "source string, chunk_id string")
    details = corpora.details_of(hits, corpus)
    assert {(r.source, r.chunk_id, r.content) for r in details.collect()} \
        == {("code", "code1", "code text number 1 about collect and joins"), ("qa", "qa2", "qa text number 2 about collect and joins")}
    assert "BroadcastHashJoin" in plan_of(details) and "SortMergeJoin" not in plan_of(details)


def test_all_queries_of_a_request(spark, corpus):
    one = analyze.analyze_batch(asked(spark), corpus, MODEL).where("request_id = 3").collect()
    more = analyze.analyze_batch(asked(spark), corpus, MODEL, multi_query=True).where("request_id = 3").collect()
    assert len(more) == 20 and min(r.score for r in more) >= min(r.score for r in one)


def test_added_queries(spark):
    parsed = analyze.parse_requests(asked(spark))
    texts = {(r.request_id, r.query_no): r.query_text for r in analyze.expand_queries(parsed).collect()}
    assert texts[3, 1] == "Spark DataFrame.collect RDD.collect usage patterns and best practices"
    assert texts[4, 1] == "Spark OutOfMemoryError cause and fix" and (1, 1) not in texts


def test_context(spark):
    parsed = spark.createDataFrame([(1, "ask", "code", [("p1", "HIGH", "bad")]), (2, "other", "question", [])],
                                   "request_id long, input string, input_type string, patterns array<struct<name:string,risk:string,description:string>>")
    hits = spark.createDataFrame(
        [(1, i, "qa", "x" * 2000, None, 5, "4.1.0") for i in range(20, 0, -1)],
        "request_id long, position int, source string, content string, file_path string, question_id long, spark_version string")
    out = {r.request_id: r.context for r in context.build_context(parsed, hits).collect()}
    assert out[1].startswith("## User Input (code)\n\nask\n\n## Detected Patterns\n\n- **p1** (HIGH): bad\n\n## Retrieved Context\n\n"
                             "### [1] Stackoverflow (SO #5, v4.1.0)\n```\n" + "x" * 1500 + "\n```\n### [2]")
    assert "### [15]" in out[1] and "### [16]" not in out[1]
    assert out[2].startswith("## User Input (question)\n\nother\n\n## Task\n\nAnalyze")


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 12, 1)], "query_id int, chunk_id int, rank int")
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "query_id int, query_label string")
    labels = spark.createDataFrame([(10, "b"), (11, "a"), (12, "a"), (13, "a"), (14, "a")], "chunk_id int, label string")
    recall = {r.query_id: (r.recall_2, r.recall_3) for r in evaluate.recall_at(hits, queries, labels, (2, 3)).collect()}
    assert recall == {1: (0.25, 0.5), 2: (0.25, 0.25), 3: (0.0, 0.0)}
    ranks = evaluate.reciprocal_rank(hits, queries, labels)
    assert {r.query_id: r.reciprocal_rank for r in ranks.collect()} == {1: 0.5, 2: 1.0, 3: 0.0}
    means = evaluate.summary(evaluate.recall_at(hits, queries, labels, (2, 3)), ranks).first()
    assert (means.n_queries, means.mrr) == (3, 0.5)


def test_models_on_held_out_rows(spark):
    words = {"a": "red green blue", "b": "one two three"}
    docs = spark.createDataFrame([(i, f"{words[k]} x{i}", k, "s" if i % 2 else "t") for i, k in enumerate("ab" * 40)] + [(100, "alone", "c", "s")],
                                 "doc_id long, text string, lang string, source string")
    out = evaluate.compare_models(docs, [MODEL, hashing_model(4, "emb_4")], id="doc_id", text="text", label="lang", dataset="source",
                                  folds=2, cuts=(10, 39)).collect()
    assert {(r.model, r.dataset) for r in out} == {(m, d) for m in ("hash-16", "hash-4") for d in "st"}
    held = sum(int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 2 == 0 for i in [*range(80), 100])
    assert sum(r.n_queries for r in out) == 2 * held
    best = [r for r in out if r.model == "hash-16"]
    assert all(r.recall_39 <= 1 and abs(r.recall_10 - 10 / 39) < 0.03 and r.mrr > 0.9 for r in best)


def test_statistics(spark):
    rows = spark.createDataFrame([("m", "py", "12345"), ("m", "java", "1"), ("i", "py", "12")], "kind string, lang string, content string")
    out = {(r.kind, r.value): (r.n_chunks, r.n_chars, r.n_tokens) for r in stats.corpus_stats(
        rows.withColumnRenamed("kind", "chunk_type"), "chunk_type", "lang").collect()}
    assert out["total", ""] == (3, 8, 2) and out["chunk_type", "m"] == (2, 6, 1) and out["lang", "py"] == (2, 7, 1)
    assert [(r.lang, r.n_chunks) for r in stats.top_values(rows, "lang", 1).collect()] == [("py", 2)]


def test_cross_source_counts_before_joining(spark):
    code = spark.createDataFrame([("4.1.0",)] * 5 + [("3.5.4",)], "spark_version string")
    out = stats.versions_across(code=code, docs=code.limit(3))
    assert "Cartesian" not in plan_of(out)
    assert {r.spark_version: (r.n_code, r.n_docs) for r in out.collect()} == {"4.1.0": (5, 3)}


# ---- registered queries against SQL ----

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


@pytest.fixture(scope="module")
def db(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, sf, db, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr([r[c] for c in columns]) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    rel = db.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(repr([r[i] for i in at]) for r in rel.fetchall())


def test_approximate_hits_are_close_to_exact(spark, sf):
    found = entry.queries()["ann_lsh"](spark, sf).collect()
    assert sum(r.in_exact for r in found) / len(found) > 0.7


def test_indexed_hits_are_close_to_exact_and_few_rows_are_scored(spark, sf):
    found = entry.queries()["ann_index"](spark, sf).collect()
    assert sum(r.in_exact for r in found) >= 0.9 * 10 * len({r.item_id for r in found})
    scored = {r.item_id: r.n_scored for r in found}
    assert sum(scored.values()) <= 0.25 * len(scored) * found[0].n_rows


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(entry.oracle_sql()) == {"ann_lsh"}


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
