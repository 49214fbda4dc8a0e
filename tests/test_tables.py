import os

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodestone.functions.embed import hashing_model
from lodestone.sources import landed, scan, serving
from lodestone.sources.schemas import TABLES, Table
from lodestone.sources.tables import ChunkStore
from lodestone.streaming import sync

SMALL = {
    "docs": Table("""doc_id bigint,
        content string""", "spark_version string, language string"),
    "rows": Table("""item bigint,
        n bigint,
        at timestamp""", "bucket int", "item"),
}


@pytest.fixture
def store(spark):
    return ChunkStore.scratch(spark, tables=SMALL, buckets=4)


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, content string, spark_version string, language string")


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item long, n long, at string").withColumn("at", F.to_timestamp("at"))


def content(store, table, *columns):
    return sorted(tuple(r) for r in store.read(table).select(*columns).collect())


def test_write_modes(spark, store):
    rows = docs(spark, (1, "a", "4.1.0", "py"), (2, "b", "3.5", "py"))
    assert store.write("docs", rows, "overwrite") == 2
    assert store.write("docs", rows, "append") == 2
    assert store.write("docs", store.read("docs").where("doc_id = 1"), "overwrite") == 2
    assert content(store, "docs", "doc_id", "spark_version") == [(1, "4.1.0"), (1, "4.1.0")]
    assert store.write("docs", rows.limit(0)) == 0
    for bad in (lambda: store.write("docs", rows, "upsert"), lambda: store.write("none", rows)):
        with pytest.raises(ValueError):
            bad()


def test_version_text_is_not_a_number(spark, store):
    store.write("docs", docs(spark, (1, "a", "3.50", "py")))
    assert content(store, "docs", "spark_version") == [("3.50",)]


def test_replace_version(spark, store):
    store.write("docs", docs(spark, (1, "a", "4.1.0", "py"), (2, "b", "4.1.0", "java"), (3, "c", "3.5", "py")))
    new = docs(spark, (4, "d", "ignored", "py"))
    for _ in range(2):  # again: nothing changes
        assert store.replace_version("docs", "4.1.0", new) == 1
        assert content(store, "docs", "doc_id", "spark_version") == [(3, "3.5"), (4, "4.1.0")]
    assert store.replace_version("docs", "3.5", new.limit(0)) == 0
    assert content(store, "docs", "doc_id") == [(4,)]
    with pytest.raises(ValueError):
        store.replace_version("rows", "4.1.0", new)


def test_replace_by_id(spark, store):
    store.write("rows", items(spark, *[(i, n, "2024-01-01") for i in range(20) for n in range(3)]))
    new = items(spark, (3, 7, "2024-01-02"), (99, 1, "2024-01-02"), (99, 2, "2024-01-02"))
    for _ in range(2):
        assert store.replace_by_id("rows", new) == 3
        rows = content(store, "rows", "item", "n")
        assert len(rows) == 19 * 3 + 3 and [r for r in rows if r[0] in (3, 99)] == [(3, 7), (99, 1), (99, 2)]
    with pytest.raises(ValueError):
        store.replace_by_id("docs", new)


def test_delete(spark, store):
    store.write("rows", items(spark, *[(i, 0, "2024-01-01") for i in range(20)]))
    store.delete_by_id("rows", spark.range(1, 20).toDF("item"))
    assert content(store, "rows", "item") == [(0,)]
    store.delete_by_id("rows", spark.range(20).toDF("item"))
    assert content(store, "rows", "item") == []
    store.write("docs", docs(spark, (1, "a", "4.1.0", "py"), (2, "b", "3.5", "py")))
    store.delete_version("docs", "4.1.0")
    assert content(store, "docs", "doc_id") == [(2,)]
    with pytest.raises(ValueError):
        store.delete_version("rows", "4.1.0")


def test_filter_and_columns_reach_the_scan(spark, store):
    store.write("docs", docs(spark, (1, "a", "4.1.0", "py")))
    plan = plan_of(store.read("docs", ["doc_id"], (F.col("spark_version") == "4.1.0") & (F.col("doc_id") > 0)))
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "GreaterThan(doc_id,0)" in plan
    assert "PartitionFilters: [isnotnull(spark_version" in plan


def test_only_touched_buckets_are_read(spark, store):
    store.write("rows", items(spark, *[(i, 0, "2024-01-01") for i in range(20)]))
    plan = plan_of(store.rows_of("rows", spark.createDataFrame([(3,)], "item long")))
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_describe_and_recreate(spark):
    store = ChunkStore.scratch(spark)
    assert {(r.table_name, r.present, r.n_rows) for r in store.row_counts().collect()} == {(t, False, 0) for t in TABLES}
    store.create_all()
    store.write("chunk_vectors", spark.createDataFrame([("t", "c", [1.0], "m")], "table_name string, chunk_id string, vec array<float>, model_column string"))
    store.create("chunk_vectors")
    counts = {r.table_name: r.n_rows for r in store.row_counts().collect()}
    assert counts == dict.fromkeys(TABLES, 0) | {"chunk_vectors": 1}
    store.create("chunk_vectors", drop_existing=True)
    assert store.read("chunk_vectors").count() == 0


# ---- serving ----

def test_serving(spark):
    chunks = spark.createDataFrame(
        [("c1", "x" * 70000, "4.1.0", "docs/a.md", "s" * 300, ["A", "B"], "prose", ["spark.a.b"]),
         ("c2", "y", "3.5.4", "docs/b.md", "t", None, "prose", None)],
        "chunk_id string, content string, spark_version string, doc_url string, doc_section string, "
        "heading_hierarchy array<string>, content_type string, related_configs array<string>")
    vecs = spark.createDataFrame([("c1", [1.0, 0.0], "emb_a"), ("c1", [0.5], "emb_b")], "chunk_id string, vec array<float>, model_column string")
    out = {r.doc_url: r for r in serving.serving_export("doc_chunks", chunks, vecs, "emb_a", 2).collect()}
    first = out["docs/a.md"]
    assert (len(first.content), len(first.doc_section), first.embedding) == (65535, 256, [1.0, 0.0])
    assert (first.heading_hierarchy, first.related_configs) == ('["A","B"]', '{"configs":["spark.a.b"]}')
    assert out["docs/b.md"].related_configs == '{"configs":[]}' and out["docs/b.md"].embedding is None
    assert not {"chunk_id", "ingested_at"} & set(first.asDict())
    assert serving.serving_export("doc_chunks", chunks, vecs, "emb_a", 2, "3.5.4").count() == 1
    assert serving.serving_export("doc_chunks", chunks, vecs, "emb_a", 2, "9.9").count() == 0
    with pytest.raises(ValueError):
        serving.serving_export("doc_chunks", chunks, vecs, "emb_none", 2)


def test_models(spark):
    models = [hashing_model(8, "emb_a"), hashing_model(16, "emb_b")]
    registry = serving.model_registry(spark, models, "emb_b")
    assert [(r.model_column, r.dim) for r in registry.where("active").collect()] == [("emb_b", 16)]
    with pytest.raises(ValueError):
        serving.model_registry(spark, models, "emb_c")


# ---- sources ----

def test_scan(spark, tmp_path):
    for path, data in {"core/a.py": b"x = 1\n", "core/sub/b+c d.scala": "é".encode(), "core/c.txt": b"no",
                       "docs/z.md": b"# Z", "docs/a.md": b"bad \xff byte", "docs/sub/n.md": b"deep",
                       "ex/src/one.py": b"one"}.items():
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_bytes(data)
    root = str(tmp_path)
    code = scan.scan_files(spark, root, ["core/", "missing/"], [".py", ".scala"])
    assert {(r.file_path, r.content) for r in code.collect()} == {("core/a.py", "x = 1\n"), ("core/sub/b+c d.scala", "é")}
    docs = {r.file_path: r.content for r in scan.scan_docs(spark, root, ["docs"]).collect()}
    assert docs == {"docs/z.md": "# Z", "docs/a.md": "bad � byte"}
    keys = {r.key for r in scan.example_lookup(spark, root, "ex/src/").collect()}
    assert keys == {"ex/src/one.py", "one.py"}
    assert scan.scan_files(spark, root, ["missing"], [".py"]).count() == 0


def test_questions(spark, tmp_path):
    lines = ['{"question_id": 1, "answer_count": 1, "tags": ["apache-spark", "sql"], "last_activity_date": 1704067200}',
             '{"question_id": 2, "answer_count": 0, "tags": ["apache-spark"], "last_activity_date": 1704067300}',
             '{"question_id": 3, "answer_count": 2, "tags": ["apache-spark"], "last_activity_date": 1706745600}']
    (tmp_path / "q.json").write_text("\n".join(lines))
    items = landed.read_questions(spark, str(tmp_path))

    def ids(*args, **kw):
        return [r.question_id for r in landed.select_questions(items, *args, **kw).collect()]

    assert ids() == [3, 1] and ids(["sql"]) == [1] and ids(since="2024-01-15") == [3] and ids(most=1) == [3]


def test_issues(spark, tmp_path):
    lines = ['{"number": 1, "state": "open", "updated_at": "2024-01-01T00:00:00Z"}',
             '{"number": 2, "state": "closed", "updated_at": "2024-02-01T00:00:00Z", "pull_request": {"url": "u"}}',
             '{"number": 3, "state": "closed", "updated_at": "2024-03-01T00:00:00Z"}']
    (tmp_path / "i.json").write_text("\n".join(lines))
    items = landed.read_issues(spark, str(tmp_path))

    def ids(*args, **kw):
        return [r.number for r in landed.select_issues(items, *args, **kw).collect()]

    assert ids() == [3, 1] and ids("open") == [1] and ids(since="2024-02-15") == [3] and ids(most=1) == [3]


# ---- sync ----

def newest():
    return [-F.unix_micros("at"), -F.col("n")]


def test_mark_moves_and_old_rows_are_not_read_again(spark, store):
    store.create("rows")
    sync.sync_newer(store, "rows", items(spark, (1, 1, "2024-01-01"), (2, 1, "2024-01-02")), "at", newest())
    sync.sync_newer(store, "rows", items(spark, (1, 2, "2024-01-03"), (2, 9, "2024-01-01"), (3, 1, "2024-01-04")), "at", newest())
    assert content(store, "rows", "item", "n") == [(1, 2), (2, 1), (3, 1)]
    sync.sync_newer(store, "rows", items(spark, (4, 1, "2024-01-02")), "at", newest())
    assert content(store, "rows", "item", "n") == [(1, 2), (2, 1), (3, 1)]


def test_stream_takes_each_file_once(spark, store, tmp_path):
    landing, progress = str(tmp_path / "landing"), str(tmp_path / "progress")
    first = items(spark, (1, 1, "2024-01-01"), (1, 2, "2024-01-02"), (2, 1, "2024-01-01"))
    first.repartition(3).write.mode("append").parquet(landing)
    sync.stream_upsert(store, "rows", landing, first.schema, newest(), progress, max_files=1)
    assert content(store, "rows", "item", "n") == [(1, 2), (2, 1)]
    items(spark, (2, 5, "2024-01-05"), (1, 0, "2023-01-01")).write.mode("append").parquet(landing)
    sync.stream_upsert(store, "rows", landing, first.schema, newest(), progress)
    sync.stream_upsert(store, "rows", landing, first.schema, newest(), progress)
    assert content(store, "rows", "item", "n") == [(1, 2), (2, 5)]


def test_a_batch_run_again_changes_nothing(spark, store):
    store.create("rows")
    batch = items(spark, (1, 1, "2024-01-01"), (2, 2, "2024-01-01"))
    for _ in range(3):
        sync.upsert_latest(store, "rows", batch, newest())
        assert content(store, "rows", "item", "n") == [(1, 1), (2, 2)]


def test_bucket_count_is_the_table_s_own(spark):
    first = ChunkStore.scratch(spark, tables=SMALL, buckets=4)
    table = next(t for t in SMALL if SMALL[t].id_column)
    first.create(table)
    second = ChunkStore(spark, first.database, tables=SMALL, buckets=9)
    assert first.buckets_of(table) == second.buckets_of(table) == 4
    second.create(table, drop_existing=True)
    assert second.buckets_of(table) == 9
    spark.sql(f"ALTER TABLE {second.full_name(table)} UNSET TBLPROPERTIES ('lodestone.buckets')")
    with pytest.raises(ValueError, match="id buckets"):
        ChunkStore(spark, first.database, tables=SMALL).buckets_of(table)


def test_failed_overwrite_keeps_the_old_rows(spark, store, monkeypatch):
    store.write("docs", docs(spark, (1, "a", "4.1.0", "py"), (2, "b", "3.5", "py")))
    before = content(store, "docs", "doc_id", "content")
    bad = store.read("docs").withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write("docs", bad, "overwrite")
    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr("lodestone.sources.tables.checkpointed", lambda df, _: df)  # fails inside the insert itself
        store.write("docs", bad, "overwrite")
    assert content(store, "docs", "doc_id", "content") == before
    assert store.write("docs", docs(spark, (3, "c", "4.1.0", "py")), "overwrite") == 1
    assert content(store, "docs", "doc_id", "content") == [(3, "c")]
    assert store.write("docs", docs(spark, (3, "c", "4.1.0", "py")).limit(0), "overwrite") == 0 and not content(store, "docs", "doc_id")
