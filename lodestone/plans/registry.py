"""The registered queries: each runs an operator over the given tables.

Integers are widened and lists joined in the results, so that any engine's output
compares by plain values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import ids, packing, patterns as pt, rules, text as tx
from ..functions.embed import hashing_model
from ..operators import code, index, markdown, rank, search, stats, threads, vectors
from ..session import checkpointed, scratch_path
from ..sources import landed, scan, serving
from ..sources.schemas import Table
from ..sources.tables import ChunkStore
from ..streaming import sync
from ..views import frame
from . import analyze, context, corpus as corpora, evaluate

MODEL = hashing_model(64)
SINCE = "2024-01-15"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(fn(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint, lists of strings and numbers joined by a bar."""
    def shaped(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        return c.alias(f.name)
    return df.select(*[shaped(f) for f in df.schema])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan.read_table(spark, f"{sf_dir}/{name}.parquet")


def md5(column: str) -> Column:
    return F.md5(F.encode(column, "UTF-8"))


def print_of(vec: str) -> Column:
    """A vector as text: whole millionths."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1000000)
                                    .cast("bigint").cast("string")), ",")


# ---- packing, ids, mentions ----

@query
def pack_lines(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(packing.pack_lines(F.col("text"))).alias("piece_no", "piece")) \
        .select("doc_id", "piece_no", F.length("piece").alias("n_chars"), md5("piece").alias("piece_md5"))


@query
def pack_paragraphs(spark, d):
    docs = frame(spark, d, "md_docs")
    return docs.select("doc_id", F.posexplode(packing.pack_paragraphs(F.col("content"))).alias("piece_no", "piece")) \
        .select("doc_id", "piece_no", F.length("piece").alias("n_chars"), md5("piece").alias("piece_md5"))


@query
def chunk_id(spark, d):
    c = F.col
    return table(spark, d, "documents").select(
        "doc_id", ids.content_hash(c("text")).alias("content_hash"),
        ids.code_chunk_id(F.lit("4.1.0"), c("source"), c("lang"), c("n_chars")).alias("code_id"),
        ids.doc_chunk_id(F.lit("4.1.0"), c("source"), c("lang"), c("text")).alias("doc_chunk_id"),
        ids.qa_chunk_id(c("doc_id"), c("lang") == "en", c("text")).alias("qa_id"),
        ids.issue_chunk_id(c("doc_id"), c("lang") == "en", c("source"), c("text")).alias("issue_id"))


@query
def version_mentions(spark, d):
    return frame(spark, d, "issue_items").select(
        "issue_number", "turn", tx.version_mentions(F.col("body")).alias("versions"))


@query
def label_versions(spark, d):
    labels, milestone = F.array("label"), F.col("milestone")
    return frame(spark, d, "issue_threads").select(
        "issue_number", "turn", tx.label_versions(labels, milestone).alias("label_versions"),
        tx.all_versions(labels, milestone, F.col("body")).alias("all_versions"))


@query
def pr_refs(spark, d):
    return frame(spark, d, "issue_items").select(
        "issue_number", "turn", tx.pr_refs(F.col("body")).alias("prs"))


@query
def config_keys(spark, d):
    return frame(spark, d, "md_docs").select("doc_id", tx.config_keys(F.col("content")).alias("config_keys"))


@query
def error_types(spark, d):
    return frame(spark, d, "log_texts").select(
        "event_id", tx.error_types(F.col("input")).alias("error_types"),
        tx.first_error(F.col("input")).alias("error_type"))


@query
def is_stacktrace(spark, d):
    return frame(spark, d, "log_texts").select("event_id", tx.is_stacktrace(F.col("input")).alias("is_stacktrace"))


@query
def classify_input(spark, d):
    return frame(spark, d, "log_texts").select("event_id", tx.classify_input(F.col("input")).alias("input_type"))


@query
def json_unwrap(spark, d):
    """Event properties wrapped as lists, then unwrapped."""
    props = F.regexp_replace("props", r": ([0-9]+)", ': ["$1"]')
    return table(spark, d, "events").select("event_id", tx.unwrap_list(props, "k").alias("k"),
                                            tx.wrap_list(tx.unwrap_list(props, "k"), "k").alias("wrapped"))


# ---- documents ----

def section_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", "section_no", "part_no", "piece_no", "doc_url", "doc_section", "heading_hierarchy",
        "content_type", "related_configs", md5("content").alias("content_md5"), "chunk_id")


@query
def md_sections(spark, d):
    """The whole document job: include tags resolved, then sections, parts and pieces."""
    return section_rows(markdown.chunk_documents(frame(spark, d, "md_docs"), example_code(spark, d)))


@query
def md_sections_marks(spark, d):
    """Documents that hold the control characters which mark folded blocks."""
    return section_rows(markdown.chunk_documents(frame(spark, d, "mark_docs"), example_code(spark, d)))


@query
def heading_path(spark, d):
    return markdown.split_sections(frame(spark, d, "md_docs")).select(
        "doc_id", "section_no", "level", "heading", F.col("path").alias("heading_path"))


@query
def md_code_blocks(spark, d):
    return frame(spark, d, "md_docs").select(
        "doc_id", F.posexplode(markdown.code_blocks(F.col("content"))).alias("block_no", "code"))


@query
def html_tables(spark, d):
    tables = tx.html_tables(F.col("content"))
    return frame(spark, d, "md_docs").select("doc_id", F.posexplode(tables).alias("table_no", "html")) \
        .select("doc_id", "table_no", tx.table_to_text(F.col("html")).alias("table_text"))


@query
def html_tables_nested(spark, d):
    """Tables with nested tables, cells and rows that are not closed, tags in capitals, and no cells."""
    found = frame(spark, d, "table_docs").select("doc_id", F.posexplode(tx.html_tables(F.col("content"))).alias("table_no", "html"))
    return found.select("doc_id", "table_no", tx.table_to_text(F.col("html")).alias("table_text"))


@query
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("page_text")) \
        .select("page_id", F.length("page_text").alias("n_chars"), md5("page_text").alias("text_md5"))


def example_code(spark, d) -> DataFrame:
    return frame(spark, d, "code_files").select(
        F.concat(F.lit("ex"), (F.col("p_partkey") * 2).cast("string")).alias("key"),
        F.col("content").alias("code"))


@query
def include_join(spark, d):
    resolved = markdown.resolve_includes(frame(spark, d, "md_docs"), example_code(spark, d))
    return resolved.select("doc_id", F.length("content").alias("n_chars"), md5("content").alias("content_md5"))


@query
def top_sections(spark, d):
    return stats.top_values(markdown.chunk_documents(frame(spark, d, "md_docs"), example_code(spark, d)), "doc_section")


# ---- code ----

@query
def detect_apis(spark, d):
    found = frame(spark, d, "code_files").select("p_partkey", pt.detect_apis(F.col("content")).alias("a"))
    return found.select("p_partkey", pt.api_names(F.col("a")).alias("apis"),
                        F.transform("a", lambda x: x["line"]).alias("first_lines"))


@query
def detect_patterns(spark, d):
    found = frame(spark, d, "code_files").select("p_partkey", F.posexplode(
        pt.detect_patterns(F.col("content"))).alias("pattern_no", "p"))
    return found.select("p_partkey", "pattern_no", "p.*")


@query
def pattern_metadata(spark, d):
    record = frame(spark, d, "code_files").select("p_partkey", pt.pattern_record(F.col("content")).alias("r"))
    return record.select("p_partkey", "r.apis", pt.pattern_names(F.col("r.patterns")).alias("pattern_names"),
                         "r.has_problems", pt.pattern_json(F.col("r")).alias("pattern_json"))


@query
def detect_every_rule(spark, d):
    """Texts in which each of the API, problem and error rules occurs."""
    text = F.col("content")
    found = frame(spark, d, "rule_texts").select(
        "p_partkey", pt.detect_apis(text).alias("a"), pt.detect_patterns(text).alias("p"), tx.error_types(text).alias("error_types"))
    return found.select("p_partkey", pt.api_names(F.col("a")).alias("apis"), F.transform("a", lambda x: x["line"]).alias("api_lines"),
                        pt.pattern_names(F.col("p")).alias("patterns"), F.transform("p", lambda x: x["line"]).alias("pattern_lines"),
                        F.transform("p", lambda x: x["match_text"]).alias("found"), "error_types")


#: a user's own rules: a plain one, one that another text cancels, one over two lines
OWN_APIS = (rules.Rule("load", r"\bload[0-9]+\s*\("), rules.Rule("write csv", r"\.csv\b"))
OWN_PROBLEMS = (rules.Rule("parquet", r"\.parquet\s*\(", "LOW", "reads a file", unless=r"C1[0-9]:"),
                rules.Rule("loop", r"for\s.*\n.*\.filter\s*\(", "MEDIUM", "filters in a loop", spans_lines=True))


@query
def detect_own_rules(spark, d):
    """API and problem rules of the caller instead of the given ones."""
    text = F.col("content")
    found = frame(spark, d, "code_files").select("p_partkey", pt.detect_apis(text, OWN_APIS).alias("a"),
                                                 pt.detect_patterns(text, OWN_PROBLEMS).alias("p"))
    return found.select("p_partkey", pt.api_names(F.col("a")).alias("apis"),
                        F.transform("p", lambda x: F.concat_ws("/", x["name"], x["risk"], x["description"], x["line"], x["match_text"])).alias("patterns"))


@query
def detect_language(spark, d):
    """Files of four endings; those of no known language are dropped."""
    files = table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("f"), F.col("p_partkey").cast("string"),
        F.element_at(F.array(*map(F.lit, (".py", ".scala", ".java", ".md"))),
                     (F.col("p_partkey") % 4 + 1).cast("int"))).alias("file_path"))
    return files.withColumn("language", tx.detect_language(F.col("file_path"))).where("language is not null")


@query
def code_units(spark, d):
    return code.chunk_code(frame(spark, d, "code_files")).select(
        "p_partkey", "chunk_type", "qualified_name", "signature", "start_line", "end_line", "spark_apis",
        pt.pattern_names(F.col("problem_indicators")).alias("problems"), md5("content").alias("content_md5"),
        "chunk_id")


@query
def code_units_languages(spark, d):
    """Units of Python, Scala and Java sources."""
    return code.chunk_code(frame(spark, d, "unit_files")).select(
        "p_partkey", "language", "chunk_type", "qualified_name", "signature", "start_line", "end_line", "spark_apis",
        pt.pattern_names(F.col("problem_indicators")).alias("problems"), md5("content").alias("content_md5"), "chunk_id")


@query
def class_summary(spark, d):
    return code.class_summaries(frame(spark, d, "code_files")).select(
        "p_partkey", "qualified_name", "signature", "content", "start_line", "end_line")


@query
def split_units(spark, d):
    units = code.enrich_units(code.code_units(frame(spark, d, "long_code")))
    return code.split_units(units).select(
        "doc_id", "chunk_type", "part_no", "qualified_name", F.length("signature").alias("signature_chars"),
        "start_line", "end_line", md5("content").alias("content_md5"))


# ---- threads and issues ----

def qa_messages(spark, d) -> DataFrame:
    return frame(spark, d, "qa_threads").withColumn("tags", F.array(F.lit("apache-spark")))


@query
def qa_chunks(spark, d):
    return threads.chunk_qa(qa_messages(spark, d)).select(
        "question_id", "turn", "kind", "is_question", "score", "is_accepted", "tags", "error_type",
        "spark_apis_mentioned", "spark_versions_mentioned", md5("content").alias("content_md5"), "chunk_id")


@query
def qa_nested(spark, d):
    """Items with nested answers landed as JSON, read, selected by two tags and date, cut into chunks."""
    rows = frame(spark, d, "qa_threads").where("kind <> 's'")
    tags = F.split(F.when(F.col("question_id") % 2 == 0, "apache-spark,join").otherwise("apache-spark,sql"), ",")
    answers = rows.where("kind = 'a'").groupBy("question_id").agg(F.count(F.lit(1)).alias("answer_count"), F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "body", "score", "is_accepted"))),
        lambda a: F.struct(a["turn"].alias("answer_id"), a["body"].alias("body"), a["score"].alias("score"),
                           a["is_accepted"].alias("is_accepted"))).alias("answers"))
    items = rows.where("is_question").join(answers, "question_id", "left").select(
        "question_id", "title", "body", "score", tags.alias("tags"), F.coalesce("answer_count", F.lit(0)).alias("answer_count"),
        (F.lit(1704067200) + F.col("question_id") * 3600).alias("last_activity_date"), "answers")
    path = scratch_path(spark, "nested")
    items.write.json(path)
    kept = landed.select_questions(landed.read_questions(spark, path), ["join", "apache-spark"], "2024-01-01 06:00:00")
    return threads.chunk_qa(threads.qa_messages(kept)).select(
        "question_id", "is_question", "score", "is_accepted", "tags", "error_type", "spark_apis_mentioned",
        "spark_versions_mentioned", md5("content").alias("content_md5"), "chunk_id")


@query
def issue_nested(spark, d):
    """Issues with nested comments landed as JSON, pull requests dropped, cut into chunks."""
    rows = frame(spark, d, "issue_threads")
    comments = rows.where("is_comment").groupBy("issue_number").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "body", "author", "created_at"))),
        lambda c: F.struct(c["body"].alias("body"), F.struct(c["author"].alias("login")).alias("user"),
                           c["created_at"].alias("created_at"))).alias("comments_data"))
    items = rows.where("not is_comment").join(comments, "issue_number", "left").select(
        F.col("issue_number").alias("number"), "title", "body", "state",
        F.struct(F.col("author").alias("login")).alias("user"),
        F.array(F.struct(F.col("label").alias("name"))).alias("labels"),
        F.struct(F.col("milestone").alias("title")).alias("milestone"), "created_at", "closed_at",
        F.lit("2024-01-02T00:00:00Z").alias("updated_at"),
        F.when(F.col("issue_number") % 4 == 0, F.struct(F.lit("pull").alias("url"))).alias("pull_request"), "comments_data")
    path = scratch_path(spark, "nested")
    items.write.json(path)
    kept = landed.select_issues(landed.read_issues(spark, path), "all", "2024-01-01")
    return threads.chunk_issues(threads.issue_messages(kept)).select(
        "issue_number", "created_at", "closed_at", "state", "is_comment", "parent_issue_number", "author",
        "labels", "spark_versions_mentioned", "linked_prs", md5("content").alias("content_md5"), "chunk_id")


def issue_rows(spark, d) -> DataFrame:
    """Issues and comments as two tables, put together."""
    rows = frame(spark, d, "issue_threads").withColumn("number", F.col("issue_number"))
    issues = rows.where("turn = 0").withColumn("labels", F.array("label"))
    return threads.chunk_issues(threads.attach_comments(issues, rows.where("turn > 0")))


@query
def issue_chunks(spark, d):
    return issue_rows(spark, d).select(
        "issue_number", "created_at", "closed_at", "state", "is_comment", "parent_issue_number", "author",
        "labels", "spark_versions_mentioned", "linked_prs", md5("content").alias("content_md5"), "chunk_id")


@query
def qa_source(spark, d):
    """Items written as JSON lines, read back and selected."""
    rows = qa_messages(spark, d)
    questions = rows.where("is_question").select("question_id", "title", "body", "score", "tags")
    answers = rows.where("kind = 'a'").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    items = questions.join(answers, "question_id", "left").select(
        *questions.columns, F.coalesce("n", F.lit(0)).alias("answer_count"),
        (F.lit(1704067200) + F.col("question_id") * 3600).alias("last_activity_date"))
    path = scratch_path(spark, "questions")
    items.write.json(path)
    kept = landed.select_questions(landed.read_questions(spark, path), ["apache-spark"], "2024-01-01 06:00:00")
    return kept.select("question_id", "title", "score", "answer_count", "last_activity_date")


@query
def issue_source(spark, d):
    rows = frame(spark, d, "issue_threads").where("turn = 0")
    items = rows.select(
        F.col("issue_number").alias("number"), "title", "body", "state",
        F.struct(F.col("author").alias("login")).alias("user"),
        F.array(F.struct(F.col("label").alias("name"))).alias("labels"),
        F.struct(F.col("milestone").alias("title")).alias("milestone"), "created_at", "closed_at",
        F.date_format(F.lit("2024-01-01").cast("timestamp_ntz")
                      + F.make_dt_interval(mins=F.col("issue_number").cast("int")),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
        F.when(F.col("issue_number") % 4 == 0, F.struct(F.lit("pull").alias("url"))).alias("pull_request"))
    path = scratch_path(spark, "issues")
    items.write.json(path)
    kept = landed.select_issues(landed.read_issues(spark, path), "closed", "2024-01-01")
    return kept.select("number", "title", "state", "user.login", "updated_at")


@query
def chunks_per_thread(spark, d):
    return stats.chunks_per(threads.chunk_qa(qa_messages(spark, d)), "question_id")


# ---- tables ----

DOCS = {"docs": Table("""doc_id bigint,
    content string,
    n_chars bigint""", "spark_version string, language string")}
MESSAGES = {"messages": Table("""issue_number bigint,
    turn bigint,
    body string""", "bucket int", "issue_number")}
LATEST = {"latest": Table("""user_id bigint,
    event_id bigint,
    ts timestamp,
    event_type string,
    value double""", "bucket int", "user_id")}


def doc_rows(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("content"), "n_chars",
        F.when(F.col("doc_id") % 2 == 0, "4.1.0").otherwise("3.5.4").alias("spark_version"),
        F.col("lang").alias("language"))


def messages(spark, d) -> DataFrame:
    return frame(spark, d, "issue_items").select("issue_number", "turn", "body")


@query
def write_read(spark, d):
    """Overwritten twice, appended once, then read with a filter and three columns."""
    store = ChunkStore.scratch(spark, tables=DOCS)
    rows = doc_rows(spark, d)
    store.write("docs", rows, "overwrite")
    store.write("docs", store.read("docs").where("spark_version = '4.1.0'"), "overwrite")
    store.write("docs", rows.where("spark_version = '3.5.4'"), "append")
    return store.read("docs", ["doc_id", "spark_version", "n_chars"], F.col("n_chars") > 500)


@query
def replace_version(spark, d):
    """All rows of 4.1.0 replaced by the labelled documents of that version."""
    store = ChunkStore.scratch(spark, tables=DOCS)
    rows = doc_rows(spark, d)
    store.write("docs", rows)
    new = rows.where("spark_version = '4.1.0'").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    store.replace_version("docs", "4.1.0", new.withColumn("content", F.concat(F.lit("new "), "content")))
    return store.read("docs").select("doc_id", "spark_version", "language", md5("content").alias("content_md5"))


@query
def upsert_by_id(spark, d):
    """Every open issue replaced by its first message, through a store opened with another bucket count."""
    store = ChunkStore.scratch(spark, tables=MESSAGES, buckets=16)
    store.write("messages", messages(spark, d))
    store = ChunkStore(spark, store.database, tables=MESSAGES, buckets=5)
    new = frame(spark, d, "issue_items").where("state = 'open' and turn = 0")
    store.replace_by_id("messages", new.select(
        "issue_number", "turn", F.concat(F.lit("new "), "body").alias("body")))
    return store.read("messages").select("issue_number", "turn", md5("body").alias("body_md5"))


@query
def delete_by_version(spark, d):
    store = ChunkStore.scratch(spark, tables=DOCS)
    store.write("docs", doc_rows(spark, d))
    store.delete_version("docs", "3.5.4")
    return store.read("docs").select("doc_id", "spark_version", "language")


@query
def delete_by_id(spark, d):
    store = ChunkStore.scratch(spark, tables=MESSAGES)
    store.write("messages", messages(spark, d))
    store.delete_by_id("messages", frame(spark, d, "issue_items").where("state = 'open'").select("issue_number"))
    return store.read("messages").select("issue_number", "turn")


@query
def dedup_chunk_id(spark, d):
    """Documents of equal text have equal ids; the highest document number is kept."""
    c = F.col
    rows = table(spark, d, "documents").select("doc_id", "n_chars", ids.doc_chunk_id(
        F.lit("4.1.0"), F.lit("docs"), F.lit(""), c("text")).alias("chunk_id"))
    return threads.dedup_latest(rows, [-c("doc_id")])


@query
def incremental_since(spark, d):
    return landed.changed_since(table(spark, d, "events"), "ts", SINCE).select("event_id", "event_type", "value")


@query
def table_info(spark, d):
    """Counts of the chunk tables: one left empty, one dropped."""
    store = ChunkStore.scratch(spark)
    store.create_all()
    store.write("code_chunks", code.chunk_code(frame(spark, d, "code_files")))
    store.write("qa_chunks", threads.chunk_qa(qa_messages(spark, d)))
    store.write("issue_chunks", issue_rows(spark, d))
    spark.sql(f"DROP TABLE {store.full_name('chunk_vectors')}")
    return store.row_counts()


@query
def scan_corpus(spark, d):
    """Sources written as text files, found again by ending, read whole, counted by line."""
    root = scratch_path(spark, "corpus")
    files = frame(spark, d, "code_files").select("content", F.col("spark_version").alias("v"))
    files.write.partitionBy("v").option("maxRecordsPerFile", 200).text(f"{root}/core")
    found = scan.scan_files(spark, root, ["core/", "absent/"], [".txt"])
    lines = found.select(F.regexp_extract("file_path", "v=([^/]+)/", 1).alias("spark_version"),
                         F.explode(F.split("content", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("spark_version", "line").agg(F.count(F.lit(1)).alias("n"))


# ---- vectors and search ----

def chunk_facts(spark, d) -> DataFrame:
    return frame(spark, d, "vec_facts").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "source", "spark_version",
        "apis", F.col("score").alias("votes"), F.col("is_accepted").alias("accepted"), "state", "versions")


def held_out(spark, d) -> DataFrame:
    """The benchmark texts as queries of three input types."""
    kind = F.element_at(F.array(*map(F.lit, ("code", "logs", "question"))), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, d, "benchmark").select(
        "item_id", F.col("text").alias("input"), kind.alias("input_type"),
        F.split(F.lit("DataFrame.collect,RDD.map"), ",").alias("request_apis"),
        MODEL.embed(F.col("text")).alias("vec"))


def exact_hits(spark, d, corpus: DataFrame, k: int = rules.TOP_PER_SOURCE) -> DataFrame:
    return search.top_k(held_out(spark, d), corpus, k, query_id="item_id", by=["source"], dim=64)


@query
def embed_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", MODEL.embed(F.col("text")).alias("vec")) \
        .select("doc_id", print_of("vec").alias("vec"))


def text_chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), ids.doc_chunk_id(
        F.lit("4.1.0"), F.lit("docs"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


def filled_vectors(spark, d) -> DataFrame:
    """Vectors of the labelled documents first, then of all still missing, then of none."""
    chunks = text_chunks(spark, d)
    store = ChunkStore.scratch(spark)
    store.create("chunk_vectors")
    labelled = chunks.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    for part in (labelled, chunks, chunks):
        new = vectors.fill_vectors(part, store.read("chunk_vectors"), MODEL)
        store.write("chunk_vectors", new.withColumn("table_name", F.lit("doc_chunks")))
    return store.read("chunk_vectors")


@query
def embed_fill(spark, d):
    return filled_vectors(spark, d).select("chunk_id", "model_column", F.size("vec").alias("dim"),
                                           print_of("vec").alias("vec"))


@query
def merge_embeddings(spark, d):
    """Chunks with their vector as a column, null for documents without a label."""
    chunks = text_chunks(spark, d)
    labelled = chunks.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    own = checkpointed(vectors.embed(labelled, "content", MODEL).select(
        "chunk_id", "vec", F.lit(MODEL.column).alias("model_column")), "vectors")
    merged = vectors.merge_vectors(chunks, vectors.checked_dimension(own, MODEL.dim), MODEL)
    return merged.select(
        "doc_id", "chunk_id", F.coalesce(print_of(MODEL.column), F.lit("")).alias("vec"),
        vectors.is_wrong(MODEL.column, MODEL.dim).alias("is_missing"))


@query
def active_model(spark, d):
    """Two models over the same chunks; the active one is served."""
    small = hashing_model(32, "emb_small")
    registry = serving.model_registry(spark, [MODEL, small], "emb_small")
    texts = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text")
    stored = None
    for model in (MODEL, small):
        part = texts.select("chunk_id", model.embed(F.col("text")).alias("vec"), F.lit(model.column).alias("model_column"))
        stored = part if stored is None else stored.unionByName(part)
    served = stored.join(registry.where("active"), "model_column")
    return served.select("chunk_id", "name", "dim", F.size("vec").alias("vec_dim"), print_of("vec").alias("vec"))


@query
def version_filter(spark, d):
    rows = frame(spark, d, "vec_chunks")
    return rows.where(rank.version_allowed("4.1.0", F.col("source"), F.col("spark_version"))).select(
        "vec_id", "source", "spark_version")


@query
def knn_topk(spark, d):
    return exact_hits(spark, d, chunk_facts(spark, d)).select(
        "item_id", "source", F.col("chunk_id").alias("vec_id"), "sim", "rank")


@query
def filtered_knn(spark, d):
    """Answers with more than ten votes that were accepted, and closed issues."""
    wanted = ((F.col("source") == "qa") & (F.col("votes") > 10) & F.col("accepted")) | \
        ((F.col("source") == "issues") & (F.col("state") == "closed"))
    return exact_hits(spark, d, chunk_facts(spark, d).where(wanted)).select(
        "item_id", "source", F.col("chunk_id").alias("vec_id"), "sim", "rank")


def scored_hits(spark, d) -> DataFrame:
    facts = chunk_facts(spark, d)
    allowed = facts.where(rank.version_allowed("4.1.0", F.col("source"), F.col("spark_version")))
    hits = exact_hits(spark, d, allowed)
    return hits.join(facts.drop("vec", "source"), "chunk_id").join(held_out(spark, d).drop("vec"), "item_id") \
        .withColumn("score", rank.rerank_score(
            F.col("sim"), F.col("input_type"), F.col("source"), F.col("request_apis"), F.col("apis"),
            F.col("votes"), F.col("accepted"), F.col("state"), F.col("versions"), F.lit("4.1.0")))


@query
def rerank(spark, d):
    return scored_hits(spark, d).select("item_id", "source", F.col("chunk_id").alias("vec_id"), "rank",
                                        tx.half_up(F.col("score"), 6).alias("score"))


def merged_hits(spark, d) -> DataFrame:
    return rank.merge_hits(scored_hits(spark, d), key="item_id")


@query
def knn_union(spark, d):
    best = checkpointed(merged_hits(spark, d).select("item_id", "position", "source", "chunk_id", "score"), "merged")
    places = corpora.details_of(best, served_corpus(spark, d)).drop("content", "metadata")
    return best.join(places, ["source", "chunk_id"]).select(
        "item_id", "position", "source", F.col("chunk_id").alias("vec_id"), tx.half_up(F.col("score"), 6).alias("score"),
        *corpora.PLACES)


@query
def hits_by_source(spark, d):
    return rank.hits_by_source(merged_hits(spark, d), "qa").select(
        "item_id", "position", F.col("chunk_id").alias("vec_id"))


@query
def json_contains(spark, d):
    """Served threads whose JSON list names an API."""
    served = threads.chunk_qa(qa_messages(spark, d)).select(
        "question_id", "turn", tx.wrap_list(F.col("spark_apis_mentioned"), "apis").alias("apis"))
    return served.where(F.array_contains(tx.unwrap_list(F.col("apis"), "apis"), "DataFrame.collect"))


def longer(column: str, by: int = 2000) -> Column:
    """A text with a tail that the served limits cut."""
    return F.concat(column, F.lit(" "), F.repeat(F.lit("x"), by))


def chunk_tables(spark, d) -> dict[str, DataFrame]:
    """Chunks of all four kinds, some of their texts and names over the served limits."""
    some = lambda key, k, column, by=2000: F.when(F.col(key) % 97 == k, longer(column, by)).otherwise(F.col(column))
    made = code.chunk_code(frame(spark, d, "unit_files")).withColumns({
        "content": some("p_partkey", 0, "content", 70_000), "qualified_name": some("p_partkey", 1, "qualified_name"),
        "signature": some("p_partkey", 2, "signature")})
    docs = markdown.chunk_documents(frame(spark, d, "md_docs"), example_code(spark, d)).withColumns({
        "doc_url": some("doc_id", 0, "doc_url"), "doc_section": some("doc_id", 2, "doc_section")})
    return {"code_chunks": made, "doc_chunks": docs,
            "qa_chunks": threads.chunk_qa(qa_messages(spark, d)).withColumn("error_type", longer("error_type")),
            "issue_chunks": issue_rows(spark, d).withColumns({c: longer(c) for c in ("state", "author", "created_at", "closed_at")})}


@query
def serving_export(spark, d):
    """The rows to load of all four tables, the versioned ones of one version; each row as its JSON's digest."""
    rows = None
    for name, chunks in chunk_tables(spark, d).items():
        version = "4.1.0" if "spark_version" in chunks.columns else None
        kept = checkpointed(chunks, name)
        own = vectors.fill_vectors(kept.where(F.length("content") % 2 == 0), spark.createDataFrame(
            [], "chunk_id string, vec array<float>, model_column string"), MODEL)
        out = serving.serving_export(name, kept, checkpointed(own, "vectors"), MODEL.column, MODEL.dim, version)
        served = [F.col(c) for c in out.columns if c not in ("content", "embedding")]
        part = out.select(
            F.lit(name).alias("table_name"), md5("content").alias("content_md5"), F.length("content").alias("n_chars"),
            F.to_json(F.struct(*served), {"ignoreNullFields": "false"}).alias("fields"),
            F.coalesce(print_of("embedding"), F.lit("")).alias("embedding"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.withColumn("fields", md5("fields"))


@query
def ann_lsh(spark, d):
    """Approximate neighbours, and whether each is among the exact ones.

    No SQL states random hyperplanes, so there is no oracle for this one.
    """
    queries, corpus = held_out(spark, d), chunk_facts(spark, d)
    found = search.approximate_top_k(queries, corpus, rules.TOP_PER_SOURCE, query_id="item_id",
                                     by=["source"], dim=64, tables=16, bits=4)
    exact = exact_hits(spark, d, corpus).select("item_id", "chunk_id", F.lit(True).alias("in_exact"))
    return found.join(exact, ["item_id", "chunk_id"], "left").select(
        "item_id", "source", F.col("chunk_id").alias("vec_id"), "sim", "rank",
        F.coalesce("in_exact", F.lit(False)).alias("in_exact"))


@query
def ann_index(spark, d):
    """Neighbours by a stored index of cells and sign codes: whether each is among the exact ones,
    how many rows its query scored, and how many there are."""
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    queries = corpus.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "item_id")
    built = index.build_index(corpus, scratch_path(spark, "index"), dim=64, cells=64)
    found = index.probe(built, queries, 10, query_id="item_id", probes=40, agree=136)
    exact = search.top_k(queries, corpus, 10, query_id="item_id", dim=64).select(
        "item_id", "chunk_id", F.lit(True).alias("in_exact"))
    return found.join(exact, ["item_id", "chunk_id"], "left").crossJoin(corpus.agg(F.count("*").alias("n_rows"))).select(
        "item_id", F.col("chunk_id").alias("vec_id"), "sim", "rank", F.coalesce("in_exact", F.lit(False)).alias("in_exact"),
        "n_scored", "n_rows")


# ---- requests ----

def requests(spark, d) -> DataFrame:
    return frame(spark, d, "log_texts").withColumnRenamed("event_id", "request_id")


@query
def expand_queries(spark, d):
    return analyze.expand_queries(analyze.parse_requests(requests(spark, d))).select(
        "request_id", "input_type", "query_no", "query_text")


def served_corpus(spark, d) -> dict[str, corpora.Source]:
    """The four chunk tables, each with its own columns."""
    code = frame(spark, d, "code_served").withColumn("problem_indicators", F.transform(
        F.split("problems", ","), lambda p: F.struct(
            p.alias("name"), F.lit("HIGH").alias("risk"), F.lit("").alias("description"), F.lit(1).alias("line"),
            F.lit("").alias("match_text"))))
    issues = frame(spark, d, "issues_served").withColumn("linked_prs", F.array(F.col("pr").cast("bigint")))
    return {"code": corpora.Source(code), "docs": corpora.Source(frame(spark, d, "docs_served")),
            "qa": corpora.Source(frame(spark, d, "qa_served")), "issues": corpora.Source(issues)}


def answered(rows: DataFrame) -> DataFrame:
    """The answers of each distinct request as they are returned, texts by their digests."""
    return plain(rows.select(
        "search_id", "input_type", pt.pattern_names(F.col("patterns")).alias("patterns"), "error_types",
        "version", "position", "source", F.col("chunk_id").alias("vec_id"), md5("content").alias("content_md5"),
        "score", "metadata", *corpora.PLACES))


@query
def analyze_batch(spark, d):
    return analyze.analyze_batch(requests(spark, d), served_corpus(spark, d), MODEL, shape=answered)


@query
def analyze_two_sources(spark, d):
    """Threads and code alone; the tables of the other sources are not opened."""
    corpus = served_corpus(spark, d)
    return analyze.analyze_batch(requests(spark, d), corpus, MODEL, sources=["qa", "code"], shape=answered)


@query
def analyze_all_queries(spark, d):
    """Requests of three versions, every added query searched, own weights; blank inputs are rejected."""
    asked = requests(spark, d).select(
        "request_id", F.when(F.col("request_id") % 10 == 0, "  ").otherwise(F.col("input")).alias("input"),
        F.element_at(F.array(*map(F.lit, ("all", "3.5.4", ""))), (F.col("request_id") % 3 + 1).cast("int")).alias("version"))
    own = {"code": {"code": 0.9, "docs": 0.05}, "logs": {"qa": 0.7, "issues": 0.6}}
    return analyze.analyze_batch(asked, served_corpus(spark, d), MODEL, multi_query=True, weights=own, shape=answered)


@query
def rejected_requests(spark, d):
    """Requests without an input."""
    asked = requests(spark, d).select("request_id", F.when(F.col("request_id") % 10 == 0, " \t\u2003").when(
        F.col("request_id") % 10 == 1, F.lit(None)).otherwise(F.col("input")).alias("input"))
    return analyze.split_requests(asked)[1].select("request_id", F.coalesce(F.length("input"), F.lit(-1)).alias("n_chars"))


@query
def build_context(spark, d):
    """Answering contexts of the benchmark texts."""
    asked = held_out(spark, d).select(F.col("item_id").alias("request_id"), "input", "input_type",
                                      pt.detect_patterns(F.col("input")).alias("patterns"))
    best = checkpointed(merged_hits(spark, d).select("item_id", "position", "source", "chunk_id"), "merged")
    shown = best.withColumnRenamed("item_id", "request_id").join(
        corpora.details_of(best, served_corpus(spark, d)), ["source", "chunk_id"])
    return context.build_context(asked, shown).select(
        "request_id", F.length("context").alias("n_chars"), md5("context").alias("context_md5"))


# ---- evaluation and cross-source ----

def label_centres(spark, d) -> DataFrame:
    """One query per label: the mean of its vectors."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").alias("query_label")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("vec")) \
        .withColumn("query_id", F.col("query_label").cast("bigint"))


def judged_hits(spark, d):
    corpus = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")
    queries = checkpointed(label_centres(spark, d), "centres")
    hits = checkpointed(search.top_k(queries, corpus, 50, dim=64), "hits")
    return hits, queries.drop("vec"), corpus.drop("vec")


@query
def recall_at_k(spark, d):
    return evaluate.recall_at(*judged_hits(spark, d))


@query
def mrr(spark, d):
    judged = judged_hits(spark, d)
    means = evaluate.summary(evaluate.recall_at(*judged), evaluate.reciprocal_rank(*judged))
    return means.select("n_queries", *[F.round(c, 6).alias(c) for c in ("recall_10", "recall_50", "mrr")])


@query
def evaluate_models(spark, d):
    """Two embedders on held-out documents of each source; documents of the same language are relevant."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    scores = evaluate.compare_models(docs, [MODEL, hashing_model(16, "emb_small")], id="doc_id", text="text", label="lang", dataset="source")
    return scores.select("model", "dataset", "n_queries", *[F.round(c, 6).alias(c) for c in ("recall_10", "recall_50", "mrr")])


@query
def corpus_stats(spark, d):
    return stats.corpus_stats(table(spark, d, "documents"), "lang", "source", content="text")


@query
def cross_source_version(spark, d):
    return stats.versions_across(code=frame(spark, d, "code_files"), docs=frame(spark, d, "md_docs"))


@query
def cross_source_api(spark, d):
    """Threads and the code units that use an API they mention."""
    units = code.chunk_code(frame(spark, d, "code_files")).select(F.explode("spark_apis").alias("qualified_name"))
    return stats.threads_to_code(threads.chunk_qa(qa_messages(spark, d)), units)


# ---- incremental ----

def newest_first() -> list[Column]:
    return [-F.unix_micros("ts"), -F.col("event_id")]


def latest_events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"),
                                            "event_type", "value")


@query
def hwm_sync(spark, d):
    """Events up to the middle of the time span first, then whatever is newer."""
    events = latest_events(spark, d)
    store = ChunkStore.scratch(spark, tables=LATEST)
    store.create("latest")
    middle = events.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2))).first()[0]
    sync.sync_newer(store, "latest", events.where(F.col("ts") <= F.lit(middle)), "ts", newest_first())
    sync.sync_newer(store, "latest", events, "ts", newest_first())
    return store.read("latest").select("user_id", "event_id", "event_type", "value")


@query
def stream_upsert(spark, d):
    """Events landed as files, streamed in micro-batches, then streamed again."""
    events = latest_events(spark, d)
    landing, progress = scratch_path(spark, "landing"), scratch_path(spark, "progress")
    store = ChunkStore.scratch(spark, tables=LATEST)
    events.repartition(4).write.parquet(landing)
    sync.stream_upsert(store, "latest", landing, events.schema, newest_first(), progress, max_files=2)
    sync.stream_upsert(store, "latest", landing, events.schema, newest_first(), progress, max_files=2)
    return store.read("latest").select("user_id", "event_id", "event_type", "value")
