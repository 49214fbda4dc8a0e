"""Question threads and issues to chunks.

Both read one row per message, so a thread of any length is spread over tasks;
``from_nested`` forms turn API-shaped items into such rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as pt, text as tx
from ..functions.ids import issue_chunk_id, qa_chunk_id


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def qa_messages(items: DataFrame) -> DataFrame:
    """Question items with nested answers to one row per message."""
    question = F.struct(
        F.lit(True).alias("is_question"), F.col("title").alias("title"), F.col("body").alias("body"),
        F.col("score").cast("bigint").alias("score"), F.lit(False).alias("is_accepted"))
    answers = F.transform(F.coalesce("answers", F.filter("answers", lambda _: F.lit(False))), lambda a: F.struct(
        F.lit(False).alias("is_question"), F.lit(None).cast("string").alias("title"),
        a["body"].alias("body"), a["score"].cast("bigint").alias("score"),
        F.coalesce(a["is_accepted"], F.lit(False)).alias("is_accepted")))
    messages = F.concat(F.array(question), F.coalesce(answers, F.filter(F.array(question), lambda _: F.lit(False))))
    return items.select("question_id", tx.as_list(F.col("tags")).alias("tags"), F.inline(messages))


def chunk_qa(messages: DataFrame) -> DataFrame:
    """Chunks of thread messages.

    ``messages``: question_id, is_question, title, body (HTML), score, is_accepted,
    tags. The question's text is its title, a blank line and its body.
    """
    body = tx.html_to_text(_text(F.col("body")))
    content = F.when(F.col("is_question"), F.concat(_text(F.col("title")), F.lit("\n\n"), body)) \
        .otherwise(body)
    extra = [c for c in messages.columns
             if c not in ("question_id", "is_question", "title", "body", "score", "is_accepted", "tags")]
    texts = messages.select(
        *extra, "question_id", "is_question", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"),
        (F.col("is_accepted") & ~F.col("is_question")).alias("is_accepted"), "tags",
        tx.let(content, lambda c: F.struct(
            c.alias("content"), tx.first_error(c).alias("error_type"),
            pt.api_names(pt.detect_apis(c)).alias("spark_apis_mentioned"),
            tx.version_mentions(c).alias("spark_versions_mentioned"),
            qa_chunk_id(F.col("question_id"), F.col("is_question"), c).alias("chunk_id"))).alias("_row"))
    return texts.select("*", "_row.*").drop("_row")


def attach_comments(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Issue bodies and comments as one message table, without nesting comments.

    ``issues``: number, title, body, state, author, labels, milestone, created_at,
    closed_at, and optionally comments (a count). ``comments``: number, body, author,
    created_at. Comments of unknown issues are dropped, and so are those of an issue
    whose count is not above zero, as nothing would have been fetched for it.
    """
    head = ["number", "state", "labels"]
    bodies = issues.select(*head, F.lit(False).alias("is_comment"), "title", "body", "author",
                           "milestone", "created_at", "closed_at")
    with_comments = issues.where(F.col("comments") > 0) if "comments" in issues.columns else issues
    comments = comments.select("number", "body", "author", "created_at")
    answers = comments.join(with_comments.select(*head), "number").select(
        *head, F.lit(True).alias("is_comment"), F.lit(None).cast("string").alias("title"), "body",
        "author", F.lit(None).cast("string").alias("milestone"), "created_at",
        F.lit(None).cast("string").alias("closed_at"))
    return bodies.unionByName(answers)


def issue_messages(items: DataFrame) -> DataFrame:
    """API-shaped issues with nested comments to one row per message."""
    labels = F.transform("labels", lambda x: x["name"])
    body = F.struct(
        F.lit(False).alias("is_comment"), F.col("title"), F.col("body"),
        F.col("user.login").alias("author"), F.col("milestone.title").alias("milestone"),
        F.col("created_at"), F.col("closed_at"))
    empty = F.lit(None).cast("string")
    answers = F.transform("comments_data", lambda c: F.struct(
        F.lit(True).alias("is_comment"), empty.alias("title"), c["body"].alias("body"),
        c["user"]["login"].alias("author"), empty.alias("milestone"),
        c["created_at"].alias("created_at"), empty.alias("closed_at")))
    none = F.filter(F.array(body), lambda _: F.lit(False))
    return items.select("number", F.coalesce("state", F.lit("open")).alias("state"),
                        tx.as_list(labels).alias("labels"),
                        F.inline(F.concat(F.array(body), F.coalesce(answers, none))))


def chunk_issues(messages: DataFrame) -> DataFrame:
    """Chunks of issue messages.

    Comments carry the issue's state and labels; versions from labels and milestone
    count for the body only.
    """
    is_body = ~F.col("is_comment")
    content = F.when(is_body, F.concat(_text(F.col("title")), F.lit("\n\n"), _text(F.col("body")))) \
        .otherwise(_text(F.col("body")))
    known = ("number", "state", "labels", "is_comment", "title", "body", "author", "milestone",
             "created_at", "closed_at")
    extra = [c for c in messages.columns if c not in known]
    texts = messages.select(
        *extra, F.col("number").alias("issue_number"), "state", "is_comment",
        F.col("number").alias("parent_issue_number"), _text(F.col("author")).alias("author"),
        "labels", "milestone", _text(F.col("created_at")).alias("created_at"),
        F.when(is_body, _text(F.col("closed_at"))).otherwise("").alias("closed_at"),
        tx.let(content, lambda c: F.struct(
            c.alias("content"),
            F.when(is_body, tx.all_versions(F.col("labels"), F.col("milestone"), c))
            .otherwise(tx.version_mentions(c)).alias("spark_versions_mentioned"),
            tx.pr_refs(c).alias("linked_prs"),
            issue_chunk_id(F.col("number"), F.col("is_comment"), _text(F.col("author")), c)
            .alias("chunk_id"))).alias("_row"))
    return texts.select("*", "_row.*").drop("_row", "milestone")


def dedup_latest(chunks: DataFrame, order_by: list[Column], key: str = "chunk_id") -> DataFrame:
    """One row per key, the first in ``order_by``.

    ``max_by`` combines before the shuffle, so copies of one key, however many,
    reach the reducer as one row per task.
    """
    columns = [c for c in chunks.columns if c != key]
    row = F.struct(*columns)
    kept = chunks.groupBy(key).agg(F.min_by(row, F.struct(*order_by)).alias("_row"))
    return kept.select(key, "_row.*").select(*chunks.columns)
