"""Landed API items as JSON lines: questions and issues."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

QUESTION = """question_id bigint, title string, body string, score bigint, tags array<string>,
  answer_count int, last_activity_date bigint,
  answers array<struct<answer_id:bigint,body:string,score:bigint,is_accepted:boolean>>"""
ISSUE = """number bigint, title string, body string, state string, user struct<login:string>,
  labels array<struct<name:string>>, milestone struct<title:string>, created_at string,
  closed_at string, updated_at string, comments int, pull_request struct<url:string>,
  comments_data array<struct<body:string,user:struct<login:string>,created_at:string>>"""


def moment(since: str):
    """A date or time of ISO format as a timestamp; without a zone it is UTC."""
    at = datetime.fromisoformat(since)
    return F.lit(at if at.tzinfo else at.replace(tzinfo=timezone.utc))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ISSUE).json(path)


def select_questions(items: DataFrame, tags: Sequence[str] = (), since: str | None = None,
                     most: int | None = None) -> DataFrame:
    """Answered questions with all the tags, newest activity first."""
    kept = items.where(F.col("answer_count") > 0)
    for tag in tags:
        kept = kept.where(F.array_contains("tags", tag))
    if since:
        kept = kept.where(F.col("last_activity_date") >= F.unix_timestamp(moment(since)))
    newest = kept.orderBy(F.desc("last_activity_date"), "question_id")
    return newest.limit(most) if most else newest


def select_issues(items: DataFrame, state: str = "all", since: str | None = None,
                  most: int | None = None) -> DataFrame:
    """Issues that are no pull requests, last updated first."""
    kept = items.where(F.col("pull_request").isNull())
    if state != "all":
        kept = kept.where(F.col("state") == state)
    if since:
        kept = kept.where(F.try_to_timestamp("updated_at") >= moment(since))
    newest = kept.orderBy(F.desc(F.try_to_timestamp("updated_at")), "number")
    return newest.limit(most) if most else newest


def changed_since(df: DataFrame, column: str, since: str) -> DataFrame:
    """Rows changed after a date; times without a zone are compared as written."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return df.where(F.col(column) > F.lit(since).cast("timestamp_ntz"))
    return df.where(F.col(column) > moment(since))
