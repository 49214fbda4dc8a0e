"""Deterministic chunk ids: UUIDv5 and content hash as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the namespace all chunk ids are derived from.
NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of ``name``, as text."""
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(prefix, F.encode(name, "UTF-8")))
    # the variant digit keeps its two low bits and gets binary 10 above them
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12),
    )


def _key(*parts: Column) -> Column:
    return uuid5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def code_chunk_id(version: Column, path: Column, name: Column, start_line: Column) -> Column:
    return _key(version, path, name, start_line)


def doc_chunk_id(version: Column, url: Column, section: Column, content: Column) -> Column:
    return _key(version, url, section, content_hash(content))


def qa_chunk_id(question_id: Column, is_question: Column, content: Column) -> Column:
    return _key(F.lit("so"), question_id, F.when(is_question, "q").otherwise("a"),
                content_hash(content))


def issue_chunk_id(number: Column, is_comment: Column, author: Column, content: Column) -> Column:
    return _key(F.lit("issue"), number, F.when(is_comment, "comment").otherwise("body"),
                author, content_hash(content))
