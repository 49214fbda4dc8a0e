"""Greedy packing of lines and paragraphs into bounded pieces, inside one row.

One fold per text: no shuffle and no line table. The fold's state is
(finished pieces, open piece, its counted length); the open piece is null when empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import MAX_CHUNK_CHARS

_STATE = "struct<done:array<string>,open:string,n:bigint>"


def _start() -> Column:
    return F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).cast("bigint").alias("n"),
    )


def _state(done: Column, open_: Column, n: Column) -> Column:
    return F.struct(done.alias("done"), open_.alias("open"), n.cast("bigint").alias("n"))


def _closed(acc: Column) -> Column:
    return F.when(acc["open"].isNull(), acc["done"]).otherwise(
        F.concat(acc["done"], F.array(acc["open"])))


def _add(acc: Column, part: Column, sep: str, limit: int) -> Column:
    width = F.length(part)
    full = acc["open"].isNotNull() & (acc["n"] + width > limit)
    return (
        F.when(full, _state(_closed(acc), part, width + len(sep)))
        .otherwise(_state(
            acc["done"],
            F.when(acc["open"].isNull(), part).otherwise(F.concat(acc["open"], F.lit(sep), part)),
            acc["n"] + width + len(sep)))
    )


def pack_lines(text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Pieces of whole lines, each at most ``limit`` long unless one line is longer."""
    return F.aggregate(F.split(text, "\n"), _start(),
                       lambda acc, line: _add(acc, line, "\n", limit), _closed)


def pack_paragraphs(text: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Pieces of whole paragraphs; a paragraph over the limit is packed by lines."""
    def step(acc: Column, part: Column) -> Column:
        oversized = _state(F.concat(_closed(acc), pack_lines(part, limit)),
                           F.lit(None).cast("string"), F.lit(0))
        return F.when(F.length(part) > limit, oversized).otherwise(_add(acc, part, "\n\n", limit))

    packed = F.aggregate(F.split(text, "\n\n"), _start(), step, _closed)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(packed)
