"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpointed, scratch_path

__all__ = ["ascii_lower", "checkpointed", "fold", "fresh", "part_count", "scratch_path", "small", "table"]

#: bytes that a broadcast side may have
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII only take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, LOWER))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame doesn't have."""
    taken = {c.lower() for c in df.columns}
    return name if name.lower() not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def small(df: DataFrame, room: Column) -> DataFrame:
    """A written table, to be broadcast if its rows, of ``room`` bytes each, measure little in all.

    Larger ones are joined by a shuffle; the answer is the same.
    """
    total = df.agg(F.sum(room.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]
