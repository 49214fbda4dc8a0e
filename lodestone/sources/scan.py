"""Scans: stored tables, corpus files, example code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.rules import EXAMPLE_ENDINGS
from ..session import path_exists


# a scan of this many splits or more is left as it is
SPREAD_BELOW = 32


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table, spread over the cores when its files give only a few tasks."""
    return spread(spark.read.parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a scan of a few splits so that text work uses all cores.

    The bound is on the splits, so what is shuffled here never exceeds a few
    gigabytes; a larger scan keeps its own partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < min(cores, SPREAD_BELOW) else df


def scan_files(spark: SparkSession, root: str, paths: Sequence[str], endings: Sequence[str],
               recursive: bool = True) -> DataFrame:
    """Files below ``root/path`` with one of the endings: ``file_path``, ``content``.

    Bytes that are not UTF-8 are replaced, unreadable files skipped, and so are
    paths that do not exist. ``file_path`` is relative to ``root``.
    """
    suffixes = ",".join(e.lstrip("*") for e in endings)
    base = root.rstrip("/")
    existing = [p for p in (f"{base}/{x.strip('/')}" for x in paths) if path_exists(spark, p)]
    if not existing:
        return spark.createDataFrame([], "file_path string, content string")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", f"*{{{suffixes}}}")
        .option("ignoreCorruptFiles", "true")
        .load(existing)
    )
    return files.select(relative_path(F.col("path"), base).alias("file_path"),
                        F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def relative_path(path: Column, base: str) -> Column:
    plain = base.split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))),
                            "^.*?" + _literal(plain) + "/", "")


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def scan_docs(spark: SparkSession, root: str, paths: Sequence[str]) -> DataFrame:
    """Markdown files directly in the given folders."""
    return scan_files(spark, root, paths, [".md"], recursive=False)


def example_lookup(spark: SparkSession, root: str, examples: str) -> DataFrame:
    """Example code by key: ``key``, ``code``.

    A file answers to its path below the root, and to its path below the examples
    folder, which is how tags name it.
    """
    files = scan_files(spark, root, [examples], EXAMPLE_ENDINGS)
    below = F.regexp_replace("file_path", "^" + _literal(examples.strip("/")) + "/", "")
    return files.select(F.explode(F.array_distinct(F.array("file_path", below))).alias("key"),
                        F.col("content").alias("code"))
