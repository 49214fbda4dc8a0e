"""Exact duplicates through an extendible-hash index on shared files.

A directory addresses buckets by the leading bits of a 64-bit hash of the text. It
doubles until no bucket holds more than ``bucket_keys`` different hashes; buckets that
were never overfull keep fewer bits and stand behind several directory cells. Each
bucket is a range of hash values with one owner task. The owner gets the texts of its
range, already collapsed per input batch, compares their bytes, chains different texts
of one hash, and writes index entries to the shared folder. Documents then find their
entry by hash and digest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, checkpointed, quoted

DEEPEST = 62
#: directory cells that are broadcast at most: a few dozen MB
BROADCAST_CELLS = 1 << 20


def cell_of(h: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("bigint")


def build_directory(keys: DataFrame, bucket_keys: int) -> tuple[DataFrame, int]:
    """Directory of the hashes in ``keys.h`` and its depth: ``cell``, ``bucket``, ``local_depth``.

    Hashes are distinct, so that doubling ends; ``bucket`` is the first cell of the
    bucket. Only one count per doubling comes to the driver.
    """
    depth = 0
    while True:
        cells = keys.groupBy(cell_of(F.col("h"), depth).alias("cell")).agg(F.count("*").alias("n"))
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= bucket_keys or depth >= DEEPEST:
            break
        depth = min(DEEPEST, depth + max(1, math.ceil(math.log2(fullest / bucket_keys))))
    cells = checkpointed(cells, "directory-cells")
    # a cell's bucket is its widest ancestor that isn't overfull
    levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth")) \
        .withColumn("up", F.expr(f"shiftrightunsigned(cell, {depth} - local_depth)"))
    fits = levels.groupBy("local_depth", "up").agg(F.sum("n").alias("n")) \
        .where((F.col("n") <= bucket_keys) | (F.col("local_depth") == depth))
    widest = levels.join(fits.drop("n"), ["local_depth", "up"]).groupBy("cell") \
        .agg(F.min("local_depth").alias("local_depth"))
    bucket = F.expr(f"shiftleft(shiftrightunsigned(cell, {depth} - local_depth), {depth} - local_depth)")
    return checkpointed(widest.select("cell", bucket.alias("bucket"), "local_depth"), "directory"), depth


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row with the largest id and the count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        done = pa.Table.from_batches([batch]).group_by(["h", "body"]) \
            .aggregate([("id", "max"), ("n", "sum")]).rename_columns(["h", "body", "id", "n"])
        yield from done.cast(batch.schema).to_batches()


def dedup_exact(docs: DataFrame, id: str = "doc_id", text: str = "text",
                bucket_keys: int = 4096, hash_bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with
    the largest id stays. Null texts count as empty, and empty texts are equal to each
    other. Rows that repeat a text and an id have the same answer. A null id is kept only
    if its text has no row with an id. An empty table gives no rows; other columns are
    not read. ``hash_bits`` weakens the hash, to make collisions in tests.

    A text that fills a third of all rows reaches its owner once per input batch, and its
    documents meet their entry in a join that adaptive execution can split.
    """
    key, content = quoted([id, text])
    rows = docs.select(key.alias("id"), ascii_lower(F.coalesce(content, F.lit(""))).alias("body"))
    h = F.xxhash64("body")
    if hash_bits < 64:
        h = F.shiftleft(F.shiftrightunsigned(h, 64 - hash_bits), 64 - hash_bits)
    hashed = rows.withColumn("h", h)
    keys = checkpointed(hashed.select("h").distinct(), "index-keys")
    directory, depth = build_directory(keys, bucket_keys)
    if depth <= BROADCAST_CELLS.bit_length() - 1:
        directory = F.broadcast(directory)

    schema = f"h bigint, body string, id {docs.schema[id].dataType.simpleString()}, n bigint"
    entries = hashed.select("h", "body", "id", F.lit(1).cast("bigint").alias("n")) \
        .mapInArrow(_collapse, schema) \
        .withColumn("cell", cell_of(F.col("h"), depth)).join(directory, "cell")
    owned = entries.repartition("bucket").groupBy("bucket", "h", "body") \
        .agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    chained = owned.select("bucket", "h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size") \
        .withColumn("link", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")))
    index = checkpointed(chained, "index")

    probes = hashed.select("id", "h", F.sha2("body", 256).alias("text_sha256"))
    found = probes.join(index.select("h", "text_sha256", "keep_id", "group_size"), ["h", "text_sha256"])
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
