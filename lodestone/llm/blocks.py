"""Corpus statistics exchanged between blocks of documents and owners of key ranges.

Documents are staged once into blocks of a few megabytes, bucketed by block, so that
every later pass reads a block's texts in place and only compact arrays are shuffled. In
a round each block sends its distinct keys, cut by key range; the owner of a range sees
each key once per block, however frequent it is, and answers every block with an array
in the order of its keys.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, quoted, scratch_path

BLOCK_BYTES = 4 << 20
#: the key ranges' share of text: an owner holds the keys of about so many bytes of text
RANGE_BYTES = 64 << 20
MOST_BUCKETS = 20_000
SENT = "part int, block bigint, payload binary"


@dataclass
class Staged:
    """``rows``: ``block``, ``doc_id``, ``body`` (bytes) and ``mark``, in a bucketed table.

    The first ``apart`` blocks hold the rows of the mark set apart, and no others.
    """
    rows: DataFrame
    blocks: int
    ranges: int
    apart: int = 0


def stage(docs: DataFrame, id: str, text: str, mark: Column | None = None, block_bytes: int = BLOCK_BYTES,
          range_bytes: int = RANGE_BYTES, apart: int | None = None) -> Staged:
    """Write texts (null: empty) into blocks. The table stays in the shared folder.

    Rows whose mark is ``apart`` get blocks of their own, for passes that ask for them alone.
    """
    spark = docs.sparkSession
    key, content = quoted([id, text])
    rows = docs.select(key.alias("doc_id"), F.coalesce(content, F.lit("")).cast("binary").alias("body"),
                       (F.lit(0) if mark is None else mark).cast("int").alias("mark"))
    # a row counts for some bytes besides its text
    room, alone = F.octet_length("body") + 32, F.col("mark").eqNullSafe(F.lit(apart).cast("int")) if apart is not None else F.lit(False)
    sums = rows.agg(F.sum(room).alias("all"), F.sum(F.when(alone, room)).alias("apart")).first()
    total, own = sums["all"] or 0, sums["apart"] or 0
    first, others = math.ceil(own / block_bytes), math.ceil((total - own) / block_bytes)
    blocks = max(1, first + others)
    buckets = min(blocks, MOST_BUCKETS)
    name = f"staged_{uuid.uuid4().hex}"
    drawn = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.withColumn("block", F.when(alone, F.pmod(drawn, F.lit(max(1, first))))
                            .otherwise(first + F.pmod(drawn, F.lit(max(1, others)))).cast("bigint"))
    dealt.repartition(buckets, "block").write.bucketBy(buckets, "block").format("parquet") \
        .option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(name)
    return Staged(spark.table(name), blocks, max(24, math.ceil(total / range_bytes)), first)


@dataclass
class Block:
    """The documents of a block, in a fixed order: their ids, bytes end to end, bounds and marks."""
    ids: list
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    marks: np.ndarray


def opened(table: pa.Table) -> Block:
    rows = sorted(zip(table["doc_id"].to_pylist(), table["body"].to_pylist(), table["mark"].to_pylist()),
                  key=lambda r: (r[0] is None, r[0], r[1]))
    sizes = np.array([len(r[1]) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    return Block([r[0] for r in rows], np.frombuffer(b"".join(r[1] for r in rows), np.uint8), ends - sizes, ends,
                 np.array([r[2] for r in rows], np.int64))


def cut(hi: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the key ranges in a sorted array of 64-bit keys."""
    firsts = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hi, firsts), [len(hi)]])


def sent(block: int, hi: np.ndarray, ranges: int, payload: Callable[[slice], bytes]) -> pa.Table:
    """One row for each key range that has keys."""
    at = cut(hi, ranges)
    parts = [k for k in range(ranges) if at[k] < at[k + 1]]
    return pa.table({"part": pa.array(parts, pa.int32()), "block": pa.array([block] * len(parts), pa.int64()),
                     "payload": pa.array([payload(slice(at[k], at[k + 1])) for k in parts], pa.binary())})


def with_kept(asked: pa.Table, block: int, kept: bytes) -> pa.Table:
    """What a block sends in a round, and what it keeps for itself until the next ones."""
    own = pa.table({"part": pa.array([-1 - block], pa.int32()), "block": pa.array([block], pa.int64()),
                    "payload": pa.array([kept], pa.binary())})
    return pa.concat_tables([asked, own])


def round_of(staged: Staged, send: Callable[[int, Block, dict], pa.Table],
             answer: Callable[[list[bytes]], list[bytes]], earlier: DataFrame | None, kind: str) -> DataFrame:
    """One round; returns the answers so far, as ``block``, ``kind``, ``part``, ``payload``.

    ``send`` gets a block and the answers of earlier rounds by kind, in key order;
    ``answer`` gets what a range's blocks sent and answers each. What a block keeps comes back as ``kind`` kept.
    """
    asked = per_block(staged, earlier, send, SENT)

    def own(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return pa.table({"block": table["block"], "kind": pa.array([f"{kind} kept"] * table.num_rows, pa.string()),
                             "part": table["part"], "payload": table["payload"]})
        table = table.sort_by("block")
        replies = answer(table["payload"].to_pylist())
        return pa.table({"block": table["block"], "kind": pa.array([kind] * table.num_rows, pa.string()),
                         "part": table["part"], "payload": pa.array(replies, pa.binary())})

    replies = checkpointed(asked.groupBy("part").applyInArrow(own, "block bigint, kind string, part int, payload binary"),
                           f"round-{kind}")
    return replies if earlier is None else earlier.unionByName(replies)


def per_block(staged: Staged, answers: DataFrame | None, fn: Callable[[int, Block, dict], pa.Table],
              schema: str) -> DataFrame:
    """``fn`` over every block with its answers."""
    if answers is None:
        return staged.rows.groupBy("block").applyInArrow(
            lambda t: fn(t["block"][0].as_py(), opened(t), {}), schema)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        got: dict = {}
        for k, p in zip(right["kind"].to_pylist(), right["payload"].to_pylist()):
            got.setdefault(k, []).append(p)
        return fn(left["block"][0].as_py(), opened(left), got)

    return staged.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def bits_of(payloads: list[bytes], n: int) -> np.ndarray:
    """Answers of one bit per key: the length of each comes first."""
    out = [np.unpackbits(np.frombuffer(p, np.uint8, offset=4), count=int.from_bytes(p[:4], "little")).astype(bool)
           for p in payloads]
    got = np.concatenate(out) if out else np.zeros(0, bool)
    assert len(got) == n, "answers don't fit the block"
    return got


def to_bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(4, "little") + np.packbits(flags).tobytes()


def split(values: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    at = 0
    for n in sizes:
        yield values[at:at + n]
        at += n
