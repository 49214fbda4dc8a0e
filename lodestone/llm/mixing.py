"""Mixing sources to target weights by a Pfair schedule.

Target weights are whole parts ``a`` of ``Q = sum(a)`` slots. Block ``j`` of a source is
released at slot ``floor(j*Q/a)`` and due by ``ceil((j+1)*Q/a)``; the earliest deadline
among the released blocks takes each slot, so that after every slot each source is less
than one block from its share. The schedule repeats after ``Q`` slots: it is worked out
for one period, and block ``j`` finds its slot by division. Its place among the blocks
that exist is a sum of whole numbers over the sources if these and the slots are few;
otherwise the blocks are numbered by their slots, range by range. No task sees all blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import fresh, quoted

#: slots times sources up to which a counter for each is broadcast; the answer is the same
MOST_COUNTERS = 1_000_000


def picks(parts: list[int]) -> Iterator[int]:
    """The source of each slot in one period, by earliest deadline among released blocks."""
    period = sum(parts)
    waiting = [(0, i, 0) for i in range(len(parts))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[i]), i, j))
        _, i, j = heapq.heappop(ready)
        yield i
        heapq.heappush(waiting, ((j + 1) * period // parts[i], i, j + 1))


def pfair(parts: list[int]) -> list[int]:
    """The sources of all slots in one period."""
    return list(picks(parts))


def tempered_parts(counts: Mapping[str, int], levels: int = 64) -> dict[str, int]:
    """Parts in proportion to the square root of a source's rows, 1 to ``levels + 1``."""
    top = max(counts.values(), default=1)
    return {s: 1 + math.floor(levels * math.sqrt(n / top)) for s, n in counts.items()}


def _label(source: Column) -> Column:
    """A source as a key that isn't null and keeps null apart from any text."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def numbered(docs: DataFrame, order: Column, cell_rows: int = 50_000) -> DataFrame:
    """``docs`` (with a column ``src``) plus ``nth``: a row's place in its source, from 0.

    Rows are put in order of a hash text. Its leading digits cut a source into cells, so
    that a source with a third of all rows is numbered by many tasks.
    """
    digits = max(1, math.ceil(math.log(max(docs.count(), 1) / cell_rows + 1, 16)) + 1)
    rows = docs.withColumn("at", order).withColumn("cell", F.substring("at", 1, digits))
    sizes = rows.groupBy("src", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("src", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("src", "cell").orderBy("at", "rank_key"))
    return rows.withColumn("own", own).join(starts, ["src", "cell"]) \
        .withColumn("nth", F.col("start") + F.col("own") - 1).drop("at", "cell", "own", "start")


def _by_counters(spark: SparkSession, rows: DataFrame, names: list[str], a: list[int], blocks: list[int]) -> DataFrame:
    """``rows`` (``src``, ``block``) plus ``p``: the sum over sources of the blocks before, by a broadcast."""
    served, plan = [0] * len(names), []
    for i in picks(a) if names else ():
        plan.append((names[i], served[i], list(served)))
        served[i] += 1
    schedule = spark.createDataFrame(plan, "src string, turn bigint, ahead array<bigint>")
    turns = F.create_map(*[F.lit(x) for pair in zip(names, a) for x in pair]) if names else F.create_map()
    rows = rows.withColumn("of", turns[F.col("src")] if names else F.lit(1)) \
        .withColumn("turn", (F.col("block") % F.col("of")).cast("bigint")) \
        .withColumn("period", F.floor(F.col("block") / F.col("of")))
    each = F.arrays_zip(F.col("ahead"), F.array(*[F.lit(x).cast("bigint") for x in a]).alias("a"),
                        F.array(*[F.lit(x).cast("bigint") for x in blocks]).alias("n"))
    earlier = F.aggregate(each, F.lit(0).cast("bigint"), lambda acc, x: acc + F.least(
        x["n"], F.col("period") * x["a"] + x["ahead"]))
    return rows.join(F.broadcast(schedule), ["src", "turn"]).withColumn("p", earlier + 1)


def _by_slots(spark: SparkSession, rows: DataFrame, names: list[str], a: list[int], blocks: list[int],
              cell_slots: int = 50_000, stretch: int = 10_000) -> DataFrame:
    """The same ``p`` for any number of sources and slots: blocks numbered in order of their slots.

    The schedule has one short row for each slot. Slots of all periods end to end are cut
    into cells, whose counts are summed up.
    """
    period = sum(a)
    pick = np.fromiter(picks(a), np.int32, period)
    order = np.argsort(pick, kind="stable")  # by source, in order of slots
    sizes = np.array(a, np.int64)
    turn = np.arange(period) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    schedule = spark.createDataFrame(pa.table({"i": pick[order], "turn": turn, "slot": order.astype(np.int64)}))
    sources = spark.createDataFrame(pa.table({"i": pa.array(range(len(names)), pa.int32()), "src": names,
                                              "a": pa.array(a, pa.int64()), "blocks": pa.array(blocks, pa.int64())}))
    every = sources.select("i", "src", "a", "blocks", F.explode(F.expr(f"sequence(0L, blocks - 1, {stretch}L)")).alias("low")) \
        .repartition("i", "low") \
        .select("i", "src", "a", F.explode(F.expr(f"sequence(low, least(low + {stretch}L, blocks) - 1)")).alias("block"))
    placed = every.withColumn("turn", F.col("block") % F.col("a")).join(schedule, ["i", "turn"]) \
        .withColumn("at", F.expr("block div a") * F.lit(period).cast("bigint") + F.col("slot")) \
        .withColumn("cell", F.expr(f"at div {max(cell_slots, period)}L")).select("src", "block", "at", "cell")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("cell").agg(F.count("*").alias("n")) \
        .select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("cell").orderBy("at"))
    places = placed.withColumn("own", own).join(starts, "cell").select("src", "block", (F.col("start") + F.col("own")).alias("p"))
    return rows.join(places, ["src", "block"])


def mix(docs: DataFrame, parts: Mapping[str | None, int] | None = None, id: str = "doc_id",
        source: str = "source", block_rows: int = 8) -> DataFrame:
    """All rows of ``docs`` with ``mix_position`` and ``mix_row`` (other names if taken).

    ``mix_position`` numbers the blocks of the mixture from 1 without gaps, ``mix_row``
    the rows of a block from 0; sorting by both gives the mixture. Blocks hold
    ``block_rows`` rows of one source, the last one maybe fewer. ``parts`` names the
    target weights as whole parts; sources that it lacks get one part, and without it
    parts follow the square root of the row counts. A null source is a source of its own.

    While all sources last, each is less than one block from its share at every position.
    A source that runs out leaves its slots to the others, which keep their order and so
    the proportions among them. Rows are ordered within a source by the MD5 of their id;
    repeated ids follow each other. No row is dropped. An empty table stays empty. The
    driver works out one period, with a few numbers for each slot and source.
    """
    if block_rows < 1 or any(p < 1 for p in (parts or {}).values()):
        raise ValueError("parts and block_rows must be positive")
    key, origin = quoted([id, source])
    position, row = fresh(docs, "mix_position"), fresh(docs, "mix_row")
    packed = docs.select(F.struct(*quoted(docs.columns)).alias("row"), _label(origin).alias("src"),
                         F.coalesce(key.cast("string"), F.lit("")).alias("rank_key"))
    found = {r["src"]: r["n"] for r in packed.groupBy("src").agg(F.count("*").alias("n")).collect()}
    if parts is None:
        share = tempered_parts(found)
    else:
        named = {"null" if s is None else f"={s}": p for s, p in parts.items()}
        share = {s: named.get(s, 1) for s in found}
    names = sorted(found)
    a = [share[s] for s in names]
    blocks = [-(-found[s] // block_rows) for s in names]

    rows = numbered(packed, F.md5(F.col("rank_key").cast("binary"))) \
        .withColumn("block", F.floor(F.col("nth") / block_rows)) \
        .withColumn("slot_row", (F.col("nth") % block_rows).cast("int"))
    place = _by_counters if sum(a) * len(a) <= MOST_COUNTERS else _by_slots
    return place(docs.sparkSession, rows, names, a, blocks).select("row", "p", "slot_row") \
        .select("row.*", F.col("p").alias(position), F.col("slot_row").alias(row))
