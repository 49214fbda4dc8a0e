"""Incremental sync: high-water mark in batch, micro-batches from a landing folder.

Both end in the same step, ``upsert_latest``, which is idempotent: a batch that is
run again, or arrives late, leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.threads import dedup_latest
from ..session import checkpointed
from ..sources.tables import ChunkStore


def upsert_latest(store: ChunkStore, table: str, batch: DataFrame, newer: list[Column]) -> None:
    """Keep the latest row per id of the stored rows and the batch.

    Ids are combined before the shuffle, so a hot id costs no more than another.
    """
    key = store.tables[table].id_column
    latest = checkpointed(dedup_latest(batch, newer, key), table)
    stored = store.rows_of(table, latest)
    store.replace_by_id(table, dedup_latest(latest.unionByName(stored), newer, key))


def sync_newer(store: ChunkStore, table: str, source: DataFrame, changed: str,
               newer: list[Column]) -> None:
    """Take what changed after the stored mark, replace by id, advance the mark.

    The mark is written last: a run that breaks off is repeated from the old mark. Rows at
    the mark itself are read again, as more of them may have landed since; taking a row
    twice changes nothing.
    """
    spark = source.sparkSession
    marks = f"{store.database}.sync_marks"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {marks} (table_name string, mark timestamp) USING parquet")
    mark = spark.table(marks).where(F.col("table_name") == table).agg(F.max("mark")).first()[0]
    fresh = source if mark is None else source.where(F.col(changed) >= F.lit(mark))
    taken = checkpointed(fresh, "fresh")
    upsert_latest(store, table, taken, newer)
    top = taken.agg(F.lit(table).alias("table_name"), F.max(changed).alias("mark"))
    top.where(F.col("mark").isNotNull()).write.insertInto(marks)


def stream_upsert(store: ChunkStore, table: str, landing: str, schema, newer: list[Column],
                  checkpoint: str, max_files: int = 1000) -> None:
    """Upsert all files that landed since the last run, in micro-batches.

    ``checkpoint`` is the folder that remembers what was read, the same one in every run.
    """
    spark = store.spark
    store.create(table)
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
              .parquet(landing))
    query = (
        stream.writeStream
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, _: upsert_latest(store, table, batch, newer))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
