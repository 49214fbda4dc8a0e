"""Chunk tables in the session catalog: create, write, replace, delete, describe.

Tables are partitioned parquet. Code and docs are partitioned by version, threads and
issues by a bucket of their id, vectors by model. A change writes only the partitions
it touches, by dynamic overwrite: the new files replace the old ones when the job
commits, so a lost executor costs a task retry and no data. One writer per table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import checkpointed, overridden, scratch_path
from .schemas import ID_BUCKETS, TABLES, Table

_DYNAMIC = "spark.sql.sources.partitionOverwriteMode"
# the table property that holds the number of id buckets
BUCKETS = "lodestone.buckets"


class ChunkStore:
    """The chunk tables of one database.

    ``buckets`` is the number of id buckets of tables that this store creates. A table keeps
    its number as a property, and every store that opens it goes by that.
    """

    def __init__(self, spark: SparkSession, database: str, location: str | None = None,
                 buckets: int = ID_BUCKETS, tables: dict[str, Table] | None = None,
                 max_records_per_file: int = 1_000_000):
        self.spark, self.database, self.buckets = spark, database, buckets
        self.tables = tables or TABLES
        self.max_records = max_records_per_file
        self._layout: dict[str, int] = {}
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")

    @classmethod
    def scratch(cls, spark: SparkSession, **options) -> ChunkStore:
        """A store of its own in the shared scratch folder."""
        path = scratch_path(spark, "store")
        return cls(spark, "store_" + path.rsplit("-", 1)[1], path, **options)

    # ---- registry ----

    def full_name(self, table: str) -> str:
        if table not in self.tables:
            raise ValueError(f"unknown table {table}; one of {sorted(self.tables)}")
        return f"{self.database}.{table}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.full_name(table))

    def create(self, table: str, drop_existing: bool = False) -> None:
        """Create a table; an existing one is kept unless it is to be dropped."""
        name, spec = self.full_name(table), self.tables[table]
        if drop_existing:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._layout.pop(table, None)
        kept = f" TBLPROPERTIES ('{BUCKETS}' = '{self.buckets}')" if self._is_bucketed(table) else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({spec.columns}, {spec.partitions}) USING parquet "
            f"PARTITIONED BY ({', '.join(spec.partition_names)}){kept}")

    def create_all(self, drop_existing: bool = False) -> None:
        for table in self.tables:
            self.create(table, drop_existing)

    def row_counts(self) -> DataFrame:
        """``table_name``, ``present``, ``n_rows`` of every table; 0 for a missing one."""
        info = None
        for table in self.tables:
            present = self.exists(table)
            counted = (self.spark.table(self.full_name(table)).agg(F.count(F.lit(1)).alias("n_rows"))
                       if present else self.spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows")))
            row = counted.select(F.lit(table).alias("table_name"), F.lit(present).alias("present"), "n_rows")
            info = row if info is None else info.unionByName(row)
        return info

    # ---- reading and writing ----

    def read(self, table: str, columns: Sequence[str] | None = None,
             where: Column | None = None) -> DataFrame:
        """A table without its bucket column; filter and columns reach the scan."""
        df = self.spark.table(self.full_name(table))
        if where is not None:
            df = df.where(where)
        if columns:
            return df.select(*columns)
        return df.drop("bucket") if self._is_bucketed(table) else df

    def write(self, table: str, df: DataFrame, mode: str = "append") -> int:
        """Append to a table or overwrite it whole; gives the number of rows written.

        New partitions replace old ones when the job commits, and only then those without
        new rows go: a failure leaves old rows, never none.
        """
        if mode not in ("append", "overwrite"):
            raise ValueError(f"unknown mode {mode}")
        self.create(table)
        if mode == "append":
            return self._insert(table, df, overwrite=False)[0]
        # the rows may come from this very table: stage them before its files go
        n, written = self._insert(table, checkpointed(df, table), overwrite=True)
        for part in self._partitions(table):
            if tuple(part[c] for c in self.tables[table].partition_names) not in written:
                self._drop_partition(table, part)
        return n

    def replace_version(self, table: str, version: str, df: DataFrame) -> int:
        """Replace all rows of a version by ``df``; for tables partitioned by version."""
        self._needs_version(table)
        self.create(table)
        names = self.tables[table].partition_names
        rows = df.withColumn("spark_version", F.lit(version))
        n, written = self._insert(table, rows, overwrite=True)
        for part in self._partitions(table):
            if part["spark_version"] == version and tuple(part[c] for c in names) not in written:
                self._drop_partition(table, part)
        return n

    def replace_by_id(self, table: str, df: DataFrame) -> int:
        """For every id in ``df`` delete the stored rows, then insert those of ``df``."""
        key = self._needs_id(table)
        self.create(table)
        # staged once: the new rows are read for their buckets, their ids and the insert
        new = checkpointed(self._bucketed(table, df), table)
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self.spark.table(self.full_name(table)).where(F.col("bucket").isin(touched))
        kept = old.join(new.select(key).distinct(), key, "left_anti")
        self._insert(table, kept.unionByName(new), overwrite=True)
        return new.count()

    def delete_version(self, table: str, version: str) -> None:
        self._needs_version(table)
        for part in self._partitions(table):
            if part["spark_version"] == version:
                self._drop_partition(table, part)

    def delete_by_id(self, table: str, ids: DataFrame) -> None:
        """Delete all rows whose id is in ``ids``, a table with the id column."""
        key = self._needs_id(table)
        gone = checkpointed(ids.select(F.col(key).cast("bigint").alias(key)).distinct(), table)
        buckets = gone.select(self._bucket(table).alias("bucket")).distinct()
        touched = [r["bucket"] for r in buckets.collect()]
        old = self.spark.table(self.full_name(table)).where(F.col("bucket").isin(touched))
        _, written = self._insert(table, old.join(gone, key, "left_anti"), overwrite=True)
        for part in self._partitions(table):
            if int(part["bucket"]) in touched and (part["bucket"],) not in written:
                self._drop_partition(table, part)

    def rows_of(self, table: str, ids: DataFrame) -> DataFrame:
        """Stored rows whose id is in ``ids``; only the buckets of these ids are read."""
        key = self._needs_id(table)
        buckets = ids.select(self._bucket(table).alias("bucket")).distinct()
        touched = [r["bucket"] for r in buckets.collect()]
        stored = self.read(table, where=F.col("bucket").isin(touched))
        return stored.join(ids.select(key).distinct(), key, "left_semi")

    # ---- parts ----

    def _is_bucketed(self, table: str) -> bool:
        return self.tables[table].partition_names == ["bucket"]

    def _needs_version(self, table: str) -> None:
        if table not in self.tables or "spark_version" not in self.tables[table].partition_names:
            raise ValueError(f"{table} is not kept by version")

    def _needs_id(self, table: str) -> str:
        if table not in self.tables or not self.tables[table].id_column:
            raise ValueError(f"{table} is not kept by source id")
        return self.tables[table].id_column

    def buckets_of(self, table: str) -> int:
        """The number of id buckets that a table was created with."""
        if table not in self._layout:
            name = self.full_name(table)
            stored = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
            if BUCKETS not in stored:
                raise ValueError(f"{name} doesn't say how many id buckets it has: set its property {BUCKETS}")
            self._layout[table] = int(stored[BUCKETS])
        return self._layout[table]

    def _bucket(self, table: str) -> Column:
        key = F.col(self.tables[table].id_column).cast("bigint")
        return F.pmod(F.xxhash64(key), F.lit(self.buckets_of(table))).cast("int")

    def _bucketed(self, table: str, df: DataFrame) -> DataFrame:
        if self._is_bucketed(table) and "bucket" not in df.columns:
            df = df.withColumn("bucket", self._bucket(table))
        return self._conformed(table, df)

    def _conformed(self, table: str, df: DataFrame) -> DataFrame:
        """The table's columns in its order and types; the ingest time is set if absent."""
        if "ingested_at" in self.tables[table].column_names and "ingested_at" not in df.columns:
            df = df.withColumn("ingested_at", F.current_timestamp())
        schema = self.spark.table(self.full_name(table)).schema
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def _insert(self, table: str, df: DataFrame, overwrite: bool) -> tuple[int, set]:
        """Write rows; gives their number and the partitions written.

        Rows bound for id buckets are gathered by bucket first, or every task would
        write a file per bucket; the rebalance hint also splits a bucket too large for
        one task. Other tables have a few partitions and are written where they are.
        """
        names = self.tables[table].partition_names
        seen = Observation()
        rows = self._bucketed(table, df)
        if self._is_bucketed(table):
            rows = rows.hint("rebalance", *names)
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("n"),
            F.collect_set(F.struct(*[F.col(c).cast("string") for c in names])).alias("parts"))
        with overridden(self.spark, _DYNAMIC, "dynamic"), \
                overridden(self.spark, "spark.sql.files.maxRecordsPerFile", str(self.max_records)):
            rows.write.insertInto(self.full_name(table), overwrite=overwrite)
        got = seen.get
        return got["n"], {tuple(p) for p in got["parts"]}

    def _partitions(self, table: str) -> list[dict[str, str]]:
        shown = self.spark.sql(f"SHOW PARTITIONS {self.full_name(table)}").collect()
        return [dict(kv.split("=", 1) for kv in r["partition"].split("/")) for r in shown]

    def _drop_partition(self, table: str, part: dict[str, str]) -> None:
        spec = ", ".join(f"{k}='{v}'" for k, v in part.items())
        self.spark.sql(f"ALTER TABLE {self.full_name(table)} DROP IF EXISTS PARTITION ({spec})")
