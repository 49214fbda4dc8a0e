"""WARC archives: written as Spark text files, read back in splits by boundary chains.

A payload may hold the bytes a record starts with, so that a task that begins inside a
file cannot know which of them are records. Reading takes two kinds of scans:

1.  Spark's text reader cuts every split at the magic. Each place that parses as a record
    header is a candidate, whose length names its successor. A task follows its candidates
    to the end of its split and sends, for each, where the chain leaves the split.
2.  Pointer jumping from the start of each file keeps the candidates that its chain
    reaches: one for each split at most, in as many rounds as the doublings that span the splits.
3.  The second scan starts each split at its reached candidate and follows the lengths.
    Whatever lies between is payload. A record that runs over several splits, because the
    magic stands in its payload, is put together from its parts; these are looked for first,
    in one more scan, so that the records themselves need not be written.

All scans see bytes only through Spark's reader, so that any file system will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions.ids import uuid5
from .common import checkpointed, quoted, scratch_path

# Parts of the format.
MAGIC = "WARC/1.1\r\n"
HEAD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: smaller payloads are never revisits
LEAST_SHARED = 100
#: tables of at most so many bytes are sent to all tasks; larger ones meet in a shuffle
BROADCAST_BYTES = 32 << 20

_MAGIC, _END = MAGIC.encode(), HEAD_END.encode()
_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]+)[ \t]*$", re.I)
_HTTP = re.compile(rb"^content-type:[ \t]*application/http\b", re.I)


def _small(df: DataFrame, row_bytes: int) -> bool:
    """Whether a written table, counted, is small enough to broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


# ---- writing ----

def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null. Line ends inside the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n"))).otherwise("")


def _record_id(id: Column, digest: Column) -> Column:
    named = F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id), F.lit("null")), digest)
    return F.concat(F.lit("<urn:uuid:"), uuid5(named), F.lit(">"))


def write_archive(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
                  least: int = LEAST_SHARED, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each page, in files below ``path``; a task writes one file.

    A null payload counts as empty. Of pages with equal payloads of at least ``least``
    bytes, the one with the smallest id is a response (rows that repeat this id with the
    same payload too; null ids only where all are null); the others revisit it and carry
    no payload. Payloads are equal if their SHA-256 is. Null urls give no target line.
    """
    key, link, content = quoted([id, url, html])
    rows = pages.select(key.alias("id"), key.cast("string").alias("named"), link.cast("string").alias("url"),
                        F.coalesce(content, F.lit("")).alias("payload"))
    shared = F.octet_length("payload") >= least
    digest = F.sha2("payload", 256)
    copies = checkpointed(
        rows.where(shared).groupBy(digest.alias("digest"))
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "first", F.col("first").cast("string").alias("first_named")), "copies")
    if _small(copies, 256):
        copies = F.broadcast(copies)
    known = rows.withColumn("digest", digest).join(copies.withColumn("copied", F.lit(True)), "digest", "left")
    revisit = F.coalesce("copied", F.lit(False)) & shared & ~F.col("id").eqNullSafe(F.col("first"))
    body = F.when(F.col("revisit"), "").otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(HEAD_END))
    block = F.concat(http, body)
    head = F.concat(
        F.lit(MAGIC), _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("named"), F.col("digest"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("first_named"), F.col("digest")))),
        _line("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)),
        _line("Page-ID", F.url_encode("named")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # the line end of Spark's text writer ends a record
    known.withColumn("revisit", revisit).select(F.concat(head, block).alias("value")) \
        .write.option("lineSep", HEAD_END).text(path)


# ---- reading ----

def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between the magics, in file order inside each split (``file``, ``block``)."""
    return spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))


def _needed(piece: bytes) -> tuple[int, int] | None:
    """Bytes of header, with its end, and of content; None if this is no header."""
    end = piece.find(_END)
    if end < 0:
        return None
    for line in piece[:end].split(b"\r\n"):
        if found := _LENGTH.match(line):
            return end + len(_END), int(found[1])
    return None


class _Place:
    """Where in its file each piece starts."""

    def __init__(self):
        self.split, self.at = None, 0

    def turn(self, file: str, block: int, base: int = 0) -> bool:
        """Whether a new split begins."""
        if (file, block) == self.split:
            return False
        self.split, self.at, self.bare = (file, block), base, block == 0
        return True

    def take(self, piece: bytes) -> tuple[int, bool]:
        """The offset of the piece's magic, and whether it has one: the first of a file has none."""
        at, magic = self.at, not self.bare
        self.at += len(piece) + len(_MAGIC) * magic
        self.bare = False
        return at, magic


CHAINS = "file string, block bigint, total bigint, chains array<struct<at:bigint,leaves:bigint,last:bigint>>"


def _follow(starts: list[int], successors: list[int], total: int) -> list[dict]:
    """For each candidate of a split where its chain leaves the split, and its last candidate there."""
    known: dict[int, tuple[int, int]] = {}
    for at, successor in zip(reversed(starts), reversed(successors)):
        known[at] = known.get(successor, (successor if successor >= total else -1, at))
    return [{"at": at, "leaves": known[at][0], "last": known[at][1]} for at in starts]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each split, offsets counted from its start."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("leaves", pa.int64()), ("last", pa.int64())]))
    place, starts, successors = _Place(), [], []

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([place.split[0]]), pa.array([place.split[1]], pa.int64()), pa.array([place.at], pa.int64()),
             pa.array([_follow(starts, successors, place.at)], kind)], names=["file", "block", "total", "chains"])

    for batch in batches:
        for piece, file, block in zip(*(batch.column(k) for k in range(3))):
            new = (file.as_py(), block.as_py())
            if place.split and place.split != new:
                yield done()
                starts, successors = [], []
            place.turn(*new)
            piece = piece.as_py()
            at, magic = place.take(piece)
            if magic and (sizes := _needed(piece)):
                starts.append(at)
                successors.append(at + len(_MAGIC) + sum(sizes) + len(_END))
    if place.split:
        yield done()


def reachable(entries: DataFrame) -> DataFrame:
    """Entries (``file``, ``at``, ``leaves``, ...) on the chain from offset 0 of their file.

    Pointer jumping: in each round the reached ones reach as far again as all rounds
    before, and every pointer doubles. Only places that some chain leads to take part.
    """
    led = entries.where("leaves >= 0").select("file", F.col("leaves").alias("at")).distinct()
    jumps = checkpointed(entries.join(led, ["file", "at"], "left_semi").unionByName(entries.where("at = 0")), "jumps")
    reached = jumps.where("at = 0").select("file", "at")
    hops = jumps.select("file", "at", "leaves").join(
        jumps.select("file", F.col("at").alias("leaves")), ["file", "leaves"], "left_semi").select("file", "at", "leaves")
    while True:
        hops = checkpointed(hops, "hops")
        if hops.isEmpty():
            return jumps.join(reached, ["file", "at"], "left_semi")
        further = hops.join(reached, ["file", "at"], "left_semi").select("file", F.col("leaves").alias("at"))
        reached = checkpointed(reached.unionByName(further).distinct(), "reached")
        hops = hops.join(hops.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("next")),
                         ["file", "leaves"]).select("file", "at", F.col("next").alias("leaves"))


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """For each split its first offset ``base``, the reached ``entry`` in it, and the record before it."""
    found = checkpointed(_pieces(spark, path).select("value", "file", "block").mapInArrow(_candidates, CHAINS), "chains")
    order = W.partitionBy("file").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    bases = checkpointed(found.select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases")
    entries = found.join(bases, ["file", "block"]).select("file", "block", "base", F.explode("chains").alias("c")).select(
        "file", "block", (F.col("base") + F.col("c.at")).alias("at"), (F.col("base") + F.col("c.last")).alias("last"),
        F.when(F.col("c.leaves") >= 0, F.col("base") + F.col("c.leaves")).otherwise(-1).alias("leaves"))
    reached = reachable(entries).select("file", "block", F.col("at").alias("entry"), "last")
    return checkpointed(bases.join(reached, ["file", "block"], "left").select(
        "file", "block", "base", "entry", F.last("last", ignorenulls=True).over(before).alias("owner")), "splits")


PARTS = "file string, at bigint, pos bigint, raw binary, whole boolean"
_PARTS = pa.schema([("file", pa.string()), ("at", pa.int64()), ("pos", pa.int64()), ("raw", pa.binary()), ("whole", pa.bool_())])
_OUT_BYTES = 16 << 20


class _Walk:
    """Follows the chain through splits; ``out`` gathers records and parts of records."""

    def __init__(self):
        self.out, self.bytes = [], 0
        self.owner = None

    def begin(self, owner: int | None, pos: int, begun: bool, sizes: tuple[int, int] | None = None) -> None:
        self.owner, self.pos, self.begun, self.parts, self.held = owner, pos, begun, [], 0
        self.size = sum(sizes) if sizes else None

    def add(self, piece: bytes) -> None:
        self.parts.append(piece)
        self.held += len(piece)

    def end(self, file: str) -> None:
        if self.owner is not None and self.parts:
            raw = b"".join(self.parts)
            whole = self.begun and len(raw) >= self.size
            self.out.append((file, self.owner, self.pos, raw[:self.size] if whole else raw, whole))
            self.bytes += len(raw)
        self.owner = None

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out))
        self.out, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, walk, expected = _Place(), _Walk(), None
    for batch in batches:
        for row in range(batch.num_rows):
            piece, file, block, base, entry, owner = (batch.column(k)[row].as_py() for k in range(6))
            if base is None:
                raise ValueError(f"{file}: other splits than in the scan before")
            if place.split and place.split != (file, block):
                walk.end(place.split[0])
            if place.turn(file, block, base):
                walk.begin(owner, base, False)
                expected = entry
            at, magic = place.take(piece)
            if magic and at == expected:
                walk.end(file)
                sizes = _needed(piece)
                walk.begin(at, at, True, sizes)
                walk.add(piece)
                expected = at + len(_MAGIC) + sum(sizes) + len(_END)
            else:
                walk.add((_MAGIC if magic else b"") + piece)
            if walk.bytes >= _OUT_BYTES:
                yield walk.taken()
    if place.split:
        walk.end(place.split[0])
    if walk.out:
        yield walk.taken()


def _joined(parts: pa.Table) -> pa.Table:
    """A record from its parts; none if the file ends before the record does."""
    parts = parts.sort_by("pos")
    raw = b"".join(parts["raw"].to_pylist())
    sizes = _needed(raw)
    whole = sizes is not None and len(raw) >= sum(sizes)
    return pa.Table.from_arrays([parts["file"][:whole], parts["at"][:whole], parts["pos"][:whole],
                                 pa.array([raw[:sum(sizes)]] if whole else [], pa.binary()),
                                 pa.array([True] * whole, pa.bool_())], schema=_PARTS)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Raw records to header and payload; what an HTTP header stands before is its payload."""
    for batch in batches:
        heads, payloads = [], []
        for raw in batch.column(2):
            head, _, block = raw.as_py().partition(_END)
            if any(_HTTP.match(line) for line in head.split(b"\r\n")):
                block = block.partition(_END)[2]
            heads.append(head.decode("utf-8", "replace"))
            payloads.append(block)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.string()),
                                          pa.array(payloads, pa.binary())], names=["file", "at", "head", "payload"])


def header(name: str) -> Column:
    """A header's value; null if the record has no such line."""
    found = F.regexp_extract_all("head", F.lit(rf"(?im)(?:^|\r\n){re.escape(name)}:[ \t]*([^\r\n]*)"), 1)
    return F.try_element_at(found, F.lit(1))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records below ``path``: ``file, at, head, payload, record_type, record_id, refers, uri, digest``.

    ``at`` is the record's offset in its file, ``head`` its header lines. Only records on
    the chain of lengths from the file's start count: bytes that look like a record inside
    a payload don't, nor does a last record that the file cuts off. A file that doesn't
    start with a record has none. An empty folder gives no rows.
    """
    splits = _splits(spark, path)
    pieces = _pieces(spark, path)
    if _small(splits, 256):
        # the scan's order stays
        placed = pieces.join(F.broadcast(splits), ["file", "block"], "left")
    else:
        placed = pieces.join(splits, ["file", "block"], "left").repartition("file", "block") \
            .sortWithinPartitions("file", "block", "nth")
    parts = placed.select("value", "file", "block", "base", "entry", "owner").mapInArrow(_records, PARTS)
    # a record over several splits is rare, and its parts are small beside the scan
    loose = checkpointed(parts.where("not whole"), "parts")
    joined = loose.groupBy("file", "at").applyInArrow(_joined, PARTS)
    records = parts.where("whole").unionByName(joined).select("file", "at", "raw") \
        .mapInArrow(_opened, "file string, at bigint, head string, payload binary")
    return records.select("*", header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("record_id"),
                          header("WARC-Refers-To").alias("refers"), header("WARC-Target-URI").alias("uri"),
                          header("WARC-Payload-Digest").alias("digest"))


def digests(records: DataFrame, kind: T.DataType, name: str = "page_id") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records that this module wrote.

    Size and digest are those of the payload that was read: for a revisit, that of the
    record it refers to, found by its id; null if that is not in the archive or has
    another digest than the revisit names.
    """
    read = checkpointed(records.select(
        F.url_decode(header("Page-ID")).try_cast(kind).alias("page"), "record_type", "record_id", "refers", "digest",
        F.octet_length("payload").cast("bigint").alias("bytes"), F.sha2("payload", 256).alias("sha256")), "digests")
    asked = read.where("refers is not null").select(F.col("refers").alias("record_id")).distinct()
    # one row for each id that is asked for: a hot one is split on the other side
    targets = read.where("record_type = 'response'").join(asked, "record_id", "left_semi").groupBy("record_id") \
        .agg(F.any_value("page").alias("refers_to"), F.any_value("bytes").alias("full"), F.any_value("sha256").alias("of")) \
        .withColumnsRenamed({"record_id": "refers", "of": "full_digest"})
    out = read.join(targets, "refers", "left")
    revisit = F.col("record_type") == "revisit"
    told = F.concat(F.lit("sha256:"), F.col("full_digest")) == F.col("digest")
    return out.select(
        F.col("page").alias(name),
        F.when(revisit, F.when(told, F.col("full"))).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.when(told, F.col("full_digest"))).otherwise(F.col("sha256")).alias("payload_digest"),
        "record_type", F.when(revisit & told, F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages written as an archive in the shared folder and read back, as ``digests`` gives them.

    One row for each page: null and empty payloads, repeated rows and null ids included
    (see ``write_archive``). An empty table gives no rows; other columns are not read.
    """
    path = scratch_path(pages.sparkSession, "archive")
    write_archive(pages, path, id, url, html)
    return digests(read_archive(pages.sparkSession, path), pages.schema[id].dataType)
