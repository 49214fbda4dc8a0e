"""Fuzzy line deduplication by MinHash, in DataFrame expressions only.

A line is known by its character shingles, from every place. Minima of keyed hashes over
the shingles make bands; lines that share a band are compared by the exact Jaccard
similarity of their shingles, and union-find over the verified links leaves one line of
each component. Equal lines are one node throughout, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import let
from .common import checkpointed, fresh, quoted, small
from .links import link_groups

CHARS, SIMILARITY = 9, 0.8
BANDS, ROWS = 8, 3
#: shingles that a row holds while minima are taken; at least two
ABREAST = 8
GOLDEN = 0.6180339887498949
#: longs of parities that a set is compared by first; a power of two. Few of them say nothing about a line of
#: hundreds of shingles: all pairs of a bucket would pass
WORDS = 16
#: a shingle: CHARS characters from any place; matches take a whole character each
SHINGLES = r"(?s)(?=(.{%d}))."


def normal(line: Column) -> Column:
    """Lower case, no blanks around."""
    return F.lower(F.trim(line))


def shingles(line: Column, chars: int = CHARS) -> Column:
    """The shingles of a normal line, in order; a line of at most ``chars`` is its only one.

    A pattern finds them in one pass, while a substring would count from the start each time.
    """
    return F.when(F.char_length(line) <= chars, F.array(line)) \
        .otherwise(F.regexp_extract_all(line, F.lit(SHINGLES % chars), 1))


def hashed_shingles(lines: DataFrame, chars: int = CHARS) -> DataFrame:
    """``node``, ``h`` for every shingle of each ``node``, ``line``: the hashes of ``shingles``, without its strings.

    Shingles are cut from bytes, where each costs the same wherever it stands: a line of
    one-byte characters as it is, others with four bytes a character.
    """
    line = F.col("line")
    whole = F.char_length(line) <= chars
    plain = whole | (F.octet_length(line) == F.char_length(line))
    cut = lines.select("node", plain.alias("plain"),
                       F.when(plain, line.cast("binary")).otherwise(F.encode(line, "UTF-32")).alias("body"),
                       F.when(whole, F.octet_length(line)).when(plain, chars).otherwise(4 * chars).alias("take"))
    step = F.when(F.col("plain"), 1).otherwise(4)
    last = F.floor((F.octet_length("body") - F.col("take")) / step).cast("int")
    spots = cut.select("*", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    piece = F.substring(F.col("body"), F.col("at") * step + 1, F.col("take"))
    return spots.select("node", F.when(F.col("plain"), F.xxhash64(piece))
                        .otherwise(F.xxhash64(F.decode(piece, "UTF-32"))).alias("h"))


def band_members(lines: DataFrame, chars: int, bands: int, rows: int) -> DataFrame:
    """``node``, ``key`` for each band of each different line of ``node``, ``line``.

    Shingles become rows, several in one, and one aggregation takes all minima: a line's rows
    are neighbours, so nearly all of it happens before the shuffle, which no text enters.
    They are cut from UTF-16, where places of all lines are alike; characters beyond it count
    as two here, and only here. The last row of a line repeats its last shingle, which changes
    no minimum: values that can't be null cost half.
    """
    body = F.col("body")
    cut = lines.select("node", F.encode("line", "UTF-16BE").alias("body")) \
        .select("node", "body", F.least(F.octet_length(body), F.lit(2 * chars)).alias("take"))
    cut = cut.select("*", F.shiftright(F.octet_length(body) - F.col("take"), 1).alias("last"))
    spots = cut.select("*", F.explode(F.sequence(F.lit(0), "last", F.lit(ABREAST))).alias("at"))
    own = [F.xxhash64(F.substring(body, F.least(F.col("at") + k, F.col("last")) * 2 + 1, F.col("take"))).alias(f"h{k}")
           for k in range(ABREAST)]

    # a band's values are 31 bits of a hash from places of their own, as far as a hash reaches, which is enough to tell
    # lines apart and shuffles well; its order is that of the distance (xor) from a place of the band's own
    def part(k: int, r: int) -> Column:
        h = F.col(f"h{k}") if r < 3 else F.xxhash64(f"h{k}", F.lit(r // 3))
        return F.shiftrightunsigned(F.shiftleft(h, 21 * (r % 3)), 33).cast("int").alias(f"h{k}_{r}")

    values = spots.select("node", *own).select("node", *[part(k, r) for k in range(ABREAST) for r in range(rows)])

    def least(b: int, r: int) -> Column:
        place = F.lit(int((b + 1) * GOLDEN % 1 * (1 << 31)))
        return F.min(F.least(*[F.col(f"h{k}_{r}").bitwiseXOR(place) for k in range(ABREAST)])).alias(f"m{b}_{r}")

    minima = values.groupBy("node").agg(*[least(b, r) for b in range(bands) for r in range(rows)])
    keys = [F.xxhash64(F.lit(b), *[f"m{b}_{r}" for r in range(rows)]) for b in range(bands)]
    return minima.select("node", F.explode(F.array(*keys)).alias("key"))


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Lines with their place: ``doc_id``, ``print`` (of the text), ``pos``, ``line``; blank lines are left out."""
    key, content = quoted([id, text])
    # hashed below the generator, once a text and not once a line
    texts = docs.select(key.alias("doc_id"), F.xxhash64(content).alias("print"), F.split(content, "\n").alias("all"))
    return texts.select("doc_id", "print", F.posexplode("all").alias("pos", "raw")) \
        .select("doc_id", "print", "pos", normal(F.col("raw")).alias("line")).where("line <> ''")


def surplus_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: int = CHARS,
                  similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The lines that go: ``doc_id, print, gone`` (sorted places, from 0).

    Of the lines of a component the first by id, then text hash, then place stays.
    """
    placed = _lines(docs, id, text).withColumn("node", F.xxhash64("line"))
    spots = checkpointed(placed.select("doc_id", "print", "pos", "node"), "spots")

    def describe(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        # lines stand for their sets, which would take eight times the room
        bodies = checkpointed(placed.select("node", "line").join(small(asked, F.lit(32)), "node")
                              .groupBy("node").agg(F.min("line").alias("set")), "bodies")
        element = bodies.select("node", F.explode(F.array_distinct(shingles(F.col("set"), chars))).alias("s")) \
            .select("node", F.xxhash64("s").alias("x"))
        word = F.shiftright("x", 6).bitwiseAND(F.lit(WORDS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("x").bitwiseAND(F.lit(63)).cast("int"))
        # parities of the elements in the cells of each long
        none = F.lit(0).cast("bigint")
        odd = [F.bit_xor(F.when(word == w, bit).otherwise(none)).alias(f"w{w}") for w in range(WORDS)]
        marks = element.groupBy("node").agg(F.count("*").alias("size"), *odd) \
            .select("node", "size", F.array(*[f"w{w}" for w in range(WORDS)]).alias("marks"))
        return bodies, checkpointed(marks, "marks")

    def similar(pairs: DataFrame) -> DataFrame:
        # equal shingles count once in the sizes and here
        common = F.size(F.array_intersect(shingles(F.col("set_a"), chars), shingles(F.col("set_b"), chars)))
        sizes = F.col("size") + F.col("size2")
        return pairs.where(let(common, lambda x: x >= similarity * (sizes - x))).select("a", "b")

    # equal lines are one node; 64-bit hashes stand for lines
    roots, _ = link_groups(band_members(placed, chars, bands, rows), describe, similar, similarity, WORDS)
    grouped = spots.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "print", "pos")).alias("first"), F.count("*").alias("n")) \
        .where("n > 1").select("root", "first")
    gone = grouped.join(first, "root").where(~F.struct("doc_id", "print", "pos").eqNullSafe(F.col("first"))) \
        .groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # written, so that its size is known where it meets the texts
    return checkpointed(gone, "gone")


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", length: str | None = None,
               count: str | None = None, **options) -> DataFrame:
    """``docs`` with surplus lines cut from ``text``; other columns as they were.

    ``length`` names a column to be set to the new text's characters, ``count`` a new
    column for the number of lines cut. Rows stay, with an empty text if all their lines
    go. Null texts stay null; blank lines are neither compared nor cut. Rows that repeat
    an id and a text count as one and keep the same lines. Extra columns stay.
    """
    key, content = quoted([id, text])
    gone_id, gone_print, gone_at = (fresh(docs, c) for c in ("gone_id", "gone_print", "gone_at"))
    surplus = surplus_lines(docs, id, text, **options)
    room = F.octet_length(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) + 4 * F.size("gone") + 64
    gone = small(surplus, room).withColumnsRenamed({"doc_id": gone_id, "print": gone_print, "gone": gone_at})
    both = docs.join(gone, key.eqNullSafe(F.col(gone_id)) & (F.xxhash64(content) == F.col(gone_print)), "left")
    left = F.filter(F.split(content, "\n"), lambda x, i: ~F.array_contains(gone_at, i))
    new = F.when(F.col(gone_at).isNull(), content).otherwise(F.array_join(left, "\n"))
    out = [new.alias(c) if c == text else F.coalesce(F.char_length(new), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
           if c == length else quoted([c])[0] for c in docs.columns]
    if count:
        out.append(F.coalesce(F.size(gone_at), F.lit(0)).cast("bigint").alias(fresh(docs, count)))
    return both.select(*out)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, kept_chars, kept_sha256``.

    Null texts count as empty, an empty text as one blank line. Rows that repeat an id and
    a text give equal rows; of tied lines the first place stays. An empty table gives no
    rows; extra columns are not read.
    """
    key, content = quoted([id, text])
    rows = docs.select(key.alias("doc_id"), F.coalesce(content, F.lit("")).alias("text")) \
        .withColumn("n_lines", F.size(F.split("text", "\n")).cast("bigint"))
    cut = drop_lines(rows, "doc_id", "text", count="n_removed", **options)
    return cut.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("bigint").alias("kept_chars"),
                      F.sha2("text", 256).alias("kept_sha256"))
