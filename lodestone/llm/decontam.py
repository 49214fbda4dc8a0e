"""Benchmark decontamination: windows of test words found in training documents.

A window is ``n`` consecutive words of an item, or all words of a shorter item. The
windows of the items, hashed, are broadcast as long as their measured number allows;
beyond that the same join shuffles. Every position of every document is looked up, and
each hit is verified by comparing words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ascii_lower, checkpointed, fresh, quoted

#: runs of digits, a-z and characters beyond ASCII, in lower-cased text
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: the same words where case is still as written
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: windows that are broadcast at most, some 100 MB of words
BROADCAST_WINDOWS = 400_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def benchmark_windows(items: DataFrame, id: str = "item_id", text: str = "text",
                      n: int = 10) -> DataFrame:
    """Distinct windows: ``len``, ``window`` (words), ``items`` (ids as text, sorted)."""
    key, content = quoted([id, text])
    words = items.select(key.cast("string").alias("item"), words_of(content).alias("words")) \
        .withColumn("len", F.least(F.size("words"), F.lit(n))).where("len > 0")
    starts = words.select("item", "words", "len",
                          F.explode(F.sequence(F.lit(1), F.size("words") - F.col("len") + 1)).alias("p"))
    return starts.select("item", "len", F.slice("words", F.col("p"), F.col("len")).alias("window")) \
        .groupBy("len", "window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _key(words: Column) -> Column:
    """One number for each word, so that a word is hashed once for all windows it is in."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_key(marks: Column, first, size: int) -> Column:
    return F.xxhash64(*[F.get(marks, first + i) for i in range(size)])


def scan(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """Occurrences as ``find_hits`` has them, and a row with ``p`` 0 and ``n_words`` for every document.

    Both come from one pass over the texts: a document's words also hold one place before
    the first, which the lookup knows as a window without words.
    """
    key, content = quoted([id, text])
    windows = checkpointed(benchmark_windows(items, item_id, item_text, n), "windows")
    sizes = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n values at most
    small = windows.count() <= BROADCAST_WINDOWS
    marks = F.col("marks")
    lookup = windows.withColumn("marks", _key(F.col("window"))).withColumn("key", F.coalesce(*[
        F.when(F.col("len") == size, _window_key(marks, F.lit(0), size)) for size in sizes],
        F.lit(0).cast("bigint"))).drop("marks")
    place = docs.sparkSession.range(1).select(
        F.lit(0).alias("len"), F.array().cast("array<string>").alias("window"),
        F.array().cast("array<string>").alias("items"), F.lit(0).cast("bigint").alias("key"))
    lookup = lookup.unionByName(place)
    positions = docs.select(key.alias("doc_id"), F.xxhash64(content).alias("print"), words_of(content).alias("words")) \
        .select("*", _key(F.col("words")).alias("marks")) \
        .select("doc_id", "print", "words", "marks", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("p"))
    at = [F.struct(F.lit(size).alias("len"), _window_key(marks, F.col("p") - 1, size).alias("key")) for size in sizes]
    before = F.struct(F.lit(0).alias("len"), F.lit(0).cast("bigint").alias("key"))
    # windows that meet the lookup in a shuffle carry their own words alone
    own = F.col("words") if small else F.slice("words", F.greatest("p", F.lit(1)), n)
    kept = ["doc_id", "print", "p", F.size("words").cast("bigint").alias("n_words"), own.alias("words")]
    if len(at) == 1:
        keyed = positions.select(*kept, F.when(F.col("p") > 0, at[0]).otherwise(before).alias("at")) \
            .select("doc_id", "print", "p", "n_words", "words", "at.len", "at.key")
    else:
        keyed = positions.select(*kept, F.inline(F.when(F.col("p") > 0, F.array(*at) if at else F.array().cast(
            "array<struct<len:int,key:bigint>>")).otherwise(F.array(before))))
    met = keyed.join(F.broadcast(lookup) if small else lookup, ["key", "len"])
    there = F.slice("words", F.greatest("p", F.lit(1)) if small else F.lit(1), F.col("len")) == F.col("window")
    return met.where((F.col("p") == 0) | there).select(
        "doc_id", "print", "p", "len", "items", F.when(F.col("p") == 0, F.col("n_words")).alias("n_words"))


def find_hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """Occurrences: ``doc_id``, ``print`` (hash of the text), ``p`` (first word, from 1), ``len``, ``items``.

    Rows that repeat an id and a text share their occurrences.
    """
    return scan(docs, items, id, text, item_id, item_text, n).where("p > 0").drop("n_words")


def hit_counts(hits: DataFrame) -> DataFrame:
    """Per document: ``n_hit`` words inside any occurrence, and the ``item_list`` of their items."""
    w = Window.partitionBy("doc_id", "print").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    until = F.col("p") + F.col("len")
    new = F.greatest(F.lit(0), until - F.greatest(F.col("p"), F.coalesce(F.max(until).over(w), F.lit(0))))
    words = hits.select("doc_id", "print", new.alias("new")).groupBy("doc_id", "print") \
        .agg(F.sum("new").cast("bigint").alias("n_hit"))
    found = hits.select("doc_id", "print", F.explode("items").alias("item")).distinct() \
        .groupBy("doc_id", "print").agg(F.sort_array(F.collect_list("item")).alias("item_list"))
    return words.join(found, (words["doc_id"].eqNullSafe(found["doc_id"])) & words["print"].eqNullSafe(found["print"])) \
        .select(words["doc_id"], words["print"], "n_hit", "item_list")


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies inside any occurrence of a window; ``items_sha256`` is of the
    item ids with occurring windows, sorted as text and joined by commas (empty text for
    none). Null and empty texts have no words; an empty benchmark hits nothing; items
    without words have no window. Rows that repeat an id are answered each by their own
    text. Extra columns are not read.
    """
    # written once: documents, their hit words and their items all read it
    found = checkpointed(scan(docs, items, id, text, item_id, item_text, n), "hits")
    hits = hit_counts(found.where("p > 0"))
    base = found.where("p = 0").select("doc_id", "print", "n_words")
    both = base.join(hits.withColumnsRenamed({"doc_id": "hit_id", "print": "hit_print"}),
                     F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("print") == F.col("hit_print")), "left")
    ids = F.coalesce(F.array_join("item_list", ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"),
                       F.coalesce(F.size("item_list"), F.lit(0)).cast("bigint").alias("n_items"),
                       F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; columns as they were.

    Rows with a null or empty text stay, and so does everything if the benchmark is empty.
    """
    key, content = quoted([id, text])
    hit_id, hit_print = fresh(docs, "hit_id"), fresh(docs, "hit_print")
    bad = find_hits(docs, items, id, text, item_id, item_text, n).select(
        F.col("doc_id").alias(hit_id), F.col("print").alias(hit_print)).distinct()
    return docs.join(bad, key.eqNullSafe(F.col(hit_id)) & (F.xxhash64(content) == F.col(hit_print)), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """``docs`` with the hit words, and what stands between neighbouring ones, cut from ``text``.

    Other rows and columns are as they were; null texts stay null.
    """
    key, content = quoted([id, text])
    hit_id, hit_print, hit_words = (fresh(docs, c) for c in ("hit_id", "hit_print", "hit_words"))
    hits = find_hits(docs, items, id, text, item_id, item_text, n).groupBy("doc_id", "print").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("p"), F.col("p") + F.col("len") - 1)))).alias(hit_words)) \
        .withColumnsRenamed({"doc_id": hit_id, "print": hit_print})
    both = docs.join(hits, key.eqNullSafe(F.col(hit_id)) & (F.xxhash64(content) == F.col(hit_print)), "left")
    # the text as alternating gaps and words; a word is kept, with the gap before it, unless hit
    words = F.regexp_extract_all(content, F.lit(WORD_ANY_CASE), 0)
    gaps = F.split(content, WORD_ANY_CASE, -1)
    inside = lambda i: F.array_contains(hit_words, i)
    kept = F.transform(F.sequence(F.lit(1), F.size(gaps)), lambda i: F.concat(
        F.when((i > 1) & inside(i - 1) & inside(i), F.lit("")).otherwise(F.get(gaps, i - 1)),
        F.when(inside(i), F.lit("")).otherwise(F.coalesce(F.get(words, i - 1), F.lit("")))))
    cut = F.when(F.col(hit_words).isNull(), content).otherwise(F.array_join(kept, ""))
    return both.select(*[cut.alias(c) if c == text else quoted([c])[0] for c in docs.columns])
