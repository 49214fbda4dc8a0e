"""Markdown documents to typed chunks.

The whole job is narrow: fenced code and HTML tables are folded into marked single
lines, headings split the text, and sections are exploded. Marks are control characters;
those of the text itself are escaped before and restored in every part. Nothing is shuffled
but the small include lookup, and only when tags are to be resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.ids import doc_chunk_id
from ..functions.packing import pack_paragraphs
from ..functions.rules import MIN_PROSE_CHARS
from ..session import checkpointed

# Headings, fences, tables and include tags.
HEADING = r"(?dm)^(#{1,6})\s+(.+)$"
FENCE = r"(?dms)^```([\p{L}\p{N}_]*)\n(.*?)^```"
TABLE = r"(?is)<table.*?>.*?</table>"
INCLUDE = r"\{%\s*include_example\s+(\S+)\s+(\S+)\s*%\}"

# one marked line per folded block: mark, ordinal, bar, text with line feeds replaced
_CODE, _TABLE, _BAR, _LF = "\x02", "\x03", "\x04", "\x05"
_MARKED = rf"(?dm)^([{_CODE}{_TABLE}][^\n]*)$"


# escape of a mark that stands in the text: the first mark and a letter
_MARKS = "\x01" + _CODE + _TABLE + _BAR + _LF
_HOLDS_MARK = f"[{_MARKS}]"


def _escaped(text: Column) -> Column:
    out = text
    for mark, letter in zip(_MARKS, "abcde"):
        out = F.replace(out, F.lit(mark), F.lit("\x01" + letter))
    return F.when(F.rlike(text, F.lit(_HOLDS_MARK)), out).otherwise(text)


def _restored(text: Column) -> Column:
    def plain(held: Column) -> Column:
        out = held
        for mark, letter in reversed(list(zip(_MARKS, "abcde"))):
            out = F.replace(out, F.lit("\x01" + letter), F.lit(mark))
        return F.when(held.contains("\x01"), out).otherwise(held)

    return tx.let(text, plain)


def _folded(text: Column, pattern: str, group: int, mark: str, prepare) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), group)

    def line(body: Column, ordinal: Column) -> Column:
        return F.concat(F.lit("\n" + mark), ordinal.cast("string"), F.lit(_BAR),
                        F.translate(prepare(body), "\n", _LF), F.lit("\n"))

    return tx.interleave(F.split(text, pattern, -1), F.transform(found, line))


def _placeholders(text: Column) -> Column:
    """Folded blocks inside another construct show by their names only."""
    named = F.regexp_replace(text, rf"{_CODE}(\d+){_BAR}[^\n]*", "__CODE_BLOCK_$1__")
    return F.regexp_replace(named, rf"{_TABLE}(\d+){_BAR}[^\n]*", "__HTML_TABLE_$1__")


def fold_blocks(content: Column) -> Column:
    """The text with every fence and every table on one marked line of its own."""
    return tx.let(content, lambda text: tx.let(
        _folded(text, FENCE, 2, _CODE, tx.strip),
        lambda without_code: _folded(without_code, TABLE, 0, _TABLE, _placeholders)))


def _unfold(line: Column) -> Column:
    return F.translate(F.regexp_replace(line, rf"^.\d+{_BAR}", ""), _LF, "\n")


def heading_paths(levels: Column, headings: Column) -> Column:
    """For each heading the list of headings it stands under, itself last.

    A heading of level n keeps at most n-1 of the headings before it, so a skipped
    level does not leave a gap.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("paths"), empty.alias("stack"))

    def step(acc: Column, h: Column) -> Column:
        kept = F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), h["level"] - 1))
        stack = F.concat(kept, F.array(h["heading"]))
        return F.struct(F.concat(acc["paths"], F.array(stack)).alias("paths"), stack.alias("stack"))

    pairs = F.zip_with(levels, headings,
                       lambda lv, h: F.struct(lv.alias("level"), h.alias("heading")))
    return F.aggregate(pairs, start, step, lambda acc: acc["paths"])


def split_sections(docs: DataFrame, content: str = "content") -> DataFrame:
    """One row per section: ``section_no``, ``level``, ``heading``, ``path``, ``body`` (for ``section_parts``).

    Text before the first heading is section 0 of level 0, and absent when blank.
    Blocks are folded before the split, so a ``#`` line in code is no heading.
    """
    text = F.col("_folded")
    levels = F.transform(F.regexp_extract_all(text, F.lit(HEADING), 1), F.length)
    headings = F.transform(F.regexp_extract_all(text, F.lit(HEADING), 2),
                           lambda h: _restored(tx.strip(_placeholders(h))))
    marked = (
        docs.where(~tx.is_blank(F.col(content)))
        .withColumn("_folded", fold_blocks(_escaped(F.col(content))))
        .withColumn("_levels", levels).withColumn("_headings", headings)
        .withColumn("_bodies", F.split(text, HEADING, -1))
        .withColumn("_paths", heading_paths(F.col("_levels"), F.col("_headings")))
    )
    sections = F.transform(F.col("_bodies"), lambda body, i: F.struct(
        i.alias("section_no"),
        F.coalesce(F.try_element_at(F.col("_levels"), F.nullif(i, F.lit(0))), F.lit(0)).alias("level"),
        F.coalesce(F.try_element_at(F.col("_headings"), F.nullif(i, F.lit(0))), F.lit("")).alias("heading"),
        F.coalesce(F.try_element_at(F.col("_paths"), F.nullif(i, F.lit(0))),
                   F.array().cast("array<string>")).alias("path"),
        body.alias("body")))
    keep = [c for c in docs.columns if c != content]
    return (
        marked.select(*keep, F.inline(sections))
        .where((F.col("section_no") > 0) | ~tx.is_blank(F.col("body")))
    )


def section_parts(body: Column) -> Column:
    """Prose runs and blocks of a section in order: array<struct<content_type, content>>."""
    prose = F.transform(F.split(body, _MARKED, -1), lambda p: F.struct(
        F.lit("prose").alias("content_type"), _restored(tx.strip(_placeholders(p))).alias("content")))
    blocks = F.transform(F.regexp_extract_all(body, F.lit(_MARKED), 1), lambda m: F.struct(
        F.when(m.startswith(_CODE), "code_example").otherwise("config_table").alias("content_type"),
        F.when(m.startswith(_CODE), _restored(_unfold(m)))
        .otherwise(tx.let(_restored(_unfold(m)), tx.table_to_text)).alias("content")))
    ordered = F.flatten(F.zip_with(prose, blocks, lambda a, b: F.array(a, b)))
    return F.filter(ordered, lambda p: p.isNotNull() & F.when(
        p["content_type"] == "prose", F.length(p["content"]) > MIN_PROSE_CHARS)
        .otherwise(~tx.is_blank(p["content"])))


def chunk_documents(docs: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Chunks of documents (``spark_version``, ``file_path``, ``content``, plus any keys).

    With ``examples`` (``key``, ``code``) include tags are resolved first; else they stay as
    they are. Configuration keys are those of the whole run of prose, code or table, given
    to every piece it is packed into.
    """
    if examples is not None:
        docs = resolve_includes(docs, examples)
    keys = [c for c in docs.columns if c not in ("content", "file_path", "spark_version")]
    parts = (
        split_sections(docs)
        .select(*keys, "spark_version", F.col("file_path").alias("doc_url"), "section_no",
                F.col("path").alias("heading_hierarchy"),
                F.posexplode(section_parts(F.col("body"))).alias("part_no", "_part"))
        .select("*", "_part.content_type", F.col("_part.content").alias("_text")).drop("_part")
    )
    return (
        parts
        .withColumn("related_configs", tx.config_keys(F.col("_text")))
        .withColumn("doc_section", F.coalesce(
            F.try_element_at(F.col("heading_hierarchy"), F.lit(1)), F.lit("")))
        .select("*", F.posexplode(pack_paragraphs(F.col("_text"))).alias("piece_no", "content"))
        .drop("_text")
        .withColumn("chunk_id", doc_chunk_id(F.col("spark_version"), F.col("doc_url"),
                                             F.col("doc_section"), F.col("content")))
    )


def code_blocks(content: Column) -> Column:
    """Stripped, non-empty fenced blocks of a document, in order."""
    found = F.transform(F.regexp_extract_all(content, F.lit(FENCE), 2), tx.strip)
    return F.filter(found, lambda c: c != "")


def _written(docs: DataFrame) -> DataFrame:
    """The same rows from a scratch table; columns without a type, which it can't hold, stay nulls."""
    untyped = [f.name for f in docs.schema if isinstance(f.dataType, T.NullType)]
    return checkpointed(docs.drop(*untyped), "documents").withColumns({c: F.lit(None) for c in untyped}).select(*docs.columns)


def resolve_includes(docs: DataFrame, lookup: DataFrame, content: str = "content") -> DataFrame:
    """Replace include tags by the looked-up code, by name, then by path.

    ``lookup`` has ``key`` and ``code``. Tags are exploded and joined, never the
    documents: a document without tags does not enter the shuffle. The join carries
    names and code only; texts are cut and put back together within their row. Equal
    texts have equal tags, so that a text's digest finds them: no document key is
    needed, and a null one loses nothing. The documents are written out first: they are
    read three times, and what made their texts is not to run for each filter on them.
    """
    docs = _written(docs)
    tagged = F.coalesce(F.col(content).contains("include_example") & F.rlike(F.col(content), F.lit(INCLUDE)), F.lit(False))
    digest = F.sha2(F.col(content), 256)
    tags = docs.where(tagged).select(
        digest.alias("_text"), F.posexplode(F.arrays_zip(
            F.regexp_extract_all(F.col(content), F.lit(INCLUDE), 1).alias("name"),
            F.regexp_extract_all(F.col(content), F.lit(INCLUDE), 2).alias("path"))).alias("no", "tag"))
    # written out: tags are few beside the texts they are found in, and read three times
    tags = checkpointed(tags.select("_text", "no", "tag.name", "tag.path").distinct(), "tags")
    # many documents name the same example: distinct pairs meet the lookup, once, under
    # both their keys; an empty text counts as no text, as for a missing key
    asked = tags.select("name", "path").distinct().select(
        "name", "path", F.posexplode(F.array("name", "path")).alias("choice", "key"))
    found = (
        lookup.where(F.col("code") != "").join(asked, "key")
        .groupBy("name", "path").agg(F.min_by("code", F.struct("choice", "code")).alias("code"))
    )
    text = F.when(F.col("code").isNotNull(), F.concat(F.lit("```\n"), F.col("code"), F.lit("\n```"))) \
        .otherwise(F.concat(F.lit("[Example: "), F.col("name"), F.lit(" ("), F.col("path"), F.lit(")]")))
    resolved = (
        tags.join(found, ["name", "path"], "left").select("_text", "no", text.alias("text"))
        .groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("no", "text"))).alias("_tags"))
    )
    filled = tx.interleave(F.split(F.col(content), INCLUDE, -1),
                           F.transform(F.col("_tags"), lambda t: t["text"]))
    return (
        docs.where(tagged).withColumn("_text", digest).join(resolved, "_text")
        .withColumn(content, filled).drop("_tags", "_text")
        .unionByName(docs.where(~tagged))
    )
