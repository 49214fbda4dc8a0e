"""Source files to code units.

A scan over a file's tokens finds the import block, the top-level classes and functions,
and the functions of classes, in Python, Scala and Java. It knows strings, comments and
nested brackets, so that several units may share a line and one header may take many.
It is no syntax tree; ``functions.scanner`` tells how a unit ends. Known misses: nested
quotes inside an interpolation, nested block comments.

The scan is one Arrow function whose work grows with the text. A file is one row and
stays one row until its units are exploded; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as pt, scanner, text as tx
from ..functions.ids import code_chunk_id
from ..functions.packing import pack_lines
from ..functions.rules import MAX_CHUNK_CHARS


def find_units(source: Column, language: Column) -> Column:
    """struct<imports, classes, methods> of one file, as ``scanner.units_of`` gives them.

    A function inside a function belongs to the outer one. A top-level Python definition
    under a decorator is left out, with all it contains. Modifiers and, in Scala and Java,
    annotations are part of their unit.
    """
    kinds = {"string": pa.string(), "int": pa.int32()}
    result = pa.struct([(part, pa.list_(pa.struct([(n, kinds[k]) for n, k in columns.items()])))
                        for part, columns in scanner.FIELDS.items()])

    @F.arrow_udf(scanner.UNITS)
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, languages in batches:
            yield pa.array([scanner.units_of(t.as_py(), n.as_py()) for t, n in zip(texts, languages)], result)

    # marked as such, a file is scanned once, however many expressions read its units
    return scan.asNondeterministic()(source, language)


def signature(text: Column) -> Column:
    """Text before the first brace, else colon, else arrow; else the first line."""
    found = tx.strip(F.substring_index(text, "\n", 1))
    for mark in ("=>", ":", "{"):
        before = tx.strip(F.substring_index(text, mark, 1))
        found = F.when(text.contains(mark) & (before != ""), before).otherwise(found)
    return found


def with_units(files: DataFrame) -> DataFrame:
    """Files of a known language with ``_units``, what was found in each."""
    return (
        files.withColumn("language", tx.detect_language(F.col("file_path")))
        .where(F.col("language").isNotNull())
        .withColumn("_units", find_units(F.col("content"), F.col("language"))).drop("content")
    )


def _summary_rows(units: Column) -> Column:
    """One entry per class with methods: kind and name, then the method signatures."""
    def summary(c: Column) -> Column:
        # a class's methods stand together
        methods = F.slice(units["methods"], c["first"], c["count"])
        sigs = F.filter(F.transform(methods, lambda m: signature(m["content"])), lambda s: s != "")
        head = F.concat(c["class_kind"], F.lit(" "), c["name"])
        listed = F.array_join(F.transform(sigs, lambda s: F.concat(F.lit("  "), s)), "\n")
        return F.struct(
            F.lit("class_summary").alias("chunk_type"), c["name"].alias("qualified_name"),
            head.alias("signature"),
            F.when(F.size(sigs) > 0, F.concat(head, F.lit("\n\nMethods:\n"), listed)).alias("content"),
            c["start"].alias("start_line"), c["end"].alias("end_line"))

    return F.filter(F.transform(units["classes"], summary), lambda s: s["content"].isNotNull())


def _import_rows(units: Column, path: Column) -> Column:
    imports = F.transform(units["imports"], lambda u: u["content"])
    row = F.struct(
        F.lit("imports").alias("chunk_type"), F.concat(path, F.lit(":imports")).alias("qualified_name"),
        F.lit("").alias("signature"), F.array_join(imports, "\n").alias("content"),
        F.lit(1).alias("start_line"), F.lit(0).alias("end_line"))
    return F.filter(F.array(row), lambda _: F.size(imports) > 0)


def _method_rows(units: Column) -> Column:
    return F.transform(units["methods"], lambda u: F.struct(
        F.lit("method").alias("chunk_type"),
        F.concat_ws(".", u["class_name"], u["name"]).alias("qualified_name"),
        signature(u["content"]).alias("signature"), u["content"].alias("content"),
        u["start"].alias("start_line"), u["end"].alias("end_line")))


def code_units(files: DataFrame) -> DataFrame:
    """One row per unit of files (``spark_version``, ``file_path``, ``content``, any keys):
    the import block, the summary of each class, each function or method."""
    units, path = F.col("_units"), F.col("file_path")
    rows = F.concat(_import_rows(units, path), _summary_rows(units), _method_rows(units))
    keep = [c for c in files.columns if c != "content"]
    return with_units(files).select(*keep, "language", F.inline(rows))


def class_summaries(files: DataFrame) -> DataFrame:
    keep = [c for c in files.columns if c != "content"]
    return with_units(files).select(*keep, "language", F.inline(_summary_rows(F.col("_units"))))


def enrich_units(units: DataFrame) -> DataFrame:
    """API names and problems of methods; other units have none."""
    is_method = F.col("chunk_type") == "method"
    no_apis = F.array().cast("array<string>")
    problems = pt.detect_patterns(F.col("content"))
    return (
        units.withColumn("spark_apis", F.when(
            is_method, pt.api_names(pt.detect_apis(F.col("content")))).otherwise(no_apis))
        .withColumn("problem_indicators", F.when(is_method, problems).otherwise(
            F.array().cast(pt.PROBLEMS)))
    )


def split_units(units: DataFrame, limit: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Methods over the limit cut by lines into ``name_partN``.

    Only the first part keeps signature, APIs and problems; each part starts after
    the lines before it. A method that cannot be cut keeps its name but loses these.
    """
    long = (F.col("chunk_type") == "method") & (F.length("content") > limit)
    pieces = F.when(long, pack_lines(F.col("content"), limit)).otherwise(F.array("content"))
    lines_before = F.aggregate(F.slice("_pieces", F.lit(1), F.col("part_no")), F.lit(0),
                               lambda n, p: n + F.size(F.split(p, "\n")))
    keeps = ~F.col("_long") | ((F.col("part_no") == 0) & (F.size("_pieces") > 1))
    numbered = F.concat("qualified_name", F.lit("_part"), F.col("part_no").cast("string"))
    rest = [c for c in units.columns if c != "content"]
    out = (
        units.withColumn("_long", long).withColumn("_pieces", pieces)
        .select(*rest, "_long", "_pieces", F.posexplode("_pieces").alias("part_no", "content"))
        .withColumn("qualified_name", F.when(F.size("_pieces") > 1, numbered)
                    .otherwise(F.col("qualified_name")))
        .withColumn("start_line", F.col("start_line") + lines_before)
        .withColumn("end_line", F.when(F.col("_long"), 0).otherwise(F.col("end_line")))
        .withColumn("signature", F.when(keeps, F.col("signature")).otherwise(""))
    )
    for name in ("spark_apis", "problem_indicators"):
        if name in units.columns:
            out = out.withColumn(name, F.when(keeps, F.col(name)).otherwise(
                F.filter(F.col(name), lambda _: F.lit(False))))
    return out.drop("_long", "_pieces")


def chunk_code(files: DataFrame) -> DataFrame:
    """Files to the rows of the code chunk table."""
    return split_units(enrich_units(code_units(files))).withColumn(
        "chunk_id", code_chunk_id(F.col("spark_version"), F.col("file_path"),
                                  F.col("qualified_name"), F.col("start_line")))
