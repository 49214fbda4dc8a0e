"""Answering context: request, detected problems and the best hits as one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import source_label

MAX_HITS = 15
PREVIEW_CHARS = 1500

# The parts of the text.
PATTERNS_HEAD = "\n## Detected Patterns\n"
CONTEXT_HEAD = "\n## Retrieved Context\n"
TASK = ("\n## Task\n\nAnalyze the user's input using the retrieved context above. "
        "Provide root cause, recommendations, and relevant references.")
META_LABELS = {"file_path": "file: ", "doc_url": "doc: ", "question_id": "SO #",
               "issue_number": "issue #", "spark_version": "v"}


def _meta(hits: DataFrame):
    parts = [F.concat(F.lit(label), F.col(name).cast("string"))
             for name, label in META_LABELS.items() if name in hits.columns]
    joined = F.concat_ws(", ", *parts) if parts else F.lit("")
    return F.when(joined != "", F.concat(F.lit(" ("), joined, F.lit(")"))).otherwise("")


def build_context(parsed: DataFrame, hits: DataFrame, max_hits: int = MAX_HITS) -> DataFrame:
    """``request_id`` and ``context``.

    ``parsed``: request_id, input, input_type, patterns. ``hits``: request_id,
    position, source, content and any of the metadata columns, null where a source
    lacks one. At most ``max_hits`` short previews are gathered per request.
    """
    entry = F.concat(F.lit("### ["), F.col("position").cast("string"), F.lit("] "),
                     source_label(F.col("source")), _meta(hits), F.lit("\n```\n"),
                     F.left("content", F.lit(PREVIEW_CHARS)), F.lit("\n```"))
    context = (
        hits.where(F.col("position") <= max_hits).select("request_id", "position", entry.alias("entry"))
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("_entries"))
    )
    bullets = F.transform("patterns", lambda p: F.concat(
        F.lit("- **"), p["name"], F.lit("** ("), p["risk"], F.lit("): "), p["description"]))
    entries = F.transform("_entries", lambda e: e["entry"])
    head = F.concat(F.lit("## User Input ("), F.col("input_type"), F.lit(")\n\n"), F.col("input"))
    parts = F.flatten(F.array(
        F.array(head),
        F.when(F.size("patterns") > 0, F.concat(F.array(F.lit(PATTERNS_HEAD)), bullets)).otherwise(
            F.array().cast("array<string>")),
        F.when(F.col("_entries").isNotNull(), F.concat(F.array(F.lit(CONTEXT_HEAD)), entries)).otherwise(
            F.array().cast("array<string>")),
        F.array(F.lit(TASK))))
    return parsed.join(context, "request_id", "left").select(
        "request_id", F.array_join(parts, "\n").alias("context"))
