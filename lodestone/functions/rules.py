"""Rule tables: plain data, and the types a caller fills to pass own rules.

Patterns of one-line rules match inside a line only. ``Rule.doc_pattern`` rewrites
``\\s`` so that the same rule can be run over a whole text in one pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    risk: str = ""
    description: str = ""
    # the rule is dropped for a text in which this pattern occurs anywhere
    unless: str = ""
    # a rule that may span lines and reports the matched text, not the line
    spans_lines: bool = False

    @property
    def doc_pattern(self) -> str:
        return self.pattern if self.spans_lines else in_line(self.pattern)

    @property
    def word(self) -> str:
        """A word that every match contains, or nothing if the pattern is not that simple.

        What stands in a group may be optional and doesn't count.
        """
        plain = re.sub(r"\\[bBsSwWdDnt]", " ", self.pattern)
        if re.search(r"\||\(\?|\[|[A-Za-z_][?*{]", plain):
            return ""
        while (outer := re.sub(r"(?<!\\)\((?:[^()\\]|\\.)*(?<!\\)\)[?*+]?", " ", plain)) != plain:
            plain = outer
        if re.search(r"(?<!\\)[()]", plain):
            return ""
        return max(re.findall(r"[A-Za-z_]+", plain), key=len, default="")


def in_line(pattern: str) -> str:
    """The pattern with white space and negated classes that cannot cross a line end."""
    return re.sub(r"(?<!\\)\[\^", r"[^\\n", pattern).replace(r"\s", r"[^\S\n]")


# API names and their patterns, in rule order.
API_RULES = (
    Rule("SparkSession.builder", r"SparkSession\.builder"),
    Rule("SparkContext", r"SparkContext\s*\("),
    Rule("DataFrame.select", r"\.select\s*\("),
    Rule("DataFrame.filter", r"\.filter\s*\("),
    Rule("DataFrame.where", r"\.where\s*\("),
    Rule("DataFrame.groupBy", r"\.groupBy\s*\("),
    Rule("DataFrame.agg", r"\.agg\s*\("),
    Rule("DataFrame.join", r"\.join\s*\("),
    Rule("DataFrame.union", r"\.union\s*\("),
    Rule("DataFrame.write", r"\.write\b"),
    Rule("DataFrame.read", r"\.read\b"),
    Rule("DataFrame.cache", r"\.cache\s*\("),
    Rule("DataFrame.persist", r"\.persist\s*\("),
    Rule("DataFrame.unpersist", r"\.unpersist\s*\("),
    Rule("DataFrame.collect", r"\.collect\s*\("),
    Rule("DataFrame.show", r"\.show\s*\("),
    Rule("DataFrame.toPandas", r"\.toPandas\s*\("),
    Rule("DataFrame.coalesce", r"\.coalesce\s*\("),
    Rule("DataFrame.repartition", r"\.repartition\s*\("),
    Rule("RDD.map", r"\.map\s*\("),
    Rule("RDD.flatMap", r"\.flatMap\s*\("),
    Rule("RDD.reduceByKey", r"\.reduceByKey\s*\("),
    Rule("RDD.groupByKey", r"\.groupByKey\s*\("),
    Rule("RDD.collect", r"\.collect\s*\("),
    Rule("broadcast", r"\bbroadcast\s*\("),
    Rule("udf", r"\budf\s*\("),
    Rule("window", r"Window\."),
    Rule("SparkSession.sql", r"\.sql\s*\("),
    Rule("collect_list", r"\bcollect_list\s*\("),
    Rule("collect_set", r"\bcollect_set\s*\("),
    Rule("explode", r"\bexplode\s*\("),
    Rule("pandas_udf", r"\bpandas_udf\b"),
)

# Problem patterns, in rule order.
PROBLEM_RULES = (
    Rule("collect_on_large", r"\.collect\s*\(", "HIGH",
         "collect() pulls entire dataset to driver memory"),
    Rule("collect_list_unbounded", r"\bcollect_list\s*\(", "HIGH",
         "collect_list() can exceed driver memory if group is large"),
    Rule("groupByKey", r"\.groupByKey\s*\(", "MEDIUM",
         "groupByKey shuffles all values per key into memory; prefer reduceByKey/aggregateByKey"),
    Rule("broadcast_large", r"\bbroadcast\s*\(", "HIGH",
         "broadcast() copies full dataset to every executor"),
    Rule("coalesce_one", r"\.coalesce\s*\(\s*1\s*\)", "MEDIUM",
         "coalesce(1) forces all data into a single partition"),
    Rule("toPandas_large", r"\.toPandas\s*\(", "HIGH",
         "toPandas() materializes entire DataFrame in driver memory"),
    Rule("cache_no_unpersist", r"\.(?:cache|persist)\s*\(", "LOW",
         "cache()/persist() without unpersist() leaks memory over long jobs",
         unless=r"\.unpersist\s*\("),
    Rule("repartition_to_one", r"\.repartition\s*\(\s*1\s*\)", "MEDIUM",
         "repartition(1) forces expensive full shuffle into single partition"),
    Rule("udf_over_builtin", r"\budf\s*\(", "LOW",
         "UDFs prevent Catalyst optimization; prefer built-in functions when possible"),
    Rule("collect_in_loop", r"for\s.*\n.*\.collect\s*\(", "HIGH",
         "collect() inside a loop creates repeated driver-side materialization",
         spans_lines=True),
    Rule("crossjoin", r"\.crossJoin\s*\(", "HIGH",
         "Cross join produces cartesian product — O(n*m) rows"),
)

# Error classes and their patterns, in rule order.
ERROR_RULES = (
    Rule("OutOfMemoryError", r"java\.lang\.OutOfMemoryError"),
    Rule("StackOverflowError", r"java\.lang\.StackOverflowError"),
    Rule("SparkException", r"org\.apache\.spark\.SparkException"),
    Rule("AnalysisException", r"org\.apache\.spark\.sql\.AnalysisException"),
    Rule("IllegalArgumentException", r"java\.lang\.IllegalArgumentException"),
    Rule("ClassNotFoundException", r"java\.lang\.ClassNotFoundException"),
    Rule("NullPointerException", r"java\.lang\.NullPointerException"),
    Rule("FileNotFoundException", r"java\.io\.FileNotFoundException"),
    Rule("TimeoutException", r"TimeoutException"),
    Rule("FetchFailedException", r"FetchFailedException"),
    Rule("ShuffleMapTask", r"ShuffleMapTask"),
    Rule("TaskKilled", r"TaskKilled"),
    Rule("ExecutorLostFailure", r"ExecutorLostFailure"),
    Rule("MetadataFetchFailedException", r"MetadataFetchFailedException"),
)

# Signs of a stack trace.
STACKTRACE_PATTERNS = (
    r"^\s+at\s+\w+",
    r"Caused by:",
    r"Exception in thread",
    r"Traceback \(most recent call last\)",
)

# What makes a line look like code (one point per group).
CODE_LINE_STARTS = ("def ", "val ", "var ", "class ", "import ", "from ", "public ", "private ")
CODE_LINE_ENDS = ("{", "}", ":", ")", ";")
CODE_COMMENT_STARTS = ("//", "#", "/*", "*")
CODE_LINE_SHARE = 0.3

# Reference patterns. \w is spelled out so that it covers all letters.
CONFIG_KEY = r"spark\.[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+"
VERSION_MENTION = r"(?i)(?:spark\s*)?v?([0-9]+\.[0-9]+(?:\.[0-9]+)?)"
VERSION_NUMBER = r"([0-9]+\.[0-9]+(?:\.[0-9]+)?)"
PR_REFERENCE = r"#([0-9]{4,6})|GH-([0-9]{4,6})|github\.com/apache/spark/pull/([0-9]+)"

# File endings by language, and endings of example code.
LANGUAGE_ENDINGS = {"scala": ".scala", "java": ".java", "python": ".py"}
EXAMPLE_ENDINGS = (".py", ".scala", ".java", ".r", ".R")

# Size limits in characters.
MAX_CHUNK_CHARS = 2048
MIN_PROSE_CHARS = 20

# Source weights by input type, and ranking boosts.
SOURCE_WEIGHTS = {
    "code": {"code": 0.4, "docs": 0.3, "qa": 0.2, "issues": 0.1},
    "logs": {"code": 0.15, "docs": 0.2, "qa": 0.35, "issues": 0.3},
    "question": {"code": 0.2, "docs": 0.35, "qa": 0.3, "issues": 0.15},
}
DEFAULT_WEIGHT = 0.1
API_BOOST = 0.05
VOTES_BOOST, VOTES_OVER = 0.03, 10
ACCEPTED_BOOST = 0.05
CLOSED_BOOST = 0.02
VERSION_BOOST = 0.04
# Sources in search order, and the names of their served tables.
SERVED_NAMES = {"code": "spark_code", "docs": "spark_docs", "qa": "spark_stackoverflow",
                "issues": "spark_issues"}
SOURCE_ORDER = ("code", "docs", "qa", "issues")
TOP_PER_SOURCE, TOP_TOTAL = 10, 20
BASELINE_VERSION = "4.1.0"
