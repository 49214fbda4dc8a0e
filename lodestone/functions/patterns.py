"""API and problem detection: every rule is one literal pattern run over the whole
text, so a document needs no line table, no join to a rule table and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules
from .text import matches, strip

PROBLEMS = "array<struct<name:string,risk:string,description:string,line:int,match_text:string>>"

# ``.``, ``^`` and ``$`` know only the line feed as a line end
_UNIX = "(?d)"


def _first_line(text: Column, rule: rules.Rule) -> Column:
    """1-based number of the line where the rule first matches, else null."""
    pattern = _UNIX + rule.doc_pattern
    before = F.split(text, pattern, 2)[0]
    line = F.length(before) - F.length(F.translate(before, "\n", "")) + 1
    return F.when(matches(text, rule, pattern), line)


def detect_apis(text: Column, api_rules=rules.API_RULES) -> Column:
    """array<struct<line, rule_no, api>> in order of first line, then rule order."""
    hits = F.array(*[
        F.struct(_first_line(text, r).alias("line"), F.lit(i).alias("rule_no"),
                 F.lit(r.name).alias("api"))
        for i, r in enumerate(api_rules)])
    return F.array_sort(F.filter(hits, lambda h: h["line"].isNotNull()))


def api_names(apis: Column) -> Column:
    return F.transform(apis, lambda a: a["api"])


def detect_patterns(text: Column, problem_rules=rules.PROBLEM_RULES) -> Column:
    """array<struct<name, risk, description, line, match_text>> in rule order."""
    lines = F.split(text, "\n")

    def hit(rule: rules.Rule) -> Column:
        line = _first_line(text, rule)
        if rule.unless:
            line = F.when(~F.rlike(text, F.lit(rule.unless)), line)
        if rule.spans_lines:
            matched = strip(F.regexp_extract(text, f"{_UNIX}({rule.doc_pattern})", 1))
        else:
            matched = strip(F.try_element_at(lines, line))
        return F.when(line.isNotNull(), F.struct(
            F.lit(rule.name).alias("name"), F.lit(rule.risk).alias("risk"),
            F.lit(rule.description).alias("description"), line.alias("line"),
            matched.alias("match_text")))

    return F.filter(F.array(*[hit(r) for r in problem_rules]), lambda h: h.isNotNull())


def pattern_names(patterns: Column) -> Column:
    return F.transform(patterns, lambda p: p["name"])


def pattern_record(text: Column) -> Column:
    """struct<apis, patterns, has_problems> of one text."""
    patterns = detect_patterns(text)
    return F.struct(api_names(detect_apis(text)).alias("apis"), patterns.alias("patterns"),
                    (F.size(patterns) > 0).alias("has_problems"))


def pattern_json(record: Column) -> Column:
    """The record as JSON: API names, and name, risk and description per problem."""
    return F.to_json(F.struct(
        record["apis"].alias("apis"),
        F.transform(record["patterns"], lambda p: F.struct(p["name"], p["risk"], p["description"]))
        .alias("patterns")))
