import pytest
from pyspark.sql import functions as F

from lodestone.functions import patterns as pt, rules

T = F.col("t")


def names(value, text):
    return value(pt.pattern_names(pt.detect_patterns(T)), t=text)


def test_each_api_once_with_its_first_line(value):
    found = value(pt.detect_apis(T), t="😀\nx.select(a)\ny.collect ()\nx.select(b).where(c)")
    assert [(h.api, h.line) for h in found] == [
        ("DataFrame.select", 2), ("DataFrame.collect", 3), ("RDD.collect", 3), ("DataFrame.where", 4)]


def test_rules_do_not_cross_lines(value):
    assert value(pt.detect_apis(T), t="df.select\n(a)") == []


@pytest.mark.parametrize("text, found", [
    ("df.coalesce( 1 ).write", ["coalesce_one"]),
    ("df.coalesce(10)", []),
    ("df.repartition(1)", ["repartition_to_one"]),
    ("df.cache()\nuse(df)", ["cache_no_unpersist"]),
    ("df.cache()\ndf.unpersist()", []),
    ("for k in keys:\n    df.collect()", ["collect_on_large", "collect_in_loop"]),
    ("for k in keys:\n    pass\n    df.collect()", ["collect_on_large"]),
    ("a.crossJoin(b)\nrdd.groupByKey()", ["groupByKey", "crossjoin"]),
    ("f = udf(g); broadcast(x); collect_list('a'); df.toPandas()",
     ["collect_list_unbounded", "broadcast_large", "toPandas_large", "udf_over_builtin"]),
    ("plain text", []),
])
def test_problems(value, text, found):
    assert names(value, text) == found


def test_line_and_text_of_a_problem(value):
    hits = value(pt.detect_patterns(T), t="\n\n  for a in b:\n\tx.collect()  \n")
    assert [(h.name, h.line, h.match_text) for h in hits] == [
        ("collect_on_large", 4, "x.collect()"), ("collect_in_loop", 3, "for a in b:\n\tx.collect(")]


def test_own_rules(value):
    own = (rules.Rule("sleep", r"\bsleep\s*\(", "LOW", "waits"),)
    hits = value(pt.detect_patterns(T, own), t="a\nsleep (1)")
    assert [(h.name, h.risk, h.line) for h in hits] == [("sleep", "LOW", 2)]


def test_record(value):
    record = value(pt.pattern_record(T), t="df.read.parquet(x).collect()")
    assert record.apis == ["DataFrame.read", "DataFrame.collect", "RDD.collect"] and record.has_problems
    assert value(pt.pattern_json(pt.pattern_record(T)), t="plain") == '{"apis":[],"patterns":[]}'


def test_every_rule_has_a_text(spark, sf):
    from lodestone.plans.registry import QUERIES
    rows = QUERIES["detect_every_rule"](spark, sf).collect()
    seen = lambda c: {name for r in rows for name in r[c].split("|")}
    assert seen("apis") >= {r.name for r in rules.API_RULES}
    assert seen("patterns") >= {r.name for r in rules.PROBLEM_RULES}
    assert seen("error_types") == {r.name for r in rules.ERROR_RULES}
    assert any("unpersist" in r.apis and "cache_no_unpersist" not in r.patterns for r in rows)
