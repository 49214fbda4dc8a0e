"""Derived inputs over the given tables, as SQL that both Spark and DuckDB run.

``NL`` stands for the line feed of the dialect. ``frame`` reads a view in Spark;
``cte`` gives its text for the other engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions import rules
from .sources.scan import read_table

VIEWS = {
    "md_docs": """
select doc_id, concat('docs/', source, '/', cast(doc_id as string), '.md') as file_path,
  case when doc_id % 2 = 0 then '4.1.0' else '3.5.4' end as spark_version,
  concat('# Guide ', source, NL, NL, text, NL, NL, '## Config ', cast(doc_id % 7 as string), NL, NL,
   'Set spark.sql.k', cast(doc_id % 5 as string), '.enabled and spark.app.size here.', NL, NL,
   '```python', NL, '# not a heading', NL, 'df.collect()', NL, '```', NL, NL,
   case when doc_id % 3 = 0 then concat('#### Deep', NL, NL, '{% include_example ex', cast(doc_id % 4 as string), ' python/ex.py %}', NL, NL) else '' end,
   '<table><tr><th>Property</th><th>Default</th></tr><tr><td>spark.a.b', cast(doc_id % 9 as string), '</td><td>', cast(n_chars as string), '</td></tr></table>', NL) as content
 from documents""",
    "qa_items": """
select conv_id as question_id, turn, case when role = 'system' then 's' when turn = q_turn then 'q' else 'a' end as kind,
  concat('<p>', text, '</p><p>Spark ', cast(3 + conv_id % 2 as string), '.', cast(turn % 6 as string),
   case when conv_id % 3 = 0 then ' <code>java.lang.OutOfMemoryError</code> <code>df.collect()</code>' else '' end, '</p>') as body_html,
  cast((conv_id * 7 + turn * 3) % 30 as bigint) as score, coalesce(turn = a_turn, false) as is_accepted
 from conversations c join (select conv_id as q_conv, min(case when role = 'user' then turn end) as q_turn,
              min(case when role = 'assistant' then turn end) as a_turn from conversations group by conv_id) g on conv_id = q_conv""",
    "issue_items": """
select 10000 + conv_id as issue_number, turn, turn > 0 as is_comment,
  case when conv_id % 3 = 0 then 'open' else 'closed' end as state, concat('user', cast((conv_id + turn) % 17 as string)) as author,
  concat(text, NL, 'See #', cast(47000 + conv_id as string), ' and GH-', cast(48000 + turn as string), ' on Spark 4.1.', cast(turn % 3 as string)) as body,
  case when conv_id % 2 = 0 then concat('affects-', '4.', cast(conv_id % 3 as string)) else 'bug' end as label
 from conversations""",
    "log_texts": """
select event_id, case when event_type = 'error' then concat(case event_id % 3 when 0 then 'java.lang.OutOfMemoryError: heap' when 1 then 'org.apache.spark.SparkException: job aborted' else 'FetchFailedException: lost block' end, NL, '    at org.apache.spark.Task', cast(user_id as string))
   when event_type = 'click' then concat('import x', NL, 'df = spark.table(', cast(user_id as string), ')', NL, 'df.collect()') else concat('How do I tune user ', cast(user_id as string), '?') end as input from events""",
    "code_files": """
select p_partkey, concat('core/src/f', cast(p_partkey as string), '.py') as file_path, case when p_partkey % 2 = 0 then '4.1.0' else '3.5.4' end as spark_version,
  concat('import os', NL, 'from pyspark.sql import functions as F', NL, NL, 'def load', cast(p_size as string), '(spark):', NL, '    return spark.read.parquet(', cast(p_size as string), ')', NL, NL,
   'class C', cast(p_partkey % 50 as string), ':', NL, '    def run(self, df):', NL, '        for k in keys:', NL, '            df.filter(k).collect()', NL, '    def save(self, df):', NL, '        df.coalesce(1).write.csv("o")', NL) as content from part""",
    "vec_chunks": """
select vec_id, case vec_id % 4 when 0 then 'code' when 1 then 'docs' when 2 then 'qa' else 'issues' end as source,
  case when vec_id % 2 = 0 then '4.1.0' else '3.5.4' end as spark_version, cast(vec_id % 25 as bigint) as score, vec_id % 5 = 0 as is_accepted, case when vec_id % 3 = 0 then 'open' else 'closed' end as state, label, embedding from embeddings""",
}
VIEWS["vec_facts"] = f"""
select *, split(case vec_id % 3 when 0 then 'DataFrame.collect,RDD.collect' when 1 then 'DataFrame.select' else 'RDD.map' end, ',') as apis,
  split(case when vec_id % 8 < 4 then '4.1.0,3.5' else '3.5.4' end, ',') as versions
 from ({VIEWS["vec_chunks"]}) v"""
VIEWS["long_code"] = """
select doc_id, concat('core/long/d', cast(doc_id as string), '.py') as file_path, '4.1.0' as spark_version,
  concat('class D', cast(doc_id as string), ':', NL, '    def run(self):', NL, '        ',
   replace(text, NL, concat(NL, '        ')), NL, '        return 1', NL) as content from documents"""
VIEWS["issue_threads"] = f"""
select issue_number, turn, is_comment, state, author, body, label, case when turn = 0 then concat('Issue ', cast(issue_number as string)) end as title,
  case when issue_number % 5 = 0 then 'Release 4.1.0' end as milestone,
  concat('2024-01-01T00:00:', lpad(cast(turn as string), 2, '0'), 'Z') as created_at,
  case when state = 'closed' and turn = 0 then '2024-02-01T00:00:00Z' end as closed_at
 from ({VIEWS["issue_items"]}) i"""
VIEWS["qa_threads"] = f"""
select question_id, turn, kind, kind = 'q' as is_question, case when kind = 'q' then concat('Question ', cast(question_id as string)) end as title,
  body_html as body, score, is_accepted
 from ({VIEWS["qa_items"]}) i"""

# sources of three languages: strings and comments that look like code, decorators, several
# headers on a line, headers over several lines; {n} and {size} differ by file
UNIT_SOURCES = {
    "py": """import os
from a import (
    b,
)

@wrapped
def gone(x):
    return x

class K{n}(Base):
    '''Text: def no(self): {
    class No:'''
    @property
    def run(self, df):
        s = "} # not a comment"
        return df.collect()

def top{size}(a):
    return a
""",
    "scala": """package org.x
import a.{B, C}

class K{n}(a: Int)
  extends Bar { def one = 1; def two(x: Int): Int = { x + a } }

object K{n} {
  val s = "} def no = 1" // def no2 = {
  /* def no3 = { */
  def apply(
      a: Int): K{n} =
    new K{n}(a)
  def run(df: D) = df.collect()
}
""",
    "java": """package a.b;
import x.Y;

public final class K{n}<T> extends Z {
  private Runnable r = new Runnable() { public void go() { x(); } };
  @Override public <U> List<U> get(String a,
      int b) throws E { String s = "} void no() {"; return null; } void two() { d.collect(); }
  abstract int last(int a);
}
interface I{size} { int one(int a); default int two() { return 2; } }
""",
}


def filled(template: str) -> str:
    """A template over ``part`` as an SQL expression."""
    quoted = template.replace("'", "''").replace("\n", "', NL, '")
    for name, value in (("n", "p_partkey % 50"), ("size", "p_size")):
        quoted = quoted.replace(f"{{{name}}}", f"', cast({value} as string), '")
    return f"concat('{quoted}')"


VIEWS["unit_files"] = f"""
select p_partkey, p_size, concat('core/f', cast(p_partkey as string), case p_partkey % 3 when 0 then '.py' when 1 then '.scala' else '.java' end) as file_path,
  case when p_partkey % 2 = 0 then '4.1.0' else '3.5.4' end as spark_version,
  case p_partkey % 3 when 0 then {filled(UNIT_SOURCES["py"])} when 1 then {filled(UNIT_SOURCES["scala"])} else {filled(UNIT_SOURCES["java"])} end as content
 from part"""



def sample(pattern: str) -> str:
    """A text that a rule's pattern matches."""
    out = re.sub(r"\(\?:([^|)]*)[^)]*\)", r"\1", pattern)
    for part, text in ((r"\s*", " "), (r"\s", " "), (r"\b", ""), (r"\n", "\n"), (".*", "k"), ("\\", "")):
        out = out.replace(part, text)
    return out


def picked(rule_list, number: str) -> str:
    """The sample of one rule of a list, by number, as an SQL expression."""
    cases = " ".join(f"when {i} then {filled(sample(r.pattern))}" for i, r in enumerate(rule_list))
    return f"case {number} % {len(rule_list)} {cases} end"


# every rule of every list stands in some text; a third of the texts drop the cache rule
VIEWS["rule_texts"] = f"""
select p_partkey, concat('plain', NL, 'x ', {picked(rules.API_RULES, "p_partkey")}, ' a)', NL, 'y = ', {picked(rules.PROBLEM_RULES, "p_partkey")}, NL,
  case when p_partkey % 3 = 0 then concat('y.unpersist()', NL) else '' end, 'at ', {picked(rules.ERROR_RULES, "p_partkey")}, ': lost', NL) as content from part"""
VIEWS["mark_docs"] = f"""
select doc_id, file_path, spark_version, translate(content, 'jwzvJ', concat(chr(1), chr(2), chr(3), chr(4), chr(5))) as content from ({VIEWS["md_docs"]}) m"""
# tables that a tag-by-tag reading must follow: see the oracle for what they say
VIEWS["table_docs"] = """
select doc_id, concat('before <table class="a"><tr><th>Key</th><th>Value &amp; more</th></tr><tr><td>in<table border=1><tr><td> x', cast(n_chars as string),
   ' </td><td>y</td></tr></table> cut </td></tr></table> between <TABLE><TR><TD>a', cast(doc_id as string), '<TD><b>b</b> c<TR><TD>d</TABLE> and <table><tr></tr><p>no cells</p></table>',
   '<table><tr><td>e<br/>f<!-- <td>g</td> --></b></td><th>', lang, '</th><script>h</script></tr></table>') as content
 from documents"""

# the chunk tables of the four sources, with vectors and texts
VIEWS["served_rows"] = f"""
select f.*, coalesce(text, '') as content from ({VIEWS["vec_facts"]}) f left join (select doc_id, text from documents) d on doc_id = vec_id"""
VIEWS["code_served"] = f"""
select vec_id as chunk_id, embedding as vec, content, spark_version, concat('core/src/f', cast(vec_id % 40 as string), '.py') as file_path, 'python' as language,
  case when vec_id % 8 = 0 then 'class_summary' else 'method' end as chunk_type, concat('C', cast(vec_id % 50 as string), '.run') as qualified_name,
  concat('def run', cast(vec_id as string), '(self)') as signature, apis as spark_apis,
  case when vec_id % 16 = 0 then 'collect_in_loop,coalesce_one' else 'cache_no_unpersist' end as problems from ({VIEWS["served_rows"]}) r where source = 'code'"""
VIEWS["docs_served"] = f"""
select vec_id as chunk_id, embedding as vec, content, spark_version, concat('docs/guide', cast(vec_id % 30 as string), '.md') as doc_url, 'Guide' as doc_section,
  split(concat('Guide,Part ', cast(vec_id % 7 as string)), ',') as heading_hierarchy, case when vec_id % 3 = 0 then 'config_table' else 'prose' end as content_type,
  split(concat('spark.sql.k', cast(vec_id % 5 as string)), ',') as related_configs from ({VIEWS["served_rows"]}) r where source = 'docs'"""
VIEWS["qa_served"] = f"""
select vec_id as chunk_id, embedding as vec, content, vec_id * 10 as question_id, vec_id % 4 = 2 as is_question, score, is_accepted, split('apache-spark,join', ',') as tags,
  case when vec_id % 6 = 0 then 'OutOfMemoryError' else '' end as error_type, apis as spark_apis_mentioned, versions as spark_versions_mentioned
 from ({VIEWS["served_rows"]}) r where source = 'qa'"""
VIEWS["issues_served"] = f"""
select vec_id as chunk_id, embedding as vec, content, 10000 + vec_id as issue_number, state, vec_id % 8 = 7 as is_comment, 10000 + vec_id as parent_issue_number,
  concat('user', cast(vec_id % 17 as string)) as author, split('bug', ',') as labels, '2024-01-01T00:00:00Z' as created_at,
  case when state = 'closed' then '2024-02-01T00:00:00Z' else '' end as closed_at, versions as spark_versions_mentioned, concat('4', cast(7000 + vec_id as string)) as pr
 from ({VIEWS["served_rows"]}) r where source = 'issues'"""

_TABLES = ("documents", "pages", "conversations", "embeddings", "events", "labels", "benchmark",
           "part", "orders", "lineitem", "customer", "supplier", "nation", "region")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in ``sf_dir``; only the tables it names are opened."""
    sql = VIEWS[name].replace("NL", r"'\n'")
    sources = {t: read_table(spark, f"{sf_dir}/{t}.parquet")
               for t in _TABLES if re.search(rf"\bfrom {t}\b", sql)}
    for t in sources:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    # all other braces are text, not parameters
    marks = {f"{{{t}}}": f"\x00{t}\x00" for t in sources}
    for name, mark in marks.items():
        sql = sql.replace(name, mark)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for name, mark in marks.items():
        sql = sql.replace(mark, name)
    return spark.sql(sql, **sources)


def cte(name: str) -> str:
    """``name as (...)`` in DuckDB's dialect."""
    return f"{name} as ({VIEWS[name].replace('NL', 'chr(10)')})"
