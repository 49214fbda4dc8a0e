from conftest import plan_of
from pyspark.sql import functions as F

from lodestone.operators import code, markdown, threads

DOC = """Some words before any heading at all.
# Guide
Prose with spark.sql.shuffle.size in it, long enough.

```python
# a comment, not a heading
df.show()
```
## Setup
#### Deep
<table><tr><th>Key</th><th>Default</th></tr>
<tr><td>spark.a.b</td><td>4</td></tr></table>
More prose after the table, long enough.
```
```
## Other
tiny
# Second
""" + "\n\n".join("Paragraph %d with quite a few words in it." % i for i in range(80))


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"docs/{i}.md", "4.1.0", t) for i, t in enumerate(texts)],
                                 "doc_id int, file_path string, spark_version string, content string")


def test_markdown_chunks(spark):
    rows = markdown.chunk_documents(docs(spark, DOC, "  \n ")).orderBy("section_no", "part_no", "piece_no").collect()
    short = [(r.content_type, r.heading_hierarchy, r.related_configs, r.content) for r in rows if r.doc_section != "Second"]
    assert short == [
        ("prose", [], [], "Some words before any heading at all."),
        ("prose", ["Guide"], ["spark.sql.shuffle.size"], "Prose with spark.sql.shuffle.size in it, long enough."),
        ("code_example", ["Guide"], [], "# a comment, not a heading\ndf.show()"),
        ("config_table", ["Guide", "Setup", "Deep"], ["spark.a.b"], "Key | Default\nspark.a.b | 4"),
        ("prose", ["Guide", "Setup", "Deep"], [], "More prose after the table, long enough."),
    ]
    packed = [r for r in rows if r.doc_section == "Second"]
    assert len(packed) > 1 and all(len(r.content) <= 2200 for r in packed)
    assert all(r.doc_id == 0 for r in rows) and len({r.chunk_id for r in rows}) == len(rows)


def test_heading_inside_table_and_code(spark):
    text = "# A\n<table><tr><td>x\n```\ncode\n```\n</td></tr></table>\n##\n\nB\nbody text of section b, long"
    rows = markdown.chunk_documents(docs(spark, text)).orderBy("section_no").collect()
    assert [(r.content_type, r.heading_hierarchy, r.content) for r in rows] == [
        ("config_table", ["A"], "x\n\n__CODE_BLOCK_0__"),
        ("prose", ["A", "B"], "body text of section b, long")]


def test_includes(spark):
    lookup = spark.createDataFrame([("python/x.py", "print(1)"), ("named", "two"), ("blank", "")], "key string, code string")
    given = docs(spark, "a {% include_example n1 python/x.py %} b {%include_example named z%}.",
                 "{% include_example blank none %}", "no tag")
    out = {r.doc_id: r.content for r in markdown.resolve_includes(given, lookup).collect()}
    assert out == {0: "a ```\nprint(1)\n``` b ```\ntwo\n```.", 1: "[Example: blank (none)]", 2: "no tag"}
    # documents without a key, and repeated ones, lose nothing
    same = spark.createDataFrame([(None, "{% include_example named z %}"), (None, "{% include_example named z %}"), (3, None), (None, None)],
                                 "doc_id long, content string")
    assert sorted(str(r.content) for r in markdown.resolve_includes(same, lookup).collect()) == ["None", "None"] + ["```\ntwo\n```"] * 2


def test_includes_are_part_of_the_document_job(spark):
    lookup = spark.createDataFrame([("named", "# no heading\nx = 1")], "key string, code string")
    rows = markdown.chunk_documents(docs(spark, "# A\nsome prose before the tag, long enough\n{% include_example named z %}\n"), lookup)
    assert [(r.content_type, r.content) for r in rows.orderBy("part_no").collect()] \
        == [("prose", "some prose before the tag, long enough"), ("code_example", "# no heading\nx = 1")]


def test_control_characters_of_the_text_stay(spark):
    odd = "".join(map(chr, range(1, 7))) * 2
    text = f"# H{odd}\nprose {odd} that is long enough here\x01b\n```\ncode{odd}\nb\x02\n```\n<table><tr><td>{odd}c</td></tr></table>\n\x02tail with a mark first, long enough"
    rows = markdown.chunk_documents(docs(spark, text)).orderBy("part_no").collect()
    assert [(r.content_type, r.heading_hierarchy, r.content) for r in rows] == [
        ("prose", [f"H{odd}"], f"prose {odd} that is long enough here\x01b"), ("code_example", [f"H{odd}"], f"code{odd}\nb\x02"),
        ("config_table", [f"H{odd}"], f"{odd}c"), ("prose", [f"H{odd}"], "\x02tail with a mark first, long enough")]


def test_document_chunking_is_narrow_and_native(spark):
    plan = plan_of(markdown.chunk_documents(docs(spark, DOC).repartition(4)))
    assert plan.count("Exchange") == 1 and "Python" not in plan


PYTHON = '''from __future__ import annotations
import os
from a import (
    b,
)
def top(a, b):
    """Words
at column zero
    """
    def inner():
        pass

    return 1

# note
@wrapped
class Gone:
    def f(self): pass

class K(Base):
    """No unit:
    def no(self): pass
    """
    @property
    def m1(self) -> int:
        for x in y:
            df.collect()
    # note
    async def m2(
        self,
    ):
        return 1

    class In:
        def m3(self): return 1
'''
SCALA = '''package org.x
import a.b

private[x] class Foo(a: Int)
  extends Bar {
  override def run(x: Int): Unit = {
    def nested(): Int = 1
  }

  def short = 1
}

object Foo {
  def apply(
      a: Int): Foo =
    new Foo(a)
}
'''
JAVA = '''package a.b;
import x.Y;

public final class Q<T> extends Z {
  private int f = foo(1);

  public Q(int a) {
    this.f = a;
  }

  @Override
  public <U> List<U> get(String a,
      int b) throws E {
    if (a) { b(); }
    return null;
  }
}
'''


def files(spark, **sources):
    return spark.createDataFrame([(p.replace("_", "."), "4.1.0", s) for p, s in sources.items()],
                                 "file_path string, spark_version string, content string")


def units(spark, name, source):
    rows = code.chunk_code(files(spark, **{name: source})).collect()
    return {r.qualified_name: r for r in rows if r.chunk_type == "method"}, \
        {r.qualified_name: r for r in rows if r.chunk_type != "method"}


def test_python_units(spark):
    methods, others = units(spark, "a_py", PYTHON)
    assert {n: (m.start_line, m.end_line) for n, m in methods.items()} == {
        "top": (6, 13), "K.m1": (25, 27), "K.m2": (29, 32), "K.m3": (35, 35)}
    assert methods["top"].signature == "def top(a, b)"
    assert methods["K.m1"].spark_apis == ["DataFrame.collect", "RDD.collect"]
    assert [p.name for p in methods["K.m1"].problem_indicators] == ["collect_on_large", "collect_in_loop"]
    assert others["a.py:imports"].content == "import os\nfrom a import (\n    b,\n)"
    assert others["K"].content.startswith("class K\n\nMethods:\n  def m1(self) -> int\n")


def test_scala_units(spark):
    methods, others = units(spark, "a_scala", SCALA)
    assert {n: (m.start_line, m.end_line) for n, m in methods.items()} == {
        "Foo.run": (6, 8), "Foo.short": (10, 10), "Foo.apply": (14, 16)}
    assert methods["Foo.run"].signature == "override def run(x: Int): Unit ="
    assert others["a.scala:imports"].content == "package org.x\nimport a.b"


def test_java_units(spark):
    methods, others = units(spark, "a_java", JAVA)
    assert {n: (m.start_line, m.end_line) for n, m in methods.items()} == {"Q.Q": (7, 9), "Q.get": (11, 16)}
    assert methods["Q.get"].content.startswith("@Override\n  public <U> List<U> get(")
    assert others["Q"].signature == "class Q" and others["Q"].start_line == 4


def test_annotations_belong_to_the_next_header_only(spark):
    source = "@Service\n@Named(\"a\")\nclass A {\n  @Inject\n  private int f;\n  void g() {\n  }\n}\n"
    methods, others = units(spark, "a_java", source)
    assert others["A"].start_line == 1 and methods["A.g"].start_line == 6


def test_unknown_endings_give_nothing(spark):
    assert code.chunk_code(files(spark, a_txt=PYTHON)).count() == 0


def test_long_units(spark):
    body = "".join(f"    x{i} = df.select('column number {i}').collect()\n" for i in range(200))
    rows = code.chunk_code(files(spark, a_py="def big(df):\n" + body)).orderBy("start_line").collect()
    assert [r.qualified_name for r in rows] == [f"big_part{i}" for i in range(len(rows))] and len(rows) > 1
    assert [r.signature for r in rows] == ["def big(df)"] + [""] * (len(rows) - 1)
    assert rows[0].spark_apis and not any(r.spark_apis for r in rows[1:])
    assert all(b.start_line == a.start_line + a.content.count("\n") + 1 for a, b in zip(rows, rows[1:]))
    assert all(r.end_line == 0 for r in rows)
    single = code.chunk_code(files(spark, a_py="def one(): return " + "x" * 3000)).first()
    assert (single.qualified_name, single.signature, single.part_no) == ("one", "", 0)


def test_question_threads(spark):
    item = [(7, "Out of memory", "<p>java.lang.OutOfMemoryError on Spark 3.5</p>", 12, ["apache-spark"],
             [(1, "<p>Avoid <code>df.collect()</code> in 4.0</p>", 3, True), (2, "<p>No idea</p>", -1, None)]),
            (8, "Empty", None, None, None, None)]
    schema = ("question_id long, title string, body string, score long, tags array<string>, "
              "answers array<struct<answer_id:long,body:string,score:long,is_accepted:boolean>>")
    rows = threads.chunk_qa(threads.qa_messages(spark.createDataFrame(item, schema))).collect()
    seven = [r for r in rows if r.question_id == 7]
    assert [(r.is_question, r.is_accepted, r.score, r.error_type) for r in seven] == [
        (True, False, 12, "OutOfMemoryError"), (False, True, 3, ""), (False, False, -1, "")]
    assert seven[0].content == "Out of memory\n\njava.lang.OutOfMemoryError on Spark 3.5"
    assert seven[1].spark_apis_mentioned == ["DataFrame.collect", "RDD.collect"]
    assert seven[1].spark_versions_mentioned == ["4.0"] and seven[1].tags == ["apache-spark"]
    eight = [r for r in rows if r.question_id == 8]
    assert [(r.content, r.score, r.tags) for r in eight] == [("Empty\n\n", 0, [])]


def test_issues(spark):
    schema = ("number long, title string, body string, state string, user struct<login:string>, "
              "labels array<struct<name:string>>, milestone struct<title:string>, created_at string, closed_at string, "
              "comments_data array<struct<body:string,user:struct<login:string>,created_at:string>>")
    items = [(5, "Slow join", None, "open", ("ann",), [("affects-3.5.1",)], ("4.1.0",), "d0", None,
              [("see #47001 on 4.0", ("bob",), "d1"), (None, None, "d2")])]
    rows = threads.chunk_issues(threads.issue_messages(spark.createDataFrame(items, schema))).collect()
    assert [(r.is_comment, r.content, r.author, r.closed_at, r.spark_versions_mentioned, r.linked_prs) for r in rows] == [
        (False, "Slow join\n\n", "ann", "", ["3.5.1", "4.1.0"], []),
        (True, "see #47001 on 4.0", "bob", "", ["4.0"], [47001]), (True, "", "", "", [], [])]
    assert all(r.labels == ["affects-3.5.1"] and r.parent_issue_number == 5 and r.state == "open" for r in rows)


def test_comments_of_issues_without_any_are_not_attached(spark):
    issues = spark.createDataFrame([(1, "a", "b", "open", "x", 0), (2, "a", "b", "open", "x", 1)],
                                   "number long, title string, body string, state string, author string, comments int") \
        .select("*", F.array().cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("milestone"),
                F.lit("").alias("created_at"), F.lit(None).cast("string").alias("closed_at"))
    comments = spark.createDataFrame([(1, "c", "y", ""), (2, "c", "y", ""), (3, "c", "y", "")],
                                     "number long, body string, author string, created_at string")
    out = threads.attach_comments(issues, comments)
    assert sorted((r.number, r.is_comment) for r in out.collect()) == [(1, False), (2, False), (2, True)]


def test_dedup_keeps_the_first_in_order(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "chunk_id string, n int")
    out = threads.dedup_latest(rows, [-F.col("n")])
    assert plan_of(out).count("Exchange") == 1
    assert sorted((r.chunk_id, r.n) for r in out.collect()) == [("a", 3), ("b", 2)]


def test_costly_folds_stand_once_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "# A\n```\nx\n```\n<table><tr><td>\x01</td></tr></table>")], "doc_id int, content string")
    plan = plan_of(markdown.split_sections(docs))
    assert plan.count("(?dms)^```") == 2  # the blocks are found, and the text is split at them


def test_includes_keep_untyped_columns(spark):
    docs = spark.createDataFrame([(1, "a {% include_example k p %} b"), (2, None), (3, "plain")], "doc_id int, content string") \
        .select(F.lit(None).alias("nothing"), "doc_id", "content")
    lookup = spark.createDataFrame([("k", "code")], "key string, code string")
    out = markdown.resolve_includes(docs, lookup)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.nothing, r.content or "") for r in out.collect()) \
        == [(1, None, "a ```\ncode\n``` b"), (2, None, ""), (3, None, "plain")]
