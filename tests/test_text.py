import hashlib
import random
import uuid
from html.parser import HTMLParser

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import ids, packing, text as tx

T = F.col("t")


# ---- packing ----

def greedy(parts, sep, limit):
    out, open_, n = [], [], 0
    for p in parts:
        if open_ and n + len(p) > limit:
            out.append(sep.join(open_))
            open_, n = [], 0
        open_.append(p)
        n += len(p) + len(sep)
    return out + ([sep.join(open_)] if open_ else [])


def paragraphs(text, limit):
    if len(text) <= limit:
        return [text]
    out, run = [], []
    for p in text.split("\n\n"):
        if len(p) > limit:
            out += greedy(run, "\n\n", limit) + greedy(p.split("\n"), "\n", limit)
            run = []
        else:
            run.append(p)
    return out + greedy(run, "\n\n", limit)


def test_packing_equals_a_plain_loop(spark):
    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text("ab😀 \n", max_size=60), min_size=200, max_size=200))
    def check(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        for r in rows.select("t", packing.pack_lines(T, 7).alias("l"),
                             packing.pack_paragraphs(T, 9).alias("p")).collect():
            assert r.l == greedy(r.t.split("\n"), "\n", 7)
            assert r.p == paragraphs(r.t, 9)
            assert "\n".join(r.l) == r.t

    check()


def test_long_line_is_kept_whole(value):
    assert value(packing.pack_lines(T, 10), t="x" * 25 + "\nab") == ["x" * 25, "ab"]


def test_short_paragraphs_give_bounded_pieces(value):
    pieces = value(packing.pack_paragraphs(T), t="\n\n".join(f"Paragraph {i} " + "word " * 10 for i in range(100)))
    assert len(pieces) > 1 and all(len(p) <= 2200 for p in pieces)


# ---- ids ----

def test_ids_are_rfc_4122(value):
    for name in ("4.1.0:core/a.py:f:1", "ünïcode:键", ""):
        assert value(ids.uuid5(T), t=name) == str(uuid.uuid5(uuid.UUID(ids.NAMESPACE), name))
    assert value(ids.content_hash(T), t="héllo") == hashlib.sha256("héllo".encode()).hexdigest()[:16]


def test_question_and_answer_ids_differ(value):
    q, a = (value(ids.qa_chunk_id(F.lit(5), F.lit(flag), T), t="same") for flag in (True, False))
    assert q != a and q == value(ids.qa_chunk_id(F.lit(5), F.lit(True), T), t="same")


# ---- HTML ----

@pytest.mark.parametrize("html, text", [
    ("<p>Hello <b>big</b> world</p>", "Hello\nbig\nworld"),
    ("a&nbsp;<br/> &nbsp; <i>b</i>", "a\nb"),
    ("x<!-- no --> y<script>var a='<p>';</script><style>p{}</style>z", "x\ny\nz"),
    ("1 < 2 &amp;&lt;b&gt; &copy; &#8364; &#x20AC; &#150;", "1 < 2 &<b> © € € –"),
    ("&nosuch; &amp", "&nosuch &"),
    ('<a title="a>b" href=\'c>d\'>t</a>', "t"),
    ("<!DOCTYPE html><template>no</template>yes", "yes"),
    ("line one\n  line two", "line one\n  line two"),
    ("", ""), ("<p> </p>", ""),
])
def test_html_to_text(value, html, text):
    assert value(tx.html_to_text(T), t=html) == text


def test_long_attributes_need_no_stack(value):
    assert value(tx.html_to_text(T), t=f'<p x="{"y" * 200000}" z={"w" * 100000}>t</p>') == "t"


def test_table_rows(value):
    html = ("<TABLE class='c'><tr><th>Name</th><th>Value</th></tr>\n<tr><td><code>spark.a.b</code> <i>x</i></td>"
            "<td>\n 1 &amp; 2</td></tr><tr></tr></TABLE>")
    assert value(tx.table_to_text(T), t=html) == "Name | Value\nspark.a.bx | 1 & 2"


# ---- mentions ----

@pytest.mark.parametrize("text, found", [
    ("Spark 3.5 and v3.5.4, spark4.0; again 3.5", ["3.5", "3.5.4", "4.0"]),
    ("100.200.300", []), ("0.9 and 10.1", []), ("02.5", ["02.5"]), ("nothing", []),
])
def test_version_mentions(value, text, found):
    assert value(tx.version_mentions(T), t=text) == found


def test_label_versions(value):
    labels = F.array(F.lit("affects-4.1.0"), F.lit("bug"), F.lit("12.34 and 5.6"))
    assert value(tx.label_versions(labels, F.lit("4.1.0 final"))) == ["12.34", "4.1.0"]
    assert value(tx.label_versions(labels, F.lit(None).cast("string"))) == ["12.34", "4.1.0"]
    assert value(tx.all_versions(labels, F.lit(None), T), t="on 3.5 and 4.1.0") == ["12.34", "3.5", "4.1.0"]


def test_change_references(value):
    text = "#47001 GH-48002 #3 #1234567 https://github.com/apache/spark/pull/7 #47001 " \
           "https://github.com/apache/spark/pull/99999999999999999999"
    assert value(tx.pr_refs(T), t=text) == [7, 47001, 48002, 123456]


def test_config_keys(value):
    text = "set spark.sql.x.y, spark.sql.x.y or spark.app.größe; not spark.app or spark"
    assert value(tx.config_keys(T), t=text) == ["spark.app.größe", "spark.sql.x.y"]


# ---- classification ----

@pytest.mark.parametrize("text, kind", [
    ("Exception in thread main\n\tat org.apache.spark.Task", "logs"),
    ("Traceback (most recent call last)\n  File x", "logs"),
    ("import os\ndf = spark.table('t')\ndf.collect()", "code"),
    ("object A {\n  val x = 1\n}", "code"),
    ("How do I tune shuffle partitions?", "question"),
    ("Why is my join slow\nwith two tables\nand no skew", "question"),
])
def test_classify_input(value, text, kind):
    assert value(tx.classify_input(T), t=text) == kind


def test_error_types(value):
    text = "java.lang.OutOfMemoryError ... MetadataFetchFailedException"
    assert value(tx.error_types(T), t=text) == ["OutOfMemoryError", "FetchFailedException", "MetadataFetchFailedException"]
    assert value(tx.first_error(T), t="all fine") == ""


def test_languages(value):
    assert [value(tx.detect_language(T), t=f"a/b.{e}") for e in ("py", "scala", "java", "md")] == \
        ["python", "scala", "java", None]


def test_lists_as_json(value):
    assert value(tx.wrap_list(F.array(F.lit("a")), "apis")) == '{"apis":["a"]}'
    assert value(tx.wrap_list(F.lit(None).cast("array<string>"), "apis")) == '{"apis":[]}'
    assert value(tx.unwrap_list(T, "apis"), t='{"apis":["a","b"]}') == ["a", "b"]
    assert value(tx.unwrap_list(F.lit(None).cast("string"), "apis")) == []


def test_source_labels(value):
    assert [value(tx.source_label(T), t=s) for s in ("code", "qa", "spark_user_notes")] == \
        ["Code", "Stackoverflow", "User Notes"]


class _Tree(HTMLParser):
    """Elements as nested lists: an end tag closes the last open element of its name and all inside it."""

    def __init__(self):
        super().__init__()
        self.root = ["root"]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag]
        self.open[-1].append(node)
        if tag not in ("br", "img"):
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].append([tag])

    def handle_endtag(self, tag):
        at = max((i for i, n in enumerate(self.open) if n[0] == tag), default=0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].append(data)


def _below(node, *names):
    for child in node[1:]:
        if isinstance(child, list):
            if child[0] in names:
                yield child
            yield from _below(child, *names)


def _text(node):
    return "".join(c.strip() if isinstance(c, str) else _text(c) for c in node[1:])


def test_tables_against_a_tree(spark):
    rng = random.Random(4)
    bits = ["<tr>", "</tr>", "<td>", "</td>", "<TH a='>'>", "</th>", "<table>", "</table>", "<b>", "</b>", "<p>", "</p>", "<br>", "<i/>", " x ", "y", "\n", "<!-- <td> -->"]
    tables = ["<table>" + "".join(rng.choice(bits) + (str(i) if rng.random() < .3 else "") for i in range(rng.randrange(40))) + "</table>" for _ in range(300)]
    want = []
    for html in tables:
        tree = _Tree()
        tree.feed(html)
        tree.close()
        rows = ([_text(c) for c in _below(r, "td", "th")] for r in _below(tree.root, "tr"))
        want.append("\n".join(" | ".join(cells) for cells in rows if cells))
    got = spark.createDataFrame(list(enumerate(tables)), "i int, html string").select("i", tx.table_to_text(F.col("html")).alias("t"))
    assert [r.t for r in got.orderBy("i").collect()] == want


def test_control_characters_are_text(value):
    assert value(tx.html_to_text(F.col("t")), t="a\x01b<p>c\x02</p>") == "a\x01b\nc\x02"
