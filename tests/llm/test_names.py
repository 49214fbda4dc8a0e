"""Columns of the input that are named like the operators' own, and ids that are no numbers."""

from lodestone.llm import decontam, lines, near
from lodestone.llm.lm import score_texts
from lodestone.llm.repeats import find_repeats
from pyspark.sql import functions as F

OWN = ("hit_id", "hit_print", "hit_words", "gone_id", "gone_print", "gone_at", "kept_id", "print", "node", "key", "p", "len", "items")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def clashing(spark):
    docs = spark.createDataFrame([(1, f"{LONG}\nand a line of its own here"), (2, f"{LONG}\nanother line that stands alone"), (3, None),
                                  (None, "a text without an id that is long enough"), (4, f"{LONG}\nand a line of its own here")],
                                 "doc_id long, text string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in OWN})


def kept_whole(df, docs):
    assert df.columns == docs.columns
    rows = df.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in OWN)
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


def test_clashing_columns(spark):
    docs = clashing(spark)
    items = spark.createDataFrame([(1, "another line that stands alone")], "item_id long, text string")
    assert kept_whole(decontam.drop_contaminated(docs, items), docs) == [1, 3, 4, None]
    cut = decontam.cut_spans(docs, items)
    assert kept_whole(cut, docs) == [1, 2, 3, 4, None] and "another" not in cut.where("doc_id = 2").first().text
    fewer = lines.drop_lines(docs)
    assert kept_whole(fewer, docs) == [1, 2, 3, 4, None]
    assert sum(LONG in (r.text or "") for r in fewer.collect()) == 1
    assert kept_whole(near.keep_one(docs), docs) == [1, 2, 3, None]


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "x y z " * 100), ("b", "x y z " * 100), ("c", None), (None, "w")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in score_texts(docs).collect()} == {"a": 301, "b": 301, "c": 1, None: 2}
    assert {r.doc_id: r.n_removed for r in find_repeats(docs).collect()} == {"a": 600, "b": 600, "c": 0, None: 0}
