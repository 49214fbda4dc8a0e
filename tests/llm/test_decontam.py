"""The two ways of looking windows up, and documents without words."""

from lodestone.llm import decontam


def test_shuffled_lookup_equals_the_broadcast_one(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:14])), (2, "Tiny ITEM"), (3, "one"), (4, " ".join(words[20:31])), (5, None)],
                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, " ".join(words)), (2, "a tiny item, b one"), (3, None), (4, ""), (5, "..."), (6, " ".join(words[5:16])), (6, "one one"),
         (None, " ".join(words[18:33])), (7, " ".join(words[::-1])), (8, "w0 " * 500 + " ".join(words[:14]))], "doc_id long, text string")

    def rows():
        return sorted(map(str, decontam.contamination(docs, items).collect()))

    broadcast = rows()
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert rows() == broadcast
    found = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in decontam.contamination(docs, items).collect()}
    assert found == {(1, 40): (25, 2), (2, 5): (3, 2), (3, 0): (0, 0), (4, 0): (0, 0), (5, 0): (0, 0), (6, 11): (0, 0), (6, 2): (2, 1),
                     (None, 15): (11, 1), (7, 40): (0, 0), (8, 514): (14, 1)}
    assert decontam.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(docs.limit(0), items).collect() == []
