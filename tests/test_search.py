import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.functions.embed import Model, hashing_model, token_code
from lodestone.operators import rank, search, vectors
from lodestone.plans import registry

RNG = np.random.default_rng(3)
DIM = 16


def vectors_of(n, dim=DIM):
    return RNG.standard_normal((n, dim)).astype(np.float32)


def frame(spark, name, matrix, ids=None, **columns):
    ids = list(range(len(matrix))) if ids is None else ids
    rows = [(i, m.tolist(), *(c[j] for c in columns.values())) for j, (i, m) in enumerate(zip(ids, matrix))]
    kinds = "".join(f", {c} string" for c in columns)
    kind = "string" if isinstance(ids[0], str) else "long"
    return spark.createDataFrame(rows, f"{name} {kind}, vec array<float>{kinds}")


def brute(q, c, k, qids, cids, groups, allowed=lambda i, j: True):
    q, c = q.astype(float), c.astype(float)
    sims = (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
    out = set()
    for i in range(len(q)):
        for g in set(groups):
            hits = sorted((-round(sims[i, j], 6), cids[j]) for j in range(len(c)) if groups[j] == g and allowed(i, j))
            out |= {(qids[i], g, cid, r + 1) for r, (_, cid) in enumerate(hits[:k])}
    return out


def result(df):
    return {(r.query_id, r.source, r.chunk_id, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data(spark):
    q, c = vectors_of(23), vectors_of(400)
    c[100:250] = c[100]  # a hot group of copies: ties go by id
    ids = [f"c{i:04d}" for i in RNG.permutation(400)]
    sources = ["code" if i < 300 else "qa" for i in range(400)]
    versions = [None if s == "qa" else ("a" if i % 2 else "b") for i, s in enumerate(sources)]
    wants = [None if i % 3 == 0 else "a" for i in range(23)]
    queries = frame(spark, "query_id", q, want=wants)
    corpus = frame(spark, "chunk_id", c, ids, source=sources, version=versions).repartition(5)
    return q, c, ids, sources, versions, wants, queries, corpus


def test_exact_hits_with_ties(data):
    q, c, ids, sources, _, _, queries, corpus = data
    found = search.top_k(queries, corpus, 7, by=["source"])
    assert result(found) == brute(q, c, 7, range(23), ids, sources)


def test_beyond_the_broadcast_bound(data):
    q, c, ids, sources, versions, wants, queries, corpus = data
    few = search.top_k(queries, corpus, 7, by=["source"], limit=("want", "version"))
    many = search.top_k(queries, corpus, 7, by=["source"], limit=("want", "version"), broadcast_bytes=8 * DIM)
    assert "CoGroup" in plan_of(many) and "CoGroup" not in plan_of(few)

    def allowed(i, j):
        return versions[j] is None or wants[i] is None or versions[j] == wants[i]

    assert result(few) == result(many) == brute(q, c, 7, range(23), ids, sources, allowed)


@pytest.mark.parametrize("keys", [[], ["_key"]])
def test_blocks_and_cells(spark, data, keys):
    q, c, ids, sources, _, _, queries, corpus = data
    key = F.lit("k").alias("_key")
    left, right = queries.select("query_id", "vec", key), corpus.select("chunk_id", "vec", "source", key)
    from pyspark.sql import types as T
    out = T.StructType([queries.schema["query_id"], corpus.schema["source"], corpus.schema["chunk_id"],
                        T.StructField("sim", T.DoubleType())])
    hits = search.blocked_top_k(left, right, keys, 7, "query_id", "chunk_id", "vec", ["source"], None, None,
                                False, DIM, out, block_queries=5, cell_rows=30)
    found = search.ranked(hits, 7, ["query_id", "source"], "chunk_id")
    assert result(found) == brute(q, c, 7, range(23), ids, sources)


def test_not_itself(spark):
    m = vectors_of(40)
    rows = frame(spark, "chunk_id", m).withColumn("query_id", F.col("chunk_id"))
    hits = search.top_k(rows, rows, 3, not_self=True).collect()
    assert len(hits) == 120 and all(r.query_id != r.chunk_id for r in hits)


def test_wrong_dimension_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None)], "chunk_id long, vec array<float>")
    query = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vec array<float>")
    hits = search.top_k(query, corpus, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.sim) for r in hits] == [(1, 0.707107), (2, 0.0)]
    assert sorted(r.chunk_id for r in vectors.wrong_dimension(corpus, 2).collect()) == [3, 4]
    with pytest.raises(Exception, match="dimension"):
        vectors.checked_dimension(corpus, 2).collect()


def test_search_plans(data):
    queries, corpus = data[-2:]
    plan = plan_of(search.top_k(queries, corpus, 7, by=["source"]))
    assert "WindowGroupLimit" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    many = plan_of(search.top_k(queries, corpus, 7, broadcast_bytes=0))
    assert "Cartesian" not in many and "NestedLoop" not in many


def test_approximate_recall(spark):
    centres = vectors_of(20, 32)
    near = np.repeat(centres, 50, axis=0) + 0.1 * vectors_of(1000, 32)
    corpus = frame(spark, "chunk_id", near, source=["s"] * 1000)
    queries = frame(spark, "query_id", centres)
    exact = {(r.query_id, r.chunk_id) for r in search.top_k(queries, corpus, 10).collect()}
    found = search.approximate_top_k(queries, corpus, 10, dim=32, tables=10, bits=6).collect()
    assert len({(r.query_id, r.chunk_id) for r in found}) == len(found)
    assert len(exact & {(r.query_id, r.chunk_id) for r in found}) / len(exact) > 0.9
    sims = {(r.query_id, r.chunk_id): r.sim for r in search.top_k(queries, corpus, 1000).collect()}
    assert all(sims[r.query_id, r.chunk_id] == r.sim for r in found)


def test_recall_of_the_registered_query(spark, sf):
    d = sf.replace("0.001", "0.01")
    found = registry.ann_lsh(spark, d).where("in_exact").count()
    exact = registry.exact_hits(spark, d, registry.chunk_facts(spark, d)).count()
    assert exact == 1600 and found >= 0.9 * exact, (found, exact)


@pytest.mark.parametrize("side", ["queries", "corpus"])
def test_other_dimensions_fail_the_search(spark, side):
    rows = lambda name, vecs: spark.createDataFrame(vecs, f"{name} bigint, vec array<double>")
    good, other = [(1, [1.0, 0.0]), (2, None)], [(3, [1.0, 0.0, 0.0])]
    queries = rows("query_id", good + other * (side == "queries"))
    corpus = rows("chunk_id", good + other * (side == "corpus"))
    for run in (lambda q, c: search.top_k(q, c, 2, dim=2), lambda q, c: search.top_k(q, c, 2, dim=2, broadcast_bytes=0),
                lambda q, c: search.approximate_top_k(q, c, 2, dim=2)):
        assert run(rows("query_id", good), rows("chunk_id", good)).count() == 1
        with pytest.raises(Exception, match="dimension other than 2"):
            run(queries, corpus).collect()


# ---- embeddings ----

def test_hashed_vectors(spark):
    model = hashing_model(8)
    out = spark.createDataFrame([("Ab ab c_1",), ("",), (None,)], "t string").select(model.embed(F.col("t")).alias("v")).collect()
    counts = np.zeros(8)
    for t in ("ab", "ab", "c_1"):
        bucket, sign = token_code(t, 8)
        counts[bucket] += sign
    assert np.allclose(out[0].v, counts / np.linalg.norm(counts))
    assert out[1].v == [0.0] * 8 and out[2].v == [0.0] * 8


def test_own_embedders(spark):
    import pandas as pd

    @F.pandas_udf("array<float>")
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 1.0])

    rows = spark.createDataFrame([("a", "xy"), ("b", "xyz")], "chunk_id string, content string")
    none = spark.createDataFrame([], "chunk_id string, vec array<float>, model_column string")
    native = Model("native", "emb_n", 2, lambda t: F.array(F.length(t).cast("float"), F.lit(1.0).cast("float")))
    for model in (Model("udf", "emb_u", 2, lengths), native):
        filled = vectors.fill_vectors(rows, none, model)
        assert {r.chunk_id: (r.vec, r.model_column) for r in filled.collect()} == {
            "a": ([2.0, 1.0], model.column), "b": ([3.0, 1.0], model.column)}


def test_fill_is_incremental(spark):
    model = hashing_model(8)
    chunks = spark.createDataFrame([("a", "x y"), ("b", "z"), ("b", "z")], "chunk_id string, content string")
    none = spark.createDataFrame([], "chunk_id string, vec array<float>, model_column string")
    first = vectors.fill_vectors(chunks, none, model)
    kept = spark.createDataFrame(first.collect(), first.schema)
    assert kept.count() == 2
    assert vectors.fill_vectors(chunks, kept, model).count() == 0
    assert vectors.fill_vectors(chunks, kept, hashing_model(8, "emb_other")).count() == 2
    assert vectors.merge_vectors(chunks, kept, model).where(F.col(model.column).isNull()).count() == 0


# ---- ranking ----

def score(spark, **changes):
    hit = dict(sim=0.5, input_type="question", source="qa", request_apis=[], hit_apis=[], votes=0, accepted=False,
               state="open", versions=[], target="4.1.0") | changes
    row = spark.createDataFrame([tuple(hit.values())], "sim double, input_type string, source string, request_apis array<string>, "
                                "hit_apis array<string>, votes long, accepted boolean, state string, versions array<string>, target string")
    return row.select(rank.rerank_score(*[F.col(c) for c in hit])).first()[0]


def test_boosts(spark):
    base = score(spark)
    assert base == pytest.approx(0.15)
    assert score(spark, votes=10) == base and score(spark, votes=11) == pytest.approx(base + 0.03)
    assert score(spark, accepted=True) == pytest.approx(base + 0.05)
    assert score(spark, request_apis=["a", "b"], hit_apis=["a", "b", "c"]) == pytest.approx(base + 0.1)
    assert score(spark, target="4.1", versions=["4.1.0"]) == pytest.approx(base + 0.04)
    assert score(spark, target="all", versions=["4.1.0"]) == base and score(spark, target="", versions=["4"]) == base
    assert score(spark, versions=None, hit_apis=None, votes=None, accepted=None, state=None) == base
    assert score(spark, source="issues", state="closed") == pytest.approx(0.5 * 0.15 + 0.02)
    assert score(spark, source="docs", request_apis=["a"], hit_apis=["a"], votes=50) == pytest.approx(0.5 * 0.35)
    assert score(spark, source="else") == pytest.approx(0.05)


def test_merged_order(spark):
    hits = spark.createDataFrame([(1, "issues", "i", 1, 0.5), (1, "code", "c2", 2, 0.5), (1, "code", "c1", 1, 0.5),
                                  (1, "qa", "q", 1, 0.9)], "request_id int, source string, chunk_id string, rank int, score double")
    merged = rank.merge_hits(hits, 3).orderBy("position").collect()
    assert [r.chunk_id for r in merged] == ["q", "c1", "c2"]
    assert rank.hits_by_source(hits, "code").count() == 2


@pytest.mark.parametrize("version, kept", [("4.1.0", 3), ("all", 4), ("", 4), (None, 4)])
def test_version_filter(spark, version, kept):
    rows = spark.createDataFrame([("code", "4.1.0"), ("docs", "3.5.4"), ("qa", None), ("issues", "3.5.4")], "s string, v string")
    assert rows.where(rank.version_allowed(version, F.col("s"), F.col("v"))).count() == kept


def test_hopeless_pairs_are_not_scored_exactly():
    rng = np.random.default_rng(5)
    asked, held = search._unit(rng.standard_normal((1500, 24))), search._unit(rng.standard_normal((30_000, 24)))
    held[100:140], held[200:240] = asked[7], 0  # copies of a query and empty vectors tie
    asked[:3] = 0
    ids = rng.permutation(len(held))
    scorer = search._Scorer(np.arange(len(asked)), asked, None, 10, True)
    for at in range(0, len(held), 10_000):
        part = slice(at, at + 10_000)
        scorer.add(ids[part], held[part], [()] * 10_000, [None] * 10_000)
    found = {}
    for _, queries, rows, sims in scorer.hits():
        for q, r, sim in zip(queries.tolist(), rows.tolist(), np.rint(sims * 10**6).astype(int).tolist()):
            found.setdefault(q, set()).add((-sim, r))
    scores = np.rint(asked @ held.T * 10**6).astype(int)
    for q in [0, 1, 2, 7, *range(10, 1500, 37)]:
        every = sorted((-s, i) for s, i in zip(scores[q].tolist(), ids.tolist()) if i != q)
        assert found[q] == set(every[:10])
    assert scorer.scored < 0.1 * scores.size


@pytest.mark.parametrize("limited", [False, True])
def test_far_rows_are_not_looked_at(limited):
    """Queries and rows around a few directions, copies, empty and undefined vectors: the hits are those of all pairs."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((6, 24))
    around = lambda n: centres[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, 24))
    asked, held = search._unit(around(2500)), search._unit(around(20_000))
    held[50:90], held[90:200], held[200] = asked[7], 0, np.nan
    asked[:3], asked[3] = 0, np.nan
    wants = [None if i % 3 else "a" for i in range(len(asked))] if limited else None
    kinds = ["a" if i % 2 else "b" for i in range(len(held))] if limited else [None] * len(held)
    ids = rng.permutation(len(held))
    scorer = search._Scorer(np.arange(len(asked)), asked, wants, 10, True)
    for at in range(0, len(held), 5000):
        part = slice(at, at + 5000)
        scorer.add(ids[part], held[part], [()] * 5000, kinds[part])
    found = {}
    for _, queries, rows, sims in scorer.hits():
        for q, r, sim in zip(queries.tolist(), rows.tolist(), np.rint(sims * 10**6).astype(int).tolist()):
            found.setdefault(q, []).append((-sim, r))
    for q in [0, 1, 7, *range(10, 2500, 61)]:
        scores = np.rint(np.delete(held, 200, 0) @ asked[q] * 10**6).astype(int)
        rest = zip(scores.tolist(), np.delete(ids, 200).tolist(), kinds[:200] + kinds[201:])
        every = sorted((-s, i) for s, i, kind in rest if i != q and (wants is None or wants[q] is None or kind == wants[q]))
        assert sorted(found[q]) == every[:10]
    assert 3 not in found
    assert scorer.looked < 0.5 * len(asked) * len(held)


def test_layout_of_groups():
    for n_queries, n_rows, tasks in ((300_000, 3_000_000, 32), (25_000, 250_000, 32), (3000, 10_000_000, 32), (23, 400, 32), (5_000_000, 600, 8)):
        blocks, cells = search._layout(n_queries, n_rows, 50, tasks, 65_536, 524_288)
        assert -(-n_queries // blocks) <= 65_536 and -(-n_rows // cells) <= 524_288
        assert blocks * cells >= min(tasks, n_queries * n_rows // search._GROUP_PAIRS)
        assert blocks * cells <= max(2 * tasks, 2 * (-(-n_queries // 65_536)) * (-(-n_rows // 524_288)))


def test_every_group_has_a_task_of_its_own(spark, monkeypatch):
    q, c = vectors_of(60), vectors_of(300)
    monkeypatch.setattr(search, "_GROUP_PAIRS", 100)
    assert len(set(search._labels(spark, 13))) == 13
    queries, corpus = frame(spark, "query_id", q), frame(spark, "chunk_id", c, source=["s"] * 300)
    hits = search.top_k(queries, corpus, 5, by=["source"], broadcast_bytes=0)
    assert result(hits) == brute(q, c, 5, range(60), range(300), ["s"] * 300)
    groups = -(-60 * 300 // 100)
    tasks = min(groups, search.TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    blocks, cells = search._layout(60, 300, 5, tasks, 1000, 1000)
    assert "hashpartitioning(_group#" in plan_of(hits) and f", {blocks * cells})" in plan_of(hits).replace("L, ", ", ")


def test_token_codes_stay_few_within_a_text(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = embed.hash_texts([text, None, "w1 w1"], DIM, embed._Codes(DIM))
    monkeypatch.setattr(embed, "_CACHE", 50)
    codes = embed._Codes(DIM)
    assert np.array_equal(embed.hash_texts([text, None, "w1 w1"], DIM, codes), whole)
    assert len(codes) <= 50


def plain_vector(text, dim):
    counts = np.zeros(dim)
    for token in embed.TOKEN.findall((text or "").lower()):
        bucket, sign = token_code(token, dim)
        counts[bucket] += sign
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


@pytest.mark.parametrize("chars, few", [(1 << 19, 200), (40, 200), (40, 3), (1 << 19, 3)])
def test_tokens_of_any_script_as_one_by_one(monkeypatch, chars, few):
    letters = ["a", "B", "\u00c9", "\u00df", "\u0130", "\u03a3", "\u03c3", "_", "7", "\u0663", "\u4e2d", "\U0001d538",
               "\U0001f600", " ", "'", "\n", "\u0307", "\u0416", "\u212a", "-", "\u3000"]
    texts = ["".join(RNG.choice(letters, n)) for n in RNG.integers(0, 50, 400)]
    texts += [None, "", "x" * 55, "x" * 56, "\u00e9" * 28, "\u00e9" * 300, "A\u03a3 " * 90, "".join(RNG.choice(letters, 2000))]
    monkeypatch.setattr(embed, "_GROUP_CHARS", chars)
    monkeypatch.setattr(embed, "_FEW", few)
    found = embed.hash_texts(texts, DIM, embed._Codes(DIM))
    assert np.allclose(found, [plain_vector(t, DIM) for t in texts], atol=1e-12)


def test_many_tokens_are_digested_together(monkeypatch):
    made = []
    monkeypatch.setattr(embed, "token_code", lambda t, dim: made.append(t) or token_code(t, dim))
    texts = [" ".join(f"w{i * j}" for j in range(100)) for i in range(50)] + ["y" * 100]
    found = embed.hash_texts(texts, DIM, embed._Codes(DIM))
    assert made == ["y" * 100]
    assert np.allclose(found, [plain_vector(t, DIM) for t in texts], atol=1e-12)
