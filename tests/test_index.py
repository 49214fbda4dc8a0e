import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodestone.operators import index, search

RNG = np.random.default_rng(8)
DIM = 24


def frame(spark, name, matrix, ids=None, **columns):
    rows = [(i if ids is None else ids[i], m.tolist(), *(c[i] for c in columns.values())) for i, m in enumerate(matrix)]
    kind = "string" if ids is not None else "long"
    return spark.createDataFrame(rows, f"{name} {kind}, vec array<float>" + "".join(f", {c} string" for c in columns))


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    centres = RNG.standard_normal((12, DIM))
    corpus = centres[RNG.integers(0, 12, 900)] + 0.4 * RNG.standard_normal((900, DIM))
    corpus[300:500] = corpus[300]  # one vector holds a large part of its cell
    queries = corpus[::30] + 0.2 * RNG.standard_normal((30, DIM))
    ids = [f"c{i:04d}" for i in RNG.permutation(900)]
    kinds = ["a" if i % 3 else "b" for i in range(900)]
    rows = frame(spark, "chunk_id", corpus, ids, source=kinds).repartition(4)
    asked = frame(spark, "query_id", queries)
    built = index.build_index(rows, f"{tmp_path_factory.mktemp('index')}/ix", by=["source"], dim=DIM, cells=12, bits=64)
    return rows, asked, built


def hits(df):
    return {(r.query_id, r.source, r.chunk_id, r["rank"], r.sim) for r in df.collect()}


@pytest.mark.parametrize("split", [200_000, 40])
def test_all_cells_and_no_bits_give_the_exact_result(data, monkeypatch, split):
    rows, asked, built = data
    monkeypatch.setattr(index, "SPLIT_ROWS", split)
    monkeypatch.setattr(index, "SPLIT_QUERIES", split)
    found = index.probe(built, asked, 7, by=["source"], probes=12, agree=0)
    assert hits(found) == hits(search.top_k(asked, rows, 7, by=["source"], dim=DIM))
    assert {r.n_scored for r in found.collect()} == {900}


def test_few_cells_score_few_rows_and_find_most(data):
    rows, asked, built = data
    exact = {h[:3] for h in hits(search.top_k(asked, rows, 7, by=["source"], dim=DIM))}
    found = index.probe(built, asked, 7, by=["source"], probes=3, agree=36).collect()
    assert len({(r.query_id, r.source, r.chunk_id) for r in found} & exact) >= 0.9 * len(exact)
    assert np.mean([n for n in {r.query_id: r.n_scored for r in found}.values()]) < 0.4 * 900


def test_every_row_is_stored_once_and_cells_prune_partitions(data):
    rows, _, built = data
    assert sorted(r.chunk_id for r in built.rows().select("chunk_id").collect()) == sorted(r.chunk_id for r in rows.collect())
    plan = plan_of(built.rows([1, 2]))
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") and "Filter (" not in plan.split("FileScan")[0]
    assert {r.cell for r in built.rows([1, 2]).collect()} <= {1, 2}


def test_same_index_again(data, tmp_path):
    rows, _, built = data
    again = index.build_index(rows.repartition(7), str(tmp_path / "ix"), by=["source"], dim=DIM, cells=12, bits=64)
    cells = lambda ix: {(r.chunk_id, r.cell, bytes(r.code)) for r in ix.rows().collect()}
    assert cells(again) == cells(built)


def test_sample_is_bounded_and_other_cases(spark, data, tmp_path):
    rows, asked, _ = data
    assert len(index.fit_centroids(rows, "chunk_id", "vec", DIM, 12, 1, sample_rows=100)) == 12
    with pytest.raises(ValueError, match="cells"):
        index.fit_centroids(rows, "chunk_id", "vec", DIM, 5000)
    with pytest.raises(Exception, match="vector of dimension other than 25"):
        index.build_index(rows, str(tmp_path / "wrong"), dim=25, cells=2)
    none = index.build_index(rows.limit(0), str(tmp_path / "none"), dim=DIM, cells=3)
    assert index.probe(none, asked, 3, probes=2, agree=0).collect() == []
    some = rows.withColumn("vec", F.when(F.col("chunk_id") < "c0005", F.col("vec")))  # null vectors are left out
    few = index.build_index(some, str(tmp_path / "few"), dim=DIM, cells=50)
    assert index.probe(few, asked.limit(1), 9, probes=50, agree=0).count() == 5
