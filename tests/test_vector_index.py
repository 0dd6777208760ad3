"""The inverted-file index against the exact search."""

import numpy as np
import pytest
from plans import plan_of
from pyspark.sql import functions as F

from logvane.operators import retrieve, vector_index

SCHEMA = "collection string, doc_id long, embedding array<double>"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 8))
    rows = [(f"c{i % 3}", i, (middles[i % 12] + rng.normal(scale=0.2, size=8)).tolist()) for i in range(900)]
    rows += [("c0", 900 + i, rows[5][2]) for i in range(40)] + [(None, 950, rows[7][2]), ("c1", 951, [0.0] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module", params=["cosine", "l2"])
def index(request, docs, tmp_path_factory):
    return vector_index.build_index(docs, str(tmp_path_factory.mktemp("index")), request.param, cells=12)


def asked(docs, of="doc_id % 20 = 0"):
    return docs.filter(of).select(F.col("doc_id").alias("query_id"), "embedding")


@pytest.mark.parametrize("max_shared", [1_000, 1])
def test_all_cells_give_the_exact_rows(docs, index, monkeypatch, max_shared):
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 50)
    found = vector_index.search(index, asked(docs), docs, 4, max_shared=max_shared)
    exact = retrieve.nearest(asked(docs), docs, 4, index.metric)
    assert sorted(map(str, found.collect())) == sorted(map(str, exact.collect()))


def test_measured_probes_reach_the_recall_and_read_fewer_cells(docs, index):
    probes = vector_index.probes_for(index, docs, 5, recall=0.95, measured=200)
    assert probes < index.cells
    exact = retrieve.nearest(asked(docs), docs, 5, index.metric).select("query_id", "doc_id").distinct()
    for max_shared in (1_000, 1):
        found = vector_index.search(index, asked(docs), docs, 5, probes, max_shared=max_shared).select("query_id", "doc_id").distinct()
        assert exact.intersect(found).count() >= 0.9 * exact.count()


def test_only_probed_folders_are_read(spark, docs, index):
    plan = plan_of(vector_index.search(index, asked(docs, "doc_id = 20"), docs, 3, probes=2))
    filters = plan[plan.index("PartitionFilters") :].split("\n")[0]
    assert "cell" in filters
    some = vector_index.stored_rows(spark, index, docs, [0, 1])
    folders = {f.rsplit("/", 2)[-2] for f in some.inputFiles()}
    assert folders and len(folders) == index.cells  # all are listed
    read = some.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].rsplit("/", 2)[-2] for r in read} == {"cell=0", "cell=1"}


def test_a_stored_index_opens_again(spark, docs, index):
    again = vector_index.open_index(spark, index.path)
    assert again.metric == index.metric and np.allclose(again.centroids, index.centroids)
    assert vector_index.stored_rows(spark, again, docs).count() == docs.count()


def test_empty_tables_and_missing_vectors(spark, docs, tmp_path):
    none = docs.filter("false")
    index = vector_index.build_index(none, str(tmp_path / "none"))
    assert index.cells == 0 and vector_index.search(index, asked(docs), docs, 3).count() == 0 and vector_index.probes_for(index, none) == 1
    one = vector_index.build_index(docs.filter("doc_id = 3"), str(tmp_path / "one"))
    assert one.cells == 1 and vector_index.search(one, asked(none), docs, 3).count() == 0
    assert vector_index.search(one, asked(docs), docs, 3, 1).count() == asked(docs).count()
    with pytest.raises(ValueError, match="no vector"):
        vector_index.build_index(docs.withColumn("embedding", F.when(F.col("doc_id") > 3, F.col("embedding"))), str(tmp_path / "gap"))


def test_a_query_meets_a_region_once_and_distances_are_bounded(spark, docs, index, monkeypatch):
    # one row for each cell that a query probes grew with the cells; F7, F10: matrices of all queries and rows
    exact = sorted(map(str, retrieve.nearest(asked(docs), docs, 4, index.metric).collect()))
    sizes = []
    monkeypatch.setattr(retrieve, "MATRIX_VALUES", 300)
    plain = retrieve.np.partition
    monkeypatch.setattr(retrieve.np, "partition", lambda a, *how, **more: sizes.append(a.size) or plain(a, *how, **more))
    top = retrieve._TopK(*(np.array(x) for x in zip(*[(r["query_id"], r["embedding"]) for r in asked(docs).collect()])), 4, index.metric)
    rows = docs.toPandas()
    top.add(rows["collection"].to_numpy(), rows["doc_id"].to_numpy(), retrieve._matrix(rows["embedding"]))
    found = top.frame()
    assert len(found) == len(exact) and sizes and max(sizes) <= 600
    regions = vector_index._regions(index, vector_index.stored_rows(spark, index, docs), 3)
    assert sorted(regions["cell"]) == list(range(index.cells)) and regions["region"].nunique() < index.cells / 2


def test_a_large_table_is_drawn_by_a_filter(docs, tmp_path):
    # drawing by order sorted all vectors and held the drawn ones in one task
    index = vector_index.build_index(docs, str(tmp_path / "drawn"), cells=5, fit_rows=100)
    found = vector_index.search(index, asked(docs), docs, 4)
    assert sorted(map(str, found.collect())) == sorted(map(str, retrieve.nearest(asked(docs), docs, 4).collect()))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_probes_of_all_rows(spark, docs, tmp_path, metric, monkeypatch):
    # places of cells were measured for a draw of rows; of all rows they are those of a plain sort
    index = vector_index.build_index(docs.filter("collection IS NOT NULL"), str(tmp_path / "all"), metric, cells=9, fit_rows=None)
    rng = np.random.default_rng(2)
    vectors, cells = rng.normal(size=(50, 8)), rng.integers(0, 9, 50)
    order = vector_index._ranked_cells(vectors, index.centroids, 9, metric)
    assert (vector_index._cell_places(vectors, cells, index.centroids, metric) == (order == cells[:, None]).argmax(axis=1)).all()
    monkeypatch.setattr(retrieve, "MAX_SHARED_QUERIES", 5)
    some = docs.filter("collection IS NOT NULL")
    probes = vector_index.probes_for(index, some, 4, recall=1.0, measured=None)
    exact = retrieve.nearest(asked(some, "true"), some, 4, metric).select("query_id", "collection", "doc_id")
    found = vector_index.search(index, asked(some, "true"), some, 4, probes).select("query_id", "collection", "doc_id")
    assert exact.exceptAll(found).count() == 0
    reach = vector_index.rows_in_reach(index, asked(some, "true"), some, probes)
    assert reach.count() == some.count() and reach.agg(F.max("n_rows")).first()[0] <= some.count()
    assert vector_index.rows_in_reach(index, asked(some, "true"), some, index.cells).filter(F.col("n_rows") != some.count()).count() == 0


def test_every_vector_is_a_query(spark, tmp_path):
    # every twentieth vector was asked
    from workload import indexes

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = indexes.index_probes(spark, str(tmp_path)).collect()
    assert sorted(r["query_id"] for r in got) == list(range(130))
    assert all(0 < r["recall"] <= 1 and 0 < r["n_rows"] <= 130 and r["probes"] <= r["cells"] for r in got)


def test_equal_vectors_have_distance_zero_however_they_are_dealt_out(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 9)) * 100
    for n in (1, 7, 300):
        top = retrieve._TopK(np.arange(n), rows[:n], 2, "l2")
        top.add(np.zeros(300, int), np.arange(300), rows)
        assert (top.frame().groupby("query_id")["distance"].min() == 0).all()
