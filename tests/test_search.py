import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspark.operators import api, cluster, evaluate, exact, graph, ivf, kernels
from nearspark.plans.config import IndexConfig, SearchParams
from nearspark.sources import fvecs
from nearspark.streaming import training


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6, 16))[rng.integers(6, size=400)] * 4 + rng.standard_normal((400, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "row_id long, embedding array<double>").cache()
    q = df.where("row_id < 20").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q"))
    return v, df, q


@pytest.mark.parametrize("metric", ["l2", "inner_product", "cosine"])
def test_exact_and_ivf(spark, data, metric):
    v, df, q = data
    truth = exact.knn(df, q, 5, metric).cache()
    d = kernels.distances(v[:20], v, metric)
    want = {(i, int(j)) for i in range(20) for j in np.lexsort((np.arange(400), d[i]))[:5]}
    assert {(r.query_id, r.row_id) for r in truth.collect()} == want
    for kind, least in (("ivf_flat", 0.99), ("ivf_sq", 0.9), ("ivf_rq", 0.6), ("ivf_pq", 0.5)):
        index = ivf.IvfIndex.build(df, IndexConfig(kind, 16, metric, nlist=4, pq_m=8))
        assert evaluate.recall(index.search(q, SearchParams.automatic(5)), truth).head().recall >= least, kind


def test_store_filter_merge_and_budget(spark, data, tmp_path):
    _, df, q = data
    index = ivf.IvfIndex.build(df.where("row_id < 300"), IndexConfig("ivf_flat", 16, nlist=4))
    grown = index.add(df.where("row_id >= 300"))
    grown.save(str(tmp_path / "index"))
    back = ivf.IvfIndex.load(spark, str(tmp_path / "index"))
    assert back.metadata()["total_vectors"] == 400 and index.merge(index).lists.count() == 600
    allowed = df.where("row_id % 40 = 0").select("row_id")
    found = back.search(q, SearchParams.automatic(8), allowed).collect()
    assert len(found) == 160 and all(r.row_id % 40 == 0 for r in found)
    few = back.search_max_codes(q, 400, 4, 50).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {50}
    empty = exact.padded(back.search(q, SearchParams.automatic(3), allowed.where("row_id < 0")), q, 3)
    assert {r.row_id for r in empty.collect()} == {-1}
    with pytest.raises(ValueError):
        index.merge(ivf.IvfIndex.build(df, IndexConfig("ivf_flat", 16, nlist=8)))


def test_training_pieces(spark, data):
    v, df, _ = data
    c = cluster.finish_coreset(cluster.coreset(df, 8, 16, chunk=100), 6)
    assert c.shape == (6, 16) and kernels.nearest(v, c)[1].mean() < 40
    r = kernels.train_opq(v, 4, 4, rounds=5)
    assert np.allclose(r @ r.T, np.eye(16), atol=1e-8)
    codes = np.arange(24, dtype=np.uint8).reshape(3, 8) % 16
    assert (kernels.unpack4(kernels.pack4(codes)) == codes).all()
    far = spark.createDataFrame([(0, [0.0]), (2, [8.0])], "list_id int, centroid array<double>")
    fixed = cluster.repair_empty(far, spark.createDataFrame([(0, 1), (2, 5)], "list_id int, n long"), 3)
    assert {r.list_id: r.centroid[0] for r in fixed.collect()}[1] == pytest.approx(8 * (1 + 1 / 1024))


def test_vector_files(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(fvecs.to_fvecs(v))
    rows = fvecs.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("row_id").collect()
    assert [list(r.embedding) for r in rows] == v.tolist()


def test_evaluation(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "query_id long, rank int, row_id long")
    b = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "query_id long, rank int, row_id long")
    assert evaluate.stability(a, b).head()[0] == 0.5 and evaluate.recall(a, b.where("false")).head()[0] == 1.0
    assert evaluate.percentile(spark.range(10), "id", 95).head()[0] == 8


def test_exact_distances_far_from_the_origin(spark):
    rng = np.random.default_rng(5)
    v = 1000 + 0.001 * rng.standard_normal((300, 12))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "row_id long, embedding array<double>")
    q = df.where("row_id < 10").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q"))
    got = exact.knn(df, q.unionByName(spark.createDataFrame([(77, None)], "query_id long, q array<double>")), 5).collect()
    d = ((v[:10, None] - v[None]) ** 2).sum(axis=2)
    assert {(r.query_id, r.row_id) for r in got} == {(i, int(j)) for i in range(10) for j in np.argsort(d[i], kind="stable")[:5]}
    assert all(r.distance == pytest.approx(d[r.query_id, r.row_id], rel=1e-9, abs=1e-18) for r in got)
    with pytest.raises(Exception, match="finite"):
        exact.knn(spark.createDataFrame([(1, [1.0])], "row_id long, embedding array<double>"), q, 5).collect()


@pytest.mark.parametrize("metric", ["l2", "inner_product", "cosine"])
def test_graph_index(spark, data, metric, monkeypatch, tmp_path):
    v, df, q = data
    truth = exact.knn(df, q, 5, metric).cache()
    config = IndexConfig("diskann", 16, metric, max_degree=12, build_l=30, pq_m=2, memory_budget=4_000_000 if metric != "l2" else 8 << 30)
    index = graph.GraphIndex.build(df, config)
    assert all(r.nodes == r.reachable and r.degree <= 12 for r in index.reachability().collect())
    assert evaluate.recall(index.search(q, SearchParams.diskann(5, 100)), truth).head().recall >= 0.9
    allowed = df.where("row_id % 3 = 0").select("row_id")
    want = exact.knn(exact.prefilter(df, allowed), q, 5, metric).cache()
    assert evaluate.recall(index.search(q, SearchParams.diskann(5, 60), allowed), want).head().recall == 1.0
    monkeypatch.setattr(graph, "FEW_ALLOWED", 0)
    walked = index.search(q, SearchParams.diskann(5, 60), allowed)
    assert evaluate.recall(walked, want).head().recall >= 0.9 and walked.where("row_id % 3 != 0").count() == 0
    index.save(str(tmp_path / "graph"))
    back = api.Reader.open(spark, str(tmp_path / "graph"))
    assert back.metadata() == index.metadata() and back.warm_up() == index.nodes.count()
    assert evaluate.recall(back.search(q, SearchParams.diskann(5, 100)), truth).head().recall >= 0.9
    with pytest.raises(ValueError):
        ivf.IvfIndex.build(df, config)


def test_graph_parts():
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.standard_normal((40, 3)), 50 + rng.standard_normal((40, 3))])
    out, entry = graph.build_graph(v, 6, 10, 1.2)
    assert graph.reachable(out, entry).all() and max(map(len, out)) <= 6 and sorted(graph.bfs_order(out, entry)) == list(range(80))
    assert graph.robust_prune(0, np.array([1, 2]), np.array([[0.0], [1.0], [1.1]]), 4, 1.2).tolist() == [1]
    at, d = graph.beam(v[5], v, out, entry, 80, "l2")
    assert at[0] == 5 and d[0] == pytest.approx(0, abs=1e-9) and len(at) == 80


def test_models_survive_storage(spark, data, tmp_path):
    _, df, q = data
    for kind in ("ivf_flat", "ivf_sq", "ivf_pq", "ivf_rq"):
        config = IndexConfig(kind, 16, nlist=4, pq_m=4, use_opq=kind == "ivf_pq", rq_bits=3)
        trained = api.Trainer(config).add(df.where("row_id < 200")).add(df.where("row_id >= 200")).finish()
        api.Writer(trained).add(df).write(str(tmp_path / kind))
        back = api.Reader.open(spark, str(tmp_path / kind)).optimize_for_search()
        assert back.index.merge(ivf.IvfIndex(trained.model, back.index.lists)).lists.count() == 800
        own = ivf.IvfIndex(trained.model, back.index.lists)
        p = SearchParams.ivf(5, 4)
        a, b = ({(r.query_id, r.row_id): r.distance for r in x.search(q, p).collect()} for x in (back, own))
        assert a == pytest.approx(b)
    assert len(back.index.lists.head().code) == 64 // 8 * 3 + 12
    with pytest.raises(ValueError):
        api.Reader.open(spark, str(tmp_path))


def test_calibration_and_generated_rows(spark):
    rows = evaluate.clustered_rows(spark, 600, 8, 4)
    q = rows.where("row_id < 8").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q"))
    index, truth = ivf.IvfIndex.build(rows, IndexConfig("ivf_flat", 8, nlist=8)), exact.knn(rows, q, 5).cache()
    width = evaluate.calibrate(lambda n: index.search(q, SearchParams.ivf(5, n)), truth, 0.99, 1, 8)
    assert evaluate.recall(index.search(q, SearchParams.ivf(5, width)), truth).head().recall >= 0.99
    parts = evaluate.filter_matrix(rows, (0.0, 0.2, 1.0))
    assert [parts[p].count() for p in (0.0, 1.0)] == [0, 600] and 60 < parts[0.2].count() < 180


def test_training_on_a_stream(spark, data, tmp_path):
    v, df, _ = data
    df.select("embedding").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("embedding array<double>").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sink = training.coreset_sink(str(tmp_path / "coreset"), 8, 16)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    c = training.centroids(spark, str(tmp_path / "coreset"), 6)
    assert c.shape == (6, 16) and kernels.nearest(v, c)[1].mean() < 40
    assert spark.read.parquet(str(tmp_path / "coreset")).agg(F.sum("weight")).head()[0] == 400


def test_balanced_assignment(spark, data):
    v, df, _ = data
    c = np.array([[float(i)] * 16 for i in range(3)])
    got = cluster.balanced_assign(df, spark.createDataFrame(list(enumerate(c.tolist())), "list_id int, centroid array<double>"), factor=20.0, rounds=2)
    d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    for _ in range(2):
        at = (d + 20.0 * np.log(np.maximum(np.bincount(at, minlength=3), 1))).argmin(axis=1)
    assert {r.row_id: r.list_id for r in got.collect()} == dict(enumerate(at.tolist()))


def test_rounded_as_sql_rounds(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from nearspark import catalog

    rows = [(i, [1.0, x, -x] + [0.0] * 61, 0) for i, x in enumerate((1e-8, 4e-7, 6e-7, 0.25, 1e-30))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {i: repr(u) for i, u in con.execute(catalog.ORACLES["normalize"]).fetchall()}
    assert {r.row_id: repr(r.unit) for r in catalog.QUERIES["normalize"](spark, str(tmp_path)).collect()} == want
    odd = [0.5e-6, 1.5e-6, -2.5e-6, 1.0000005, -0.0, 3.4028234663852886e38, 1e305, -1e305, float("inf"), float("nan")]
    got = spark.createDataFrame([(x,) for x in odd], "x double").select(catalog._six(F.col("x"))).collect()
    assert [repr(r[0]) for r in got] == [repr(con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]) for x in odd]
