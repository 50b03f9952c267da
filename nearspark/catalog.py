"""Registry of the engine's queries over the test tables and of the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions import vectors as V
from .operators import cluster, evaluate, exact, graph, ivf
from .plans import config

QUERIES: dict = {}
ORACLES: dict = {}
K = 10


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and embedding, lengthened by 1 + vec_id % 5 so that the metrics differ."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 5)).alias("embedding"), "label")


def _queries(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return v.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q"))


def _six(x: Column) -> Column:
    """x to six decimals, as the SQL rounds it: small negatives become -0.0, which F.round hasn't."""
    out = F.round(x, 6)
    return F.when(out == 0, x * 0.0).otherwise(out)


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _six(F.col(n)) for n in names})


_V = "WITH v AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 5)) AS e, label FROM embeddings), q AS (SELECT row_id AS query_id, e AS qe FROM v WHERE row_id % 50 = 0)"
_L2 = "list_sum(list_transform(list_zip(qe, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_DOT = "list_inner_product(qe, e)"
_COS = "(1 - list_inner_product(qe, e) / sqrt(list_inner_product(qe, qe) * list_inner_product(e, e)))"


def _top(dist: str, where: str = "true", k: int = K) -> str:
    return f"""{_V}, d AS (SELECT query_id, row_id, {dist} AS distance FROM q, v WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, row_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""


def _knn(metric: str, dist: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _vectors(spark, sf_dir)
        return _round(exact.knn(v, _queries(v), K, metric), "distance")

    run.__name__ = f"knn_exact_{metric}"
    _query(_top(dist))(run)


for _m, _d in (("l2", _L2), ("inner_product", f"-{_DOT}"), ("cosine", _COS)):
    _knn(_m, _d)


def _pairs(name: str, column, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = _vectors(spark, sf_dir)
        near = v.withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("row_id"))).where("next is not null")
        return near.select("row_id", _six(column(F.col("embedding"), F.col("next"))).alias("value"))

    run.__name__ = name
    _query(f"{_V}, p AS (SELECT row_id, e AS qe, lead(e) OVER (PARTITION BY label ORDER BY row_id) AS e FROM v) SELECT row_id, round({sql}, 6) AS value FROM p WHERE e IS NOT NULL")(run)


_pairs("l2_squared", V.l2_squared, _L2)
_pairs("inner_product", V.inner_product, _DOT)
_pairs("cosine_distance", V.cosine_distance, _COS)
_pairs("norm_squared", lambda a, b: V.norm_squared(a), "list_inner_product(qe, qe)")
_pairs("l2_squared_part", lambda a, b: V.l2_squared_part(a, b, 8, 16), "list_sum(list_transform(list_zip(qe[9:24], e[9:24]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))")


@_query(f"{_V} SELECT row_id, list_transform(e, lambda x: round(x / sqrt(list_inner_product(e, e)), 6)) AS unit FROM v")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("row_id", F.transform(V.normalize(F.col("embedding")), _six).alias("unit"))


@_query(_top(_L2, "row_id % 3 = 0 AND row_id >= 0"))
def knn_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    allowed = v.where("row_id % 3 = 0").select("row_id")
    return _round(exact.knn(exact.prefilter(v, allowed), _queries(v), K), "distance")


@_query(_top(_L2, "label = 3"))
def knn_label_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return _round(exact.knn(exact.where_label(v, F.col("label") == 3), _queries(v), K), "distance")


@_query(f"""{_V}, d AS (SELECT query_id, row_id, {_L2} AS distance FROM q, v WHERE row_id IN (3, 5, 8, 13)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d),
s AS (SELECT query_id, unnest(range(1, 11)) AS rank FROM q)
SELECT s.query_id, s.rank::INT AS rank, coalesce(row_id, -1) AS row_id, round(coalesce(distance, 3.4028234663852886e38), 6) AS distance FROM s LEFT JOIN r USING (query_id, rank)""")
def knn_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of four allowed rows leaves fewer than k results at any size."""
    v = _vectors(spark, sf_dir)
    q = _queries(v)
    allowed = spark.createDataFrame([(i,) for i in (3, 5, 8, 13)], "row_id long")
    return _round(exact.padded(exact.knn(exact.prefilter(v, allowed), q, K), q, K), "distance")


_C = "c AS (SELECT row_id::INT AS list_id, e AS c FROM v WHERE row_id < 8)"
_CL2 = "list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_A = f"{_V}, {_C}, a0 AS (SELECT row_id, e, list_id, c, {_CL2} AS d, row_number() OVER (PARTITION BY row_id ORDER BY {_CL2}, list_id) AS r FROM v, c), a AS (SELECT * FROM a0 WHERE r = 1)"


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    c = v.where("row_id < 8").select(F.col("row_id").cast("int").alias("list_id"), F.col("embedding").alias("centroid"))
    return cluster.assign_nearest(v.select("row_id", "embedding"), c), c


@_query(f"{_A} SELECT row_id, list_id, round(d, 6) AS coarse_distance FROM a")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_assigned(spark, sf_dir)[0].select("row_id", "list_id", "coarse_distance"), "coarse_distance")


@_query(f"{_A}, u AS (SELECT list_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a), m AS (SELECT list_id, i, avg(x) AS x FROM u GROUP BY 1, 2) SELECT list_id, list(round(x, 6) ORDER BY i) AS centroid FROM m GROUP BY list_id")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster.lloyd_step(_assigned(spark, sf_dir)[0])
    return out.select("list_id", F.transform("centroid", _six).alias("centroid"))


@_query(f"{_A} SELECT list_id, count(*) AS n FROM a GROUP BY list_id")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].groupBy("list_id").agg(F.count("*").alias("n"))


_R = "r0 AS (SELECT row_id, list_id, list_transform(list_zip(e, c), lambda z: z[1] - z[2]) AS r FROM a), u AS (SELECT row_id, list_id, unnest(r) AS x, generate_subscripts(r, 1) AS i FROM r0), b AS (SELECT list_id, i, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1, 2)"


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = _assigned(spark, sf_dir)
    return a.join(F.broadcast(c), "list_id").select("row_id", "list_id", V.residual(F.col("embedding"), F.col("centroid")).alias("residual"))


@_query(f"{_A}, {_R} SELECT list_id, list(round(lo, 6) ORDER BY i) AS mins, list(round(hi, 6) ORDER BY i) AS maxs FROM b GROUP BY list_id")
def sq_bounds_per_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = cluster.sq_bounds(_residuals(spark, sf_dir))
    return b.select("list_id", *[F.transform(x, _six).alias(x) for x in ("mins", "maxs")])


@_query(f"{_A}, {_R} SELECT row_id, list((CASE WHEN lo >= hi THEN 0 ELSE floor(least(greatest((x - lo) * 255 / (hi - lo), 0), 255) + 0.5) END)::INT ORDER BY i) AS code FROM u JOIN b USING (list_id, i) GROUP BY row_id")
def sq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residuals(spark, sf_dir)
    return r.join(F.broadcast(cluster.sq_bounds(r)), "list_id").select("row_id", V.sq_encode(F.col("residual"), F.col("mins"), F.col("maxs")).alias("code"))


def _index(spark: SparkSession, sf_dir: str, kind: str, metric: str = "l2", **options) -> tuple[DataFrame, ivf.IvfIndex]:
    v = _vectors(spark, sf_dir)
    n = v.count()
    c = config.IndexConfig(kind, 64, metric, nlist=config.infer_nlist(n), **options)
    return v, ivf.IvfIndex.build(v.select("row_id", "embedding"), c)


@_query(_top(_L2))
def ivf_flat_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, index = _index(spark, sf_dir, "ivf_flat")
    # codes are single precision: exact distances from the raw rows of what was found
    found = index.search(_queries(v), config.SearchParams.ivf(2 * K, index.model.config.nlist))
    again = found.join(v, "row_id").join(_queries(v), "query_id").select("query_id", "row_id", V.l2_squared(F.col("q"), F.col("embedding")).alias("distance"))
    return _round(exact.top_k(again, K), "distance")


def _recall(kind: str, metric: str, least: float, **options):
    # approximate: what is held against SQL is that the recall over exact results reaches the stated bound
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, index = _index(spark, sf_dir, kind, metric, **options)
        q = _queries(v)
        r = evaluate.recall(index.search(q, config.SearchParams.automatic(K)), exact.knn(v, q, K, metric))
        return r.select((F.col("recall") >= least).alias("reached"), F.lit(least).alias("bound"))

    run.__name__ = f"{kind}_{metric}_recall"
    _query(f"SELECT TRUE AS reached, {least}::DOUBLE AS bound")(run)


for _kind, _metric, _least, _o in (("ivf_sq", "l2", 0.9, {}), ("ivf_pq", "l2", 0.5, {"pq_m": 16}), ("ivf_rq", "cosine", 0.6, {}), ("ivf_pq", "inner_product", 0.5, {"pq_m": 16})):
    _recall(_kind, _metric, _least, **_o)


def _graph(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, graph.GraphIndex]:
    v = _vectors(spark, sf_dir).select("row_id", "embedding")
    return v, graph.GraphIndex.build(v, config.IndexConfig("diskann", 64, "l2", max_degree=32, build_l=64, pq_m=4, **options))


@_query("SELECT TRUE AS reached, 0.9::DOUBLE AS bound")
def graph_l2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, index = _graph(spark, sf_dir)
    q = _queries(v)
    r = evaluate.recall(index.search(q, config.SearchParams.diskann(K, 100)), exact.knn(v, q, K))
    return r.select((F.col("recall") >= 0.9).alias("reached"), F.lit(0.9).alias("bound"))


@_query(_top(_L2))
def graph_all_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list as long as the table the walk visits every reachable row, so the result is exact."""
    v, index = _graph(spark, sf_dir)
    return _round(index.search(_queries(v), config.SearchParams.diskann(K, v.count())), "distance")


@_query(_top(_L2, "row_id % 2 = 0"))
def graph_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, index = _graph(spark, sf_dir)
    return _round(index.search(_queries(v), config.SearchParams.diskann(K, 100), v.where("row_id % 2 = 0").select("row_id")), "distance")


@_query("SELECT 2 * count(*) AS nodes, 2 * count(*) AS reachable, TRUE AS bounded FROM embeddings")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small budget makes several shards; each row is in its two nearest, and their entries reach all."""
    _, index = _graph(spark, sf_dir, memory_budget=2_000_000)
    return index.reachability().agg(F.sum("nodes").alias("nodes"), F.sum("reachable").alias("reachable"), (F.max("degree") <= 32).alias("bounded"))


@_query("SELECT * FROM (VALUES (10, 1, 1, 100), (1000, 8, 8, 100), (1000000, 1024, 64, 100), (1183514, 1024, 64, 100)) t(n, nlist, nprobe, l_search)")
def inferred_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, config.infer_nlist(n), config.infer_nprobe(config.infer_nlist(n), n, K), config.infer_l_search(K)) for n in (10, 1000, 1_000_000, 1_183_514)]
    return spark.createDataFrame(rows, "n int, nlist int, nprobe int, l_search int")


@_query(f"{_A}, {_R}, s AS (SELECT row_id, i, CASE WHEN lo >= hi THEN lo ELSE lo + floor(least(greatest((x - lo) * 255 / (hi - lo), 0), 255) + 0.5) * (hi - lo) / 255 END AS y FROM u JOIN b USING (list_id, i)) SELECT row_id, list(round(y, 6) ORDER BY i) AS residual FROM s GROUP BY row_id")
def sq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _residuals(spark, sf_dir)
    near = r.join(F.broadcast(cluster.sq_bounds(r)), "list_id")
    codes = V.sq_encode(F.col("residual"), F.col("mins"), F.col("maxs"))
    return near.select("row_id", F.transform(V.sq_decode(codes, F.col("mins"), F.col("maxs")), _six).alias("residual"))


# two results of different widths, and each row's list twice
_TWO = f"{_V}, d AS (SELECT query_id, row_id, {_L2} AS distance FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM d)"


@_query(f"{_TWO}, a AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT * FROM r WHERE rank BETWEEN 3 AND 12) SELECT count(*)::DOUBLE / (SELECT count(*) FROM a) AS stability FROM a JOIN b USING (query_id, row_id)")
def top_k_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    r = exact.knn(v, _queries(v), 12)
    return evaluate.stability(r.where("rank <= 10"), r.where("rank >= 3"))


@_query(f"{_TWO}, a AS (SELECT * FROM r WHERE rank <= 10), b AS (SELECT * FROM r WHERE rank <= 6) SELECT (SELECT count(*) FROM b)::DOUBLE / count(*) AS recall FROM a")
def recall_of_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    r = exact.knn(v, _queries(v), 10)
    return evaluate.recall(r.where("rank <= 6"), r)


@_query(_top(_L2))
def top_k_of_repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row found twice, once at a greater distance: the better one counts."""
    v = _vectors(spark, sf_dir)
    r = exact.knn(v, _queries(v), 2 * K)
    return _round(exact.top_k(r.unionByName(r.withColumn("distance", F.col("distance") + 1)), K, dedup=True), "distance")


@_query(f"{_V}, s AS (SELECT list(list_inner_product(e, e) ORDER BY list_inner_product(e, e)) AS x FROM v) SELECT round(x[(floor((len(x) - 1) * 95 / 100))::INT + 1], 6) AS percentile FROM s")
def percentile_lower_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _vectors(spark, sf_dir).select(V.norm_squared(F.col("embedding")).alias("n"))
    return _round(evaluate.percentile(n, "n", 95), "percentile")
