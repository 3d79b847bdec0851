"""Further registered queries: sources, predicates, views, large products, gradients, timing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.catalog import _CELLS, _HASH, _LOG, _M5, _NET, _SIZES, _net_data, _quality_data, DIM, embeddings, parts, query, rounded, table
from gridloom.functions import elementwise as E
from gridloom.operators import anomaly, descent, linalg, neural, reductions, regression, search, sets, shape, split
from gridloom.plans.matrix import Matrix
from gridloom.plans.timing import flow
from gridloom.plans.workspace import fresh
from gridloom.sources import files, generators


def _nation(spark, sf_dir) -> Matrix:
    return Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])


# --- sources ---


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS i, p_partkey::DOUBLE AS f0, p_size::DOUBLE AS f1, p_retailprice AS f2 FROM part")
def delimited_read(spark, sf_dir):
    path = f"{fresh(spark, 'delimited')}/csv"
    table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").repartitionByRange(1, "p_partkey").sortWithinPartitions("p_partkey").write.csv(path, header=True)
    return files.read_delimited(spark, path).to_wide().df


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS i, n_regionkey::DOUBLE AS target FROM nation")
def features_and_target(spark, sf_dir):
    features, target = files.features_and_target(_nation(spark, sf_dir))
    return features.to_wide().df.join(target.to_wide().df.withColumnRenamed("f0", "target"), "i").select("i", "target")


@query("SELECT n_nationkey::BIGINT AS i, n_nationkey::DOUBLE AS f0, n_regionkey::DOUBLE AS f1, n_regionkey::DOUBLE AS f2, n_nationkey::DOUBLE AS f3 FROM nation")
def idx_images(spark, sf_dir):
    path = f"{fresh(spark, 'idx')}/images"
    files.write_idx(search.columns(_nation(spark, sf_dir), [0, 1, 1, 0]), path, 2)
    return files.read_idx(spark, path).to_wide().df


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::DOUBLE AS f0 FROM nation")
def idx_labels(spark, sf_dir):
    path = f"{fresh(spark, 'idx')}/labels"
    files.write_idx(search.column(_nation(spark, sf_dir), 1), path)
    return files.read_idx(spark, path, images=False).to_wide().df


@query("SELECT p_partkey AS i, 0 AS j, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")
def catalog_views(spark, sf_dir):
    held = files.Catalog(gridloom_parts=parts(spark, sf_dir), gone=parts(spark, sf_dir))
    held.release("gone")
    held.as_views()
    return spark.sql(f"SELECT i, j, v FROM {next(iter(held))}")


@query("SELECT count(*) AS \"rows\", 64 * count(*) AS cells, 8 * 64 * count(*) AS bytes, true AS timed FROM embeddings")
def timed_flow(spark, sf_dir):
    told = flow(embeddings(spark, sf_dir).map(E.sqr))
    return spark.createDataFrame([(told.rows, told.cells, told.bytes, told.seconds > 0 and told.gb_per_second > 0)], "rows long, cells long, bytes long, timed boolean")


# --- shape queries and residency ---


@query("SELECT count(*) AS m, 2 AS n, 2 * count(*) AS length, 16 * count(*) AS bytes, greatest(count(*), 2) AS long_axis, false AS vector, false AS square, true AS inside, false AS outside FROM part")
def shape_of(spark, sf_dir):
    x = parts(spark, sf_dir).persist()
    row = (x.m, x.n, x.length, x.size_bytes, x.long_axis, x.is_vector, x.is_square, x.contains(1, 1), x.contains(0, 2))
    x.release()
    return spark.createDataFrame([row], "m long, n int, length long, bytes long, long_axis long, vector boolean, square boolean, inside boolean, outside boolean")


@query("SELECT 'i' AS col, 'bigint' AS kind UNION ALL SELECT 'f0', 'double' UNION ALL SELECT 'f1', 'double'")
def types_of(spark, sf_dir):
    x = parts(spark, sf_dir)
    return spark.createDataFrame(list(zip(x.df.columns, x.types, strict=True)), "col string, kind string")


@query("SELECT CAST(id AS BIGINT) AS id, id % 15 = 3 AS in_column, id // 15 = 2 AS in_row FROM range(300) t(id)")
def index_masks(spark, sf_dir):
    return spark.range(300).select("id", E.is_column(3, 15)(F.col("id")).alias("in_column"), E.is_row(2, 15)(F.col("id")).alias("in_row"))


@query("SELECT 'row' AS kind, CAST(k AS BIGINT) AS \"at\" FROM range(6, 8) t(k) UNION ALL SELECT 'column', 2 * k + 1 FROM range(25) t(k) UNION ALL SELECT 'range', k FROM range(4, 10) t(k)")
def linear_indices(spark, sf_dir):
    x = _nation(spark, sf_dir)
    rows = [("row", k) for k in search.row_indices(x, 3)] + [("column", k) for k in search.column_indices(x, 1)] + [("range", k) for k in search.index_range(4, 9)]
    return spark.createDataFrame(rows, "kind string, at long")


@query("SELECT CAST(0 AS BIGINT) AS i, CAST(2 * n_nationkey + c AS INTEGER) AS j, CASE c WHEN 0 THEN n_nationkey ELSE n_regionkey END::DOUBLE AS v FROM nation, range(2) t(c)")
def posed_as_row(spark, sf_dir):
    return shape.as_row(_nation(spark, sf_dir)).df


@query("SELECT CAST(2 * n_nationkey + c AS BIGINT) AS i, 0 AS j, CASE c WHEN 0 THEN n_nationkey ELSE n_regionkey END::DOUBLE AS v FROM nation, range(2) t(c)")
def posed_as_column(spark, sf_dir):
    return shape.as_column(_nation(spark, sf_dir)).df


@query("SELECT n_nationkey::BIGINT AS i, CAST(c AS INTEGER) AS j, CASE c WHEN 0 THEN n_nationkey ELSE n_regionkey END::DOUBLE AS v FROM nation, range(2) t(c)")
def unposed(spark, sf_dir):
    return shape.reshape(shape.as_row(_nation(spark, sf_dir)), 25, 2).df


@query("SELECT n_nationkey::BIGINT AS i, 0 AS j, n_regionkey * 3.0::DOUBLE AS v FROM nation")
def unconcat(spark, sf_dir):
    a = search.column(_nation(spark, sf_dir), 1)
    b = Matrix((a * 3).df, a.layout, 1, 25)
    joined = shape.concat([_nation(spark, sf_dir), b])
    return shape.unconcat(joined, 25, 1, 50).df


@query("SELECT 42.0::DOUBLE AS v")
def scalar_of(spark, sf_dir):
    return spark.createDataFrame([(shape.to_scalar(generators.from_scalar(spark, 42)),)], "v double")


@query("SELECT CAST(k AS INTEGER) AS \"at\", k::DOUBLE AS packed, 0.0::DOUBLE AS off FROM range(11) t(k)")
def packed(spark, sf_dir):
    flat, shapes = shape.pack([np.arange(6.0).reshape(2, 3), np.arange(6.0, 11.0).reshape(5, 1)])
    again, _ = shape.pack(shape.unpack(flat, shapes))
    return spark.createDataFrame([(k, float(v), float(abs(w - v))) for k, (v, w) in enumerate(zip(flat, again, strict=True))], "at int, packed double, off double")


@query("SELECT p_partkey AS i, p_retailprice AS f0 FROM part")
def column_matrix(spark, sf_dir):
    return search.column(parts(spark, sf_dir), 1).df


@query(f"SELECT CAST(0 AS BIGINT) AS i, j, round(v, 9) AS v FROM ({_CELLS}) WHERE i = 3")
def row_matrix(spark, sf_dir):
    return rounded(search.row(embeddings(spark, sf_dir), 3).to_coo().df, 9)


# --- values and predicates ---


@query("SELECT p_partkey, CASE WHEN x > 0 THEN CAST(round(ln(x), 6) AS VARCHAR) WHEN x = 0 THEN '-Infinity' ELSE 'NaN' END AS log FROM (SELECT p_partkey, p_size - 25.0::DOUBLE AS x FROM part)")
def log_edges(spark, sf_dir):
    x = E.UNARY["log"](F.col("p_size") - 25.0)
    plain = F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("string")).otherwise(F.round(x, 6).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", plain.alias("log"))


@query("SELECT p_partkey, round(1 / (1 + 1 - x + x * x / 2 - x * x * x / 6 + x * x * x * x / 24), 9) AS v FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)")
def sigmoid_by_series(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(E.sigmoid_series(4)(F.col("p_size") / 50.0), 9).alias("v"))


@query("SELECT p_partkey, p_size::DOUBLE * p_size AS sqr, p_size + p_retailprice AS added, round(1 / (1.0::DOUBLE + p_size), 9) AS step FROM part")
def functions_by_name(spark, sf_dir):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", E.REGISTRY["sqr"](a).alias("sqr"), E.REGISTRY["binary_add"](a, b).alias("added"), F.round(E.REGISTRY["index_step"](a), 9).alias("step"))


@query("SELECT false AS zero, true AS zero_less_itself, false AS biased, true AS biased_with_bias, false AS binary, (SELECT bool_and(quality IN (0, 1)) FROM labels) AS binary_labels")
def predicates(spark, sf_dir):
    x, y = parts(spark, sf_dir), Matrix.from_wide(table(spark, sf_dir, "labels"), "doc_id", ["quality"])
    row = (reductions.is_zero(x), reductions.is_zero(x - x), reductions.is_biased(x), reductions.is_biased(shape.bias(x)), reductions.is_binary(x), reductions.is_binary(y))
    return spark.createDataFrame([row], "zero boolean, zero_less_itself boolean, biased boolean, biased_with_bias boolean, binary boolean, binary_labels boolean")


@query("SELECT 7 AS place, -1 AS nowhere")
def place_in_row(spark, sf_dir):
    row = generators.sequence(spark, 1, 20, 3, 2)
    return spark.createDataFrame([(search.index_in_row(row, 17), search.index_in_row(row, 18))], "place int, nowhere int")


@query("SELECT key::DOUBLE AS key, CAST((SELECT count(*) FROM range(1, 20, 2) o(x) WHERE x < key - 0.25::DOUBLE) AS BIGINT) AS at FROM (VALUES (0.0), (1.2), (1.5), (2.0), (8.9), (11.25), (18.0), (20.0)) k(key)")
def search_within_epsilon(spark, sf_dir):
    odds = spark.range(1, 20, 2).select(F.col("id").alias("v"))
    keys = spark.createDataFrame([(k,) for k in (0.0, 1.2, 1.5, 2.0, 8.9, 11.25, 18.0, 20.0)], "key double")
    return search.insertion_points(odds, keys, eps=0.25)


@query("SELECT event_id, value, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS rank FROM events")
def sorted_ranks(spark, sf_dir):
    return sets.ranked(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")


@query("SELECT p_brand AS grp, p_size::DOUBLE AS v, count(*) AS cnt FROM part GROUP BY p_brand, p_size")
def almost_distinct(spark, sf_dir):
    return sets.almost_distinct(table(spark, sf_dir, "part"), "p_size", "p_partkey", 0.5, "p_brand")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS INTEGER) AS place, value FROM events")
def sorted_arrays(spark, sf_dir):
    arrays = table(spark, sf_dir, "events").groupBy("user_id").agg(sets.sorted_array(F.collect_list("value")).alias("all"))
    return arrays.select("user_id", F.posexplode("all").alias("place", "value"))


# --- products and small matrices ---

_B = np.sin(np.arange(1, DIM * 3 + 1, dtype=float)).reshape(DIM, 3)
_GRAM = f"WITH c AS ({_CELLS}) SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM c a JOIN c b USING (i) GROUP BY a.j, b.j"


@query(f"WITH c AS ({_CELLS}) SELECT a.i, CAST(b.k AS INTEGER) AS j, round(sum(a.v * sin(a.j * 3 + b.k + 1.0::DOUBLE)), 7) + 0.0 AS v FROM c a, range(3) b(k) GROUP BY a.i, b.k")
def product_by_shapes(spark, sf_dir):
    return rounded((embeddings(spark, sf_dir) @ Matrix.from_numpy(spark, _B)).to_coo().df, 7)


@query(f"WITH c AS ({_CELLS}) SELECT CAST(b.k AS BIGINT) AS i, CAST(a.i AS INTEGER) AS j, round(sum(a.v * sin(a.j * 3 + b.k + 1.0::DOUBLE)), 7) + 0.0 AS v FROM c a, range(3) b(k) GROUP BY a.i, b.k")
def product_small_first(spark, sf_dir):
    return rounded((Matrix.from_numpy(spark, _B.T) @ embeddings(spark, sf_dir).T).to_coo().df, 7)


@query(_GRAM)
def product_by_blocks(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return rounded(linalg.product_blocks(x.T, x, 48).df, 5)


@query("SELECT CAST(0 AS BIGINT) AS i, round(var_pop(p_size), 6) AS f0, 0.0::DOUBLE AS f1 FROM part UNION ALL SELECT 1, 0.0, round(var_pop(p_retailprice), 6) FROM part")
def diagonal_covariance(spark, sf_dir):
    var = np.array(reductions.variances(parts(spark, sf_dir)).first())
    return rounded(Matrix.from_numpy(spark, linalg.diagonal_covariance(var)).to_wide().df, 6)


@query("SELECT 1050.0::DOUBLE AS by_first_row, 0.0::DOUBLE AS off_by_cofactors, true AS singular")
def cofactors(spark, sf_dir):
    a = np.array(_M5, float).reshape(5, 5)
    by_row = sum(a[0, j] * linalg.cofactor(a, 0, j) for j in range(5))
    off = float(np.abs(linalg.inverse(a, 1050) @ a - np.eye(5)).max())
    return rounded(spark.createDataFrame([(float(by_row), off, linalg.LU(np.ones((3, 3))).is_singular)], "by_first_row double, off_by_cofactors double, singular boolean"), 6)


# --- models ---


@query(f"WITH c AS ({_CELLS}), s AS (SELECT j, avg(v) AS mu, var_pop(v) AS var FROM c GROUP BY j) SELECT i, round(sum(ln(1 / sqrt(2 * pi())) - (v - mu) * (v - mu) / (2 * var) - ln(var) / 2), 6) AS logp FROM c JOIN s USING (j) GROUP BY i")
def row_log_densities(spark, sf_dir):
    return rounded(anomaly.row_log_densities(embeddings(spark, sf_dir)), 6)


@query("SELECT 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1")
def sigma_vector(spark, sf_dir):
    return rounded(anomaly.sigma_vector(parts(spark, sf_dir)), 9)


@query("SELECT CAST(x AS DOUBLE) AS x, round(1 / sqrt(2 * pi() * 4) * exp(-(x - 1) * (x - 1) / 8.0::DOUBLE), 12) AS p FROM range(-5, 6) t(x)")
def density_of_values(spark, sf_dir):
    return spark.createDataFrame([(float(x), round(anomaly.density_of(x, 1, 4), 12)) for x in range(-5, 6)], "x double, p double")


_H2 = ["1 / (1 + exp(-(0.5 * f0 + 1.0 * f1 - 0.25 * f2)))", "1 / (1 + exp(-(-0.4 * f0 - 0.8 * f1 + 0.3 * f2)))"]


@query(f"""WITH h AS (SELECT y, ({_H2[0]})::DOUBLE AS h1, ({_H2[1]})::DOUBLE AS h0 FROM {_LOG}) SELECT round(-avg(y * ln(h1) + (1 - y) * ln(1 - h1)) - avg((1 - y) * ln(h0) + y * ln(1 - h0))
    + 3.0 / (2 * count(*)) * (1 + 0.0625 + 0.64 + 0.09), 8) AS cost FROM h""")
def logreg_cost_by_class(spark, sf_dir):
    cost = regression.logistic_cost_classes(_quality_data(spark, sf_dir), np.array([[0.5, 1.0, -0.25], [-0.4, -0.8, 0.3]]), [1.0, 0.0], 3.0)
    return rounded(spark.createDataFrame([(float(cost),)], "cost double"), 8)


@query(f"""WITH h AS (SELECT *, ({_H2[0]})::DOUBLE AS h FROM {_LOG}) SELECT round(sum((h - y) * f0) / count(*), 5) + 0.0 AS g0, round(sum((h - y) * f1) / count(*) + 3.0 / count(*), 5) + 0.0 AS g1,
    round(sum((h - y) * f2) / count(*) - 3.0 * 0.25 / count(*), 5) + 0.0 AS g2 FROM h""")
def numeric_gradient(spark, sf_dir):
    """Central differences, all points in one pass."""
    data = _quality_data(spark, sf_dir)
    g = descent.numeric_gradients(lambda points: regression.logistic_costs(data, points, 3.0), np.array([0.5, 1.0, -0.25]))
    return rounded(spark.createDataFrame([tuple(map(float, g))], "g0 double, g1 double, g2 double"), 5)


@query(f"WITH h AS (SELECT y, ({_H2[0]})::DOUBLE AS h FROM {_LOG}) SELECT round(100 * avg(CASE WHEN (h >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 8) AS accuracy FROM h")
def logreg_accuracy(spark, sf_dir):
    return rounded(regression.accuracy(regression.logistic_predict(_quality_data(spark, sf_dir), np.array([0.5, 1.0, -0.25]))), 8)


_BACK = (
    _NET
    + f""", m AS (SELECT count(*)::DOUBLE AS m FROM embeddings), d2 AS (SELECT vec_id, o, v - CASE WHEN label = o THEN 1 ELSE 0 END AS d FROM h JOIN embeddings USING (vec_id)),
    a1 AS (SELECT * FROM a UNION ALL SELECT vec_id, 0, 1.0::DOUBLE FROM embeddings),
    g2 AS (SELECT 2 AS layer, o, k, sum(d * v) AS g FROM d2 JOIN a1 USING (vec_id) GROUP BY o, k),
    d1 AS (SELECT d2.vec_id, k - 1 AS o, sum(d * w) * any_value(a.v) * (1 - any_value(a.v)) AS d FROM d2 JOIN w2 USING (o) JOIN a USING (vec_id, k) GROUP BY d2.vec_id, k),
    g1 AS (SELECT 1 AS layer, o, k, sum(d * v) AS g FROM d1 JOIN x USING (vec_id) GROUP BY o, k)
    SELECT layer, CAST(o AS INTEGER) AS o, CAST(k AS INTEGER) AS k, round(g / m + CASE WHEN k > 0 THEN 3.0 * w / m ELSE 0 END, 7) + 0.0 AS g
    FROM (SELECT g1.*, w FROM g1 JOIN w1 USING (o, k) UNION ALL SELECT g2.*, w FROM g2 JOIN w2 USING (o, k)), m"""
)


@query(_BACK)
def nn_gradients(spark, sf_dir):
    """Back-propagated gradients of all weights, from the packed cost that the minimiser takes."""
    flat, shapes = shape.pack(neural.sin_weights(_SIZES))
    _, grad = neural.packed_cost(_net_data(spark, sf_dir), shapes, 3.0)(flat)
    cells = [(layer + 1, o, k, float(v)) for layer, g in enumerate(shape.unpack(grad, shapes)) for (o, k), v in np.ndenumerate(g)]
    return rounded(spark.createDataFrame(cells, "layer int, o int, k int, g double"), 7)


@query("SELECT true AS close")
def nn_check(spark, sf_dir):
    """Gradients against central differences, on a network of two inputs."""
    data = _net_data(spark, sf_dir).select(F.slice("x", 1, 2).alias("x"), (F.col("y") % 2 + 1).alias("y")).persist()
    gap = neural.gradient_check(data, neural.sin_weights([2, 2, 2]), 0.5)
    data.unpersist()
    return spark.createDataFrame([(gap < 1e-7,)], "close boolean")


@query("SELECT '64-' || a || '-' || b || '-10' AS sizes, CAST(65 * a + (a + 1) * b + (b + 1) * 10 AS BIGINT) AS weights FROM (VALUES (4), (8)) s(a), (VALUES (3), (5), (7)) t(b)")
def nn_topologies(spark, sf_dir):
    found = neural.topologies(DIM, [[4, 8], [3, 5, 7]], 10, lambda sizes: sum(w.size for w in neural.init(sizes)))
    return spark.createDataFrame([("-".join(map(str, sizes)), n) for sizes, n in found], "sizes string, weights long")


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS r, count(*) OVER () AS m FROM ({_HASH})) SELECT doc_id FROM r WHERE r >= floor(m * 0.25 + 0.5)")
def shuffle_rest(spark, sf_dir):
    return split.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25, 7)[1]
