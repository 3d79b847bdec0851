"""Registered queries over the test tables and the SQL that each is held against.

Sums and products of floating-point values are rounded well above their error on either side, so that both engines write the
same number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import elementwise as E
from gridloom.operators import anomaly, kmeans, linalg, neural, numbers, reductions, regression, search, sets, shape, split
from gridloom.plans.matrix import Matrix
from gridloom.plans.workspace import fresh
from gridloom.sources import files, generators
from gridloom.streaming import moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int | dict[str, int]) -> DataFrame:
    """df with its double columns rounded; -0.0 becomes 0.0."""
    of = (lambda c: places) if isinstance(places, int) else (lambda c: places.get(c, 6))
    return df.select(*((F.round(F.col(c), of(c)) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DIM = 64


def line_items(spark: SparkSession, sf_dir: str) -> Matrix:
    return Matrix.from_wide(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE)


def embeddings(spark: SparkSession, sf_dir: str) -> Matrix:
    return Matrix.from_vec(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DIM)


def parts(spark: SparkSession, sf_dir: str) -> Matrix:
    return Matrix.from_wide(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"])


_CELLS = "SELECT vec_id AS i, CAST(unnest(range(0, 64)) AS INTEGER) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"

# --- statistics of feature columns ---


@query(
    """WITH s AS (SELECT avg(l_quantity) AS m0, var_pop(l_quantity) AS v0, avg(l_extendedprice) AS m1, var_pop(l_extendedprice) AS v1,
    avg(l_discount) AS m2, var_pop(l_discount) AS v2, avg(l_tax) AS m3, var_pop(l_tax) AS v3 FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(4 * ln(1 / sqrt(2 * pi()))
    - (l_quantity - m0) * (l_quantity - m0) / (2 * v0) - ln(v0) / 2 - (l_extendedprice - m1) * (l_extendedprice - m1) / (2 * v1) - ln(v1) / 2
    - (l_discount - m2) * (l_discount - m2) / (2 * v2) - ln(v2) / 2 - (l_tax - m3) * (l_tax - m3) / (2 * v3) - ln(v3) / 2, 6) AS logp
    FROM lineitem, s ORDER BY logp, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10"""
)
def lowest_density(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    wide = table(spark, sf_dir, "lineitem").select(*keys, *(F.col(c).alias(f"f{k}") for k, c in enumerate(LINE)))
    x = Matrix(wide, "wide", 4)
    return rounded(anomaly.row_log_densities(x, keep=tuple(keys)), 6).orderBy("logp", *keys).limit(10)


@query("SELECT round(avg(l_quantity), 8) AS f0, round(avg(l_extendedprice), 6) AS f1, round(avg(l_discount), 10) AS f2, round(avg(l_tax), 10) AS f3 FROM lineitem")
def feature_means(spark, sf_dir):
    return rounded(reductions.means(line_items(spark, sf_dir)), {"f0": 8, "f1": 6, "f2": 10, "f3": 10})


@query("SELECT round(var_pop(l_quantity), 6) AS f0, round(var_pop(l_extendedprice) / 1e6, 6) AS f1, round(var_pop(l_discount), 10) AS f2, round(var_pop(l_tax), 10) AS f3 FROM lineitem")
def feature_variance(spark, sf_dir):
    return rounded(reductions.variances(line_items(spark, sf_dir)).withColumn("f1", F.col("f1") / 1e6), {"f0": 6, "f1": 6, "f2": 10, "f3": 10})


@query("SELECT round(avg((l_quantity - 25) * (l_quantity - 25)), 6) AS f0, round(avg((l_extendedprice - 30000) * (l_extendedprice - 30000)) / 1e6, 6) AS f1, round(avg((l_discount - 0.05) * (l_discount - 0.05)), 10) AS f2, round(avg((l_tax - 0.04::DOUBLE) * (l_tax - 0.04::DOUBLE)), 10) AS f3 FROM lineitem".replace("0.05)", "0.05::DOUBLE)"))
def variance_about_given_means(spark, sf_dir):
    return rounded(reductions.variances(line_items(spark, sf_dir), [25, 30000, 0.05, 0.04]).withColumn("f1", F.col("f1") / 1e6), {"f0": 6, "f1": 6, "f2": 10, "f3": 10})


@query("SELECT round(avg(p_size), 8) AS mu_0, round(avg(p_retailprice), 8) AS mu_1, round(var_pop(p_size), 8) AS var_0, round(var_pop(p_retailprice), 6) AS var_1 FROM part")
def fit_gaussians(spark, sf_dir):
    return rounded(reductions.fit_gaussians(parts(spark, sf_dir)), {"mu_0": 8, "mu_1": 8, "var_0": 8, "var_1": 6})


@query("SELECT round(sum(l_quantity), 4) AS f0, round(sum(l_extendedprice), 2) AS f1, round(sum(l_discount), 6) AS f2, round(sum(l_tax), 6) AS f3 FROM lineitem")
def column_sums(spark, sf_dir):
    return rounded(reductions.reduce_columns(line_items(spark, sf_dir), reductions.SUM), {"f0": 4, "f1": 2, "f2": 6, "f3": 6})


@query("SELECT least(min(l_quantity), min(l_extendedprice), min(l_discount), min(l_tax)) AS low, greatest(max(l_quantity), max(l_extendedprice), max(l_discount), max(l_tax)) AS high FROM lineitem")
def bounds(spark, sf_dir):
    return reductions.reduce_many(line_items(spark, sf_dir), low=(reductions.MIN,), high=(reductions.MAX,))


@query("SELECT p_partkey AS i, round(p_size + p_retailprice, 6) AS v FROM part")
def row_sum(spark, sf_dir):
    return rounded(reductions.row_sums(parts(spark, sf_dir)), 6)


@query("SELECT vec_id AS i, round(list_max(embedding)::DOUBLE, 9) AS v FROM embeddings")
def row_reduce_max(spark, sf_dir):
    return rounded(reductions.by_row(embeddings(spark, sf_dir), reductions.MAX), 9)


@query(f"SELECT j, round(sum(v), 6) AS v FROM ({_CELLS}) GROUP BY j")
def column_sums_by_cell(spark, sf_dir):
    return rounded(reductions.by_column(embeddings(spark, sf_dir), reductions.SUM), 6)


@query("SELECT round(exp(sum(ln(1 + l_discount / 1000))), 6) AS f0 FROM lineitem")
def column_product(spark, sf_dir):
    x = Matrix.from_wide(table(spark, sf_dir, "lineitem").select("l_orderkey", (1 + F.col("l_discount") / 1000).alias("d")), "l_orderkey", ["d"])
    return rounded(reductions.reduce_columns(x, reductions.PROD), 6)


# --- elementwise ---

_X = "(p_retailprice - 950) / 10"


@query(f"""WITH t AS (SELECT p_partkey, {_X} AS x, p_size FROM part) SELECT p_partkey, round(1 / (1 + exp(-x)), 9) AS sigmoid,
    round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 9) AS sigmoid_grad, round(ln(1 + exp(-x)), 9) AS softplus, round(-x * x - 2 * x + 11.5, 9) AS deg2,
    round(x * x - 2 * x - 11.5, 9) AS poly2, round(-x, 9) + 0.0 AS negate, CASE WHEN x > 0 THEN round(ln(x), 9) END AS log, floor(x) + 0.0 AS floor, ceil(x) + 0.0 AS ceil, round(abs(x), 9) AS abs,
    CASE WHEN x = 0 THEN 0 ELSE round(1 / x, 9) END AS one_over, round(exp(x), 6) AS exp, round(sqrt(abs(x)), 9) AS sqrt, round(x * x, 9) AS sqr, round(x * x * x, 6) AS cube,
    round(1 / sqrt(p_size), 9) AS inv_sqrt, CAST(p_size IN (0, 1) AS DOUBLE) AS one_or_zero, CAST(sign(x) AS DOUBLE) AS sign FROM t""")
def unary_suite(spark, sf_dir):
    x = (F.col("p_retailprice") - 950) / 10
    size = F.col("p_size").cast("double")
    arg = {"sqrt": F.abs(x), "inv_sqrt": size, "one_or_zero": size}
    cols = {name: f(arg.get(name, x)) for name, f in E.UNARY.items()}
    cols["log"] = F.when(x > 0, cols["log"])
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in cols.items())), {k: 9 for k in cols} | {"exp": 6, "cube": 6})


@query("""SELECT p_partkey, round(pow(s, 3.0), 6) AS pow, round(s * s * s * s, 6) AS int_pow, s * 2.5 AS scale, s + 7 AS translate, 100 - s AS sub_from,
    round(s * (1 / 3.0::DOUBLE), 9) AS div_scalar, round(12 / s, 9) AS scalar_div, CASE WHEN 60 % p_size = 0 THEN s ELSE 0 END AS divisible,
    CASE WHEN 60 % p_size = 0 AND 24 % p_size = 0 THEN s ELSE 0 END AS divides_both, round(sqrt(s / 7), 9) AS div_sqrt,
    CAST(s < 25 AS DOUBLE) AS lt, CAST(s <= 25 AS DOUBLE) AS lte, CAST(s > 25 AS DOUBLE) AS gt, CAST(s >= 25 AS DOUBLE) AS gte, CAST(s = 25 AS DOUBLE) AS eq, CAST(s <> 25 AS DOUBLE) AS neq,
    CAST(abs(s - 25) < 0.5 AS DOUBLE) AS almost, CAST(abs(s - 25) > 0.5 AS DOUBLE) AS not_almost, CAST(CASE WHEN s = 25 THEN p_partkey ELSE 0 END AS BIGINT) AS idx
    FROM (SELECT p_partkey, p_size, p_size::DOUBLE AS s FROM part)""")
def scalar_suite(spark, sf_dir):
    s = F.col("p_size").cast("double")
    ops = {"pow": E.power(3), "int_pow": E.int_power(4), "scale": E.scale(2.5), "translate": E.translate(7), "sub_from": E.sub_from(100), "div_scalar": E.div_scalar(3), "scalar_div": E.scalar_div(12), "divisible": E.divisible(60), "divides_both": E.divides_both(60, 24), "div_sqrt": E.div_sqrt(7), "lt": E.less(25), "lte": E.less_equal(25), "gt": E.greater(25), "gte": E.greater_equal(25), "eq": E.equal(25), "neq": E.not_equal(25), "almost": E.almost_equal(25, 0.5), "not_almost": E.not_almost_equal(25, 0.5)}
    out = table(spark, sf_dir, "part").select("p_partkey", *(f(s).alias(k) for k, f in ops.items()), E.index_where_almost(25)(F.col("p_partkey"), s).cast("long").alias("idx"))
    return rounded(out, {"pow": 6, "int_pow": 6, **{k: 9 for k in ops if k not in ("pow", "int_pow")}})


@query("""SELECT p_partkey, round(a + b, 6) AS add, round(a - b, 6) AS sub, round(a * b, 4) AS hadamard, round(a / b, 9) AS quotient, CAST(z <> 0 AND b <> 0 AS DOUBLE) AS "and",
    CAST(z <> 0 OR b <> 0 AS DOUBLE) AS "or", CAST(a = b AS DOUBLE) AS equals, CAST(abs(b - a) < 900 AS DOUBLE) AS almost, round((b - a) * (b - a), 4) AS diff_sqr,
    CAST((h >= 0.5 AND z = 0) OR (h < 0.5 AND z = 1) AS DOUBLE) AS misclassified, CASE WHEN z > 0 AND p_size % z = 0 THEN z::DOUBLE ELSE 0 END AS divides, round(a * a + b * b, 4) AS sqr_plus,
    least(a, b) AS min, greatest(a, b) AS max, CASE WHEN z = 0 THEN a ELSE least(z::DOUBLE, a) END AS min_not_zero, CAST(a > b AS DOUBLE) AS greater, CAST(a < b AS DOUBLE) AS less, round(a + 0.25 * (b - a), 6) AS linterp
    FROM (SELECT p_partkey, p_size, p_size::DOUBLE AS a, p_retailprice AS b, p_size % 4 AS z, p_size / 50.0::DOUBLE AS h FROM part)""")
def binary_suite(spark, sf_dir):
    a, b = F.col("p_size").cast("double"), F.col("p_retailprice")
    z, h = (F.col("p_size") % 4).cast("double"), F.col("p_size") / 50.0
    args = {"and": (z, b), "or": (z, b), "misclassified": (h, z), "divides": (a, z), "min_not_zero": (z, a)}
    cols = {k: f(*args.get(k, (a, b))) for k, f in E.BINARY.items()}
    cols |= {"almost": E.almost(900)(a, b), "linterp": E.linterp(0.25)(a, b)}
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *(c.alias(k) for k, c in cols.items())), {k: 6 for k in cols} | {"quotient": 9, "hadamard": 4, "diff_sqr": 4, "sqr_plus": 4})


@query(f"SELECT i, j, round(1 / (1 + exp(-v)), 9) AS v FROM ({_CELLS})")
def matrix_map(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).map(E.sigmoid).to_coo().df, 9)


@query(f"WITH c AS ({_CELLS}) SELECT i, j, round(c.v * 2 + c.v * c.v, 9) AS v FROM c")
def matrix_arithmetic(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return rounded((x * 2 + x * x).to_coo().df, 9)


# --- reductions ---


@query("SELECT bool_and(value > 0) AS \"all\", bool_or(value > 100) AS \"any\", NOT bool_or(value > 1e9) AS \"none\", CAST(count(*) FILTER (value < 10) AS BIGINT) AS count FROM events")
def truths(spark, sf_dir):
    x = Matrix.from_wide(table(spark, sf_dir, "events"), "event_id", ["value"])
    asked = {"all": E.greater(0), "any": E.greater(100), "none": E.greater(1e9), "count": E.less(10)}
    return reductions.truths_of(x, asked).select(*(F.col(f"{kind}.{kind}").alias(kind) for kind in asked))


@query("SELECT round(sum(value * value) / 1e3, 4) AS auto_dot, round(sqrt(sum(value * value)), 6) AS length, round(sum(abs(value)), 4) AS l1, round(sqrt(sum(value * value)), 6) AS l2, round(pow(sum(value * value * value), 1 / 3.0::DOUBLE), 6) AS l3 FROM events")
def norms(spark, sf_dir):
    x = Matrix.from_wide(table(spark, sf_dir, "events"), "event_id", ["value"])
    r, e = reductions, reductions.expression
    return rounded(x.df.agg((e(x, r.SUM, E.sqr) / 1e3).alias("auto_dot"), F.sqrt(e(x, r.SUM, E.sqr)).alias("length"), r.norm_expression(x, 1).alias("l1"), r.norm_expression(x, 2).alias("l2"), r.norm_expression(x, 3).alias("l3")), {"auto_dot": 4, "length": 6, "l1": 4, "l2": 6, "l3": 6})


@query("SELECT CAST(sum(CAST(value AS DECIMAL(38, 18))) AS DOUBLE) AS v FROM events")
def exact_sum(spark, sf_dir):
    x = Matrix.from_wide(table(spark, sf_dir, "events"), "event_id", ["value"])
    return spark.createDataFrame([(reductions.exact_sum(x),)], "v double")


def _shifted(x: Matrix) -> Matrix:
    """Rows moved by one place; the key of the last is over the end."""
    return Matrix(x.df.withColumn("i", F.col("i") + 1), x.layout, x.n)


@query(f"WITH c AS ({_CELLS}) SELECT round(sum((a.v - b.v) * (a.v - b.v)), 5) AS v FROM c a JOIN c b ON a.i = b.i + 1 AND a.j = b.j")
def sum_sqr_diff(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return rounded(reductions.combine(x, _shifted(x), E.diff_sqr, reductions.SUM), 5)


@query(f"WITH c AS ({_CELLS}) SELECT round(sum(a.v * b.v), 5) AS v FROM c a JOIN c b ON a.i = b.i + 1 AND a.j = b.j")
def dot_product(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return rounded(reductions.combine(x, _shifted(x), E.hadamard, reductions.SUM), 5)


def _label(spark, sf_dir, col: str) -> Matrix:
    return Matrix.from_wide(table(spark, sf_dir, "labels"), "doc_id", [col])


@query("SELECT round(count(*) FILTER (quality = toxic) / count(*)::DOUBLE, 9) AS accuracy, CAST(count(*) FILTER (quality = toxic) AS DOUBLE) AS equal_cells, bool_and(quality = toxic) AS same, bool_and(abs(quality - toxic) < 2) AS almost_same FROM labels")
def two_matrices(spark, sf_dir):
    a, b = _label(spark, sf_dir, "quality"), _label(spark, sf_dir, "toxic")
    equal = reductions.combine(a, b, E.equals, reductions.SUM).first()[0]
    return rounded(spark.createDataFrame([(reductions.accuracy(a, b), equal, reductions.same(a, b), reductions.almost_same(a, b, 2))], "accuracy double, equal_cells double, same boolean, almost_same boolean"), 9)


@query("SELECT CAST(count(*) FILTER ((h >= 0.5 AND y = 0) OR (h < 0.5 AND y = 1)) AS DOUBLE) AS v FROM (SELECT quality AS y, 1 / (1 + exp(-(n_chars - 1000) / 500.0::DOUBLE)) AS h FROM labels JOIN documents USING (doc_id))")
def misclassification_count(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a = Matrix.from_wide(docs.withColumn("h", E.sigmoid((F.col("n_chars") - 1000) / 500.0)), "doc_id", ["h"])
    return a.df.join(docs.select(F.col("doc_id").alias("i"), "quality"), "i").agg(F.sum(E.misclassified(F.col("f0"), F.col("quality"))).alias("v"))


@query(f"SELECT round(sum(v), 6) AS v FROM ({_CELLS}) WHERE (i + j) % 3 = 0")
def indexed_reduce(spark, sf_dir):
    return rounded(reductions.reduce_indexed(embeddings(spark, sf_dir), lambda i, j: (i + j) % 3 == 0, reductions.SUM), 6)


@query("SELECT sum(pow(0.5::DOUBLE, i)) AS v FROM range(30) t(i)")
def index_reduce(spark, sf_dir):
    return reductions.reduce_index(spark, 30, E.powers(0.5), reductions.SUM)


@query(f"SELECT round(max(v), 9) AS f7 FROM ({_CELLS}) WHERE j = 7")
def reduce_column(spark, sf_dir):
    return rounded(reductions.reduce_columns(embeddings(spark, sf_dir), reductions.MAX, only=[7]), 9)


@query(f"SELECT i, round(sum(v), 8) AS v FROM ({_CELLS}) WHERE i = 5 GROUP BY i")
def reduce_row(spark, sf_dir):
    return rounded(spark.createDataFrame([(5, reductions.reduce_row(embeddings(spark, sf_dir), 5, reductions.SUM))], "i long, v double"), 8)


@query(f"SELECT round(sum(1 / (1 + exp(-v))), 5) AS s, bool_and(v < 2)::INTEGER::DOUBLE AS a FROM ({_CELLS})")
def map_then_reduce(spark, sf_dir):
    return rounded(reductions.reduce_many(embeddings(spark, sf_dir), s=(reductions.SUM, E.sigmoid), a=(reductions.AND, E.less(2))), 5)


@query("SELECT label AS idx FROM (SELECT label, count(*) AS cnt FROM embeddings GROUP BY label) ORDER BY cnt DESC, label LIMIT 1")
def biggest_bin(spark, sf_dir):
    return reductions.biggest_bin(table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("idx")).agg(F.count("*").alias("cnt")))


@query("SELECT n, CAST(n * (n + 1) / 2 AS BIGINT) AS triangular, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE (SELECT product(x)::DOUBLE FROM range(1, n + 1) r(x)) END AS factorial FROM (VALUES (0), (1), (5), (10), (20)) t(n)")
def triangular_and_factorial(spark, sf_dir):
    return spark.createDataFrame([(n, reductions.triangular(n), reductions.factorial(spark, n)) for n in (0, 1, 5, 10, 20)], "n int, triangular long, factorial double")


# --- search and selection ---


def _event_values(spark, sf_dir) -> Matrix:
    return Matrix.from_wide(table(spark, sf_dir, "events"), "event_id", ["value"])


@query("SELECT event_id AS idx FROM events WHERE value > 50")
def find(spark, sf_dir):
    return search.find(_event_values(spark, sf_dir), E.greater(50))


@query("SELECT event_id AS idx FROM events WHERE value > 20 ORDER BY event_id LIMIT 25")
def find_first_n(spark, sf_dir):
    return search.find_first(_event_values(spark, sf_dir), E.greater(20), 25)


@query("SELECT CAST(CASE WHEN count(*) > 0 THEN 0 ELSE -1 END AS INTEGER) AS col, coalesce(min(p_partkey), -1) AS row FROM part WHERE p_size = 17")
def index_of(spark, sf_dir):
    return search.index_of(Matrix.from_wide(table(spark, sf_dir, "part"), "p_partkey", ["p_size"]), 17)


@query("SELECT vec_id AS i, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS col FROM embeddings")
def argmax_rows(spark, sf_dir):
    return search.argmax_rows(embeddings(spark, sf_dir))


@query("SELECT vec_id AS i, round(embedding[4]::DOUBLE, 9) AS f0, round(embedding[1]::DOUBLE, 9) AS f1, round(embedding[4]::DOUBLE, 9) AS f2 FROM embeddings")
def column_subset(spark, sf_dir):
    return rounded(search.columns(embeddings(spark, sf_dir), [3, 0, 3]).to_wide().df, 9)


@query(f"WITH c AS ({_CELLS}), t(pos, i) AS (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) SELECT CAST(pos AS BIGINT) AS i, j, round(v, 9) AS v FROM c JOIN t USING (i)")
def row_gather(spark, sf_dir):
    return rounded(search.take_rows(embeddings(spark, sf_dir), [7, 3, 7, 0]).to_coo().df, 9)


@query(f"WITH c AS ({_CELLS}), t(pos, i) AS (VALUES (0, 9), (1, 2)) SELECT CAST(pos AS BIGINT) AS i, j - 10 AS j, round(v, 9) AS v FROM c JOIN t USING (i) WHERE j BETWEEN 10 AND 19")
def clipped_rows(spark, sf_dir):
    return rounded(search.take_rows(embeddings(spark, sf_dir), [9, 2], (10, 20)).to_coo().df, 9)


@query(f"SELECT i - 3 AS i, j - 5 AS j, round(v, 9) AS v FROM ({_CELLS}) WHERE i BETWEEN 3 AND 12 AND j BETWEEN 5 AND 11")
def submatrix(spark, sf_dir):
    return rounded(search.submatrix(embeddings(spark, sf_dir), 10, 7, 3, 5).to_coo().df, 9)


@query("SELECT p_partkey AS i, p_retailprice AS f0 FROM part")
def drop_first_column(spark, sf_dir):
    return search.drop_first(parts(spark, sf_dir)).df


@query("SELECT p_partkey AS i, p_size::DOUBLE AS f0 FROM part")
def drop_last_column(spark, sf_dir):
    return search.drop_last(parts(spark, sf_dir)).df


@query("SELECT round(embedding[3]::DOUBLE, 9) AS v FROM embeddings WHERE vec_id = 4")
def get_cell(spark, sf_dir):
    return rounded(spark.createDataFrame([(search.get(embeddings(spark, sf_dir), 4, 2),)], "v double"), 9)


@query(f"SELECT i, j, CASE WHEN i = 2 AND j = 3 THEN 99 ELSE round(v, 9) END AS v FROM ({_CELLS})")
def set_cell(spark, sf_dir):
    return rounded(search.put(embeddings(spark, sf_dir), 2, 3, 99).df, 9)


@query(f"WITH c AS ({_CELLS}) SELECT a.i, a.j, round(coalesce(b.v, a.v), 9) AS v FROM c a LEFT JOIN (VALUES (0, 5), (1, 6)) t(pos, i) ON a.i = t.pos LEFT JOIN c b ON b.i = t.i AND b.j = a.j")
def copy_rows(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    return rounded(search.copy_rows(x, x, [(0, 5), (1, 6)]).to_coo().df, 9)


@query("SELECT key::DOUBLE AS key, CAST((SELECT count(*) FROM range(1, 20, 2) o(x) WHERE x < key) AS BIGINT) AS at FROM (VALUES (0), (1), (2), (9), (11), (18), (20)) k(key)")
def insertion_points(spark, sf_dir):
    odds = spark.range(1, 20, 2).select(F.col("id").alias("v"))
    return search.insertion_points(odds, spark.createDataFrame([(float(k),) for k in (0, 1, 2, 9, 11, 18, 20)], "key double"))


# --- shape ---


@query(f"SELECT CAST(j AS BIGINT) AS i, CAST(i AS INTEGER) AS j, round(v, 9) AS v FROM ({_CELLS})")
def transpose(spark, sf_dir):
    return rounded(embeddings(spark, sf_dir).T.df, 9)


@query(f"SELECT CAST((i * 64 + j - 32) // 16 AS BIGINT) AS i, CAST((i * 64 + j - 32) % 16 AS INTEGER) AS j, round(v, 9) AS v FROM ({_CELLS}) WHERE i * 64 + j BETWEEN 32 AND 32 + 16 * 40 - 1")
def reshape(spark, sf_dir):
    return rounded(shape.reshape(embeddings(spark, sf_dir), 40, 16, 32).df, 9)


@query("SELECT p_partkey AS i, p_size::DOUBLE AS f0, p_retailprice AS f1, p_size::DOUBLE * 2 AS f2, p_retailprice * 2 AS f3 FROM part")
def right_concat(spark, sf_dir):
    x = parts(spark, sf_dir)
    return shape.right(x, x * 2).df


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::DOUBLE AS f0 FROM nation UNION ALL SELECT n_nationkey + (SELECT count(*) FROM nation), n_regionkey * 10.0::DOUBLE FROM nation")
def bottom_concat(spark, sf_dir):
    x = Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])
    return shape.below(x, x * 10).df


@query("SELECT 0::BIGINT AS i, CAST(n_nationkey AS INTEGER) AS j, n_regionkey::DOUBLE AS v FROM nation UNION ALL SELECT 0, 25 + r_regionkey, r_regionkey * 2.0::DOUBLE FROM region")
def concat(spark, sf_dir):
    a = Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])
    b = Matrix.from_wide(table(spark, sf_dir, "region").withColumn("v", F.col("r_regionkey") * 2), "r_regionkey", ["v"])
    return shape.concat([a, b]).df


@query("SELECT p_partkey AS i, 1.0::DOUBLE AS f0, p_size::DOUBLE AS f1, p_retailprice AS f2 FROM part")
def bias_column(spark, sf_dir):
    return shape.bias(parts(spark, sf_dir)).df


@query("SELECT n_nationkey + 25 * a AS i, CAST(b AS INTEGER) AS j, n_regionkey::DOUBLE AS v FROM nation, range(3) t(a), range(2) u(b)")
def tile(spark, sf_dir):
    return shape.tile(Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"]), 3, 2).df


@query("SELECT a.n_nationkey::BIGINT AS i, CAST(b.n_nationkey AS INTEGER) AS j, CASE WHEN a.n_nationkey = b.n_nationkey THEN a.n_regionkey::DOUBLE ELSE 0 END AS v FROM nation a, nation b")
def diagonal(spark, sf_dir):
    return shape.diagonal_from(Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"])).to_coo().df


@query("SELECT i, 0 AS j, CAST(i * 7 + i AS DOUBLE) AS v FROM range(7) t(i)")
def diagonal_vector(spark, sf_dir):
    return shape.diagonal_of(generators.sequence(spark, 7, 7)).df


@query("SELECT vec_id AS i, CAST(k AS INTEGER) AS j, CAST(label = k AS INTEGER)::DOUBLE AS v FROM embeddings, range(10) t(k)")
def one_hot(spark, sf_dir):
    return shape.one_hot(Matrix.from_wide(table(spark, sf_dir, "embeddings"), "vec_id", ["label"])).to_coo().df


def _sql_power(x: str, e: int) -> str:
    """The same multiplications in the same order as ``elementwise.int_power``."""
    out, base = "1.0::DOUBLE", x
    while e:
        if e & 1:
            out = f"({out} * {base})"
        base, e = f"({base} * {base})", e >> 1
    return out


_POLY = [(p - q, q) for p in range(1, 7) for q in range(p + 1)]


@query("SELECT p_partkey AS i, 1.0::DOUBLE AS f0, " + ", ".join(f"{_sql_power('a', p)} * {_sql_power('b', q)} AS f{k + 1}" for k, (p, q) in enumerate(_POLY)) + " FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS a, (p_retailprice - 950) / 50 AS b FROM part)")
def poly_features(spark, sf_dir):
    scaled = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("a"), ((F.col("p_retailprice") - 950) / 50).alias("b"))
    return shape.poly_features(Matrix.from_wide(scaled, "p_partkey", ["a", "b"]), 6).df


@query("SELECT i, j, CASE WHEN i BETWEEN 1 AND 2 AND j BETWEEN 1 AND 2 THEN 5.0::DOUBLE ELSE 0 END AS v FROM (SELECT i, CAST(j AS INTEGER) AS j FROM range(4) a(i), range(4) b(j))")
def overlay(spark, sf_dir):
    return shape.overlay(generators.zeros(spark, 4, 4), generators.constant(spark, 2, 2, 5), 1, 1).df


# --- sets ---

_FREQ = "SELECT '{0}' AS col, CAST({0} AS VARCHAR) AS value, count(*) AS cnt, (SELECT count(*) FROM lineitem) AS m, (SELECT count(DISTINCT {0}) FROM lineitem) AS depth FROM lineitem GROUP BY {0}"
_FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("SELECT col, value, CAST(cnt AS BIGINT) AS cnt, round(cnt / m::DOUBLE, 9) AS freq, round(-(cnt / m::DOUBLE) * log2(cnt / m::DOUBLE), 9) AS entropy, CAST(depth AS BIGINT) AS depth FROM (" + " UNION ALL ".join(_FREQ.format(c) for c in _FLAGS) + ")")
def attribute_frequencies(spark, sf_dir):
    return rounded(sets.frequencies(table(spark, sf_dir, "lineitem"), _FLAGS), 9)


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, round(entropy({c}), 8) AS entropy FROM lineitem" for c in _FLAGS))
def column_entropy(spark, sf_dir):
    return rounded(sets.column_entropy(table(spark, sf_dir, "lineitem"), _FLAGS), 8)


@query("SELECT DISTINCT v FROM (SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_discount FROM lineitem)")
def distinct_values(spark, sf_dir):
    return sets.distinct(Matrix.from_wide(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"]))


@query("SELECT count(DISTINCT p_retailprice) AS n FROM part")
def distinct_count(spark, sf_dir):
    return spark.createDataFrame([(sets.distinct_count(Matrix.from_wide(table(spark, sf_dir, "part"), "p_partkey", ["p_retailprice"])),)], "n long")


@query("SELECT p_brand AS v, count(*) AS cnt FROM part GROUP BY p_brand")
def counted_set(spark, sf_dir):
    return sets.counted(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT v, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT c_nationkey AS v FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY v")
def merge_counted(spark, sf_dir):
    return sets.merge_counted(sets.counted(table(spark, sf_dir, "customer"), "c_nationkey"), sets.counted(table(spark, sf_dir, "supplier"), "s_nationkey"))


@query("SELECT v, CAST(count(*) AS BIGINT) AS cnt FROM (SELECT s_nationkey AS v FROM supplier) GROUP BY v")
def counters(spark, sf_dir):
    a = sets.counters(table(spark, sf_dir, "supplier"), "s_nationkey")
    return sets.merge_counted(a, a.limit(0))


@query("SELECT c_nationkey AS v FROM customer UNION SELECT s_nationkey FROM supplier")
def set_merge(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("v"))
    return sets.merge_sorted(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("v")))


@query("SELECT v, side FROM (SELECT s_nationkey AS v, 0 AS side FROM supplier UNION ALL SELECT n_nationkey, 1 FROM nation)")
def merge_all(spark, sf_dir):
    return sets.merge_all(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("v")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("v")))


@query("SELECT event_type AS v, min(event_id) AS pos FROM events GROUP BY event_type")
def dedup_first(spark, sf_dir):
    return sets.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT s_suppkey AS v FROM supplier) SELECT round((SELECT count(*) FROM (SELECT v FROM a INTERSECT SELECT v FROM b)) / (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b))::DOUBLE, 9) AS jaccard")
def jaccard(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("v"))
    return rounded(sets.jaccard_of(a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v"))), 9)


@query("WITH u AS (SELECT user_id, list(DISTINCT event_type) FILTER (value > 20) AS a, list(DISTINCT event_type) FILTER (value <= 20) AS b FROM events GROUP BY user_id) SELECT user_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0)::DOUBLE, 9) AS jaccard FROM u")
def jaccard_by_row(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 20, F.col("event_type"))).alias("b"))
    return rounded(u.select("user_id", sets.jaccard(F.col("a"), F.col("b")).alias("jaccard")), 9)


@query("""WITH u AS (SELECT user_id, min(event_id) AS a0, max(event_id) AS a1 FROM events GROUP BY user_id), t AS (SELECT min(event_id) + 40 AS b0, max(event_id) - 60 AS b1 FROM events)
    SELECT user_id, CASE WHEN a0 <= b0 THEN CASE WHEN a1 <= b0 THEN 'a_before_b' WHEN a1 <= b1 THEN 'a_on_b' ELSE 'b_in_a' END
    WHEN a0 > b1 THEN 'b_before_a' WHEN b1 <= a1 THEN 'b_on_a' ELSE 'a_in_b' END AS relation FROM u, t""")
def interval_relation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.min("event_id").alias("a0"), F.max("event_id").alias("a1"))
    t = e.agg((F.min("event_id") + 40).alias("b0"), (F.max("event_id") - 60).alias("b1"))
    return u.join(F.broadcast(t), how="cross").select("user_id", sets.relation(*map(F.col, ("a0", "a1", "b0", "b1"))).alias("relation"))


@query("SELECT a::BIGINT AS v0, b::BIGINT AS v1, c::BIGINT AS v2 FROM range(2, 5) x(a), range(0, 3) y(b), range(7, 9) z(c)")
def range_permutations(spark, sf_dir):
    return sets.ranges(*(spark.range(a, b).select(F.col("id").alias("v")) for a, b in ((2, 5), (0, 3), (7, 9))))


@query("SELECT CAST(least(greatest(floor((p_retailprice - 900) / 10), 0), 9) AS INTEGER) AS bin, count(*) AS cnt FROM part GROUP BY 1")
def histogram(spark, sf_dir):
    return sets.histogram(table(spark, sf_dir, "part"), "p_retailprice", 900, 1000, 10)


# --- linear algebra ---


@query(f"WITH c AS ({_CELLS}) SELECT a.i, CAST(b.k AS INTEGER) AS j, round(sum(a.v * sin(a.j * 3 + b.k + 1.0::DOUBLE)), 7) + 0.0 AS v FROM c a, range(3) b(k) GROUP BY a.i, b.k")
def matrix_product(spark, sf_dir):
    b = np.sin(np.arange(1, DIM * 3 + 1, dtype=float)).reshape(DIM, 3)
    return rounded(linalg.product_local(embeddings(spark, sf_dir), b).to_coo().df, 7)


@query(f"WITH c AS ({_CELLS}) SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM c a JOIN c b USING (i) GROUP BY a.j, b.j")
def gram_by_cells(spark, sf_dir):
    x = embeddings(spark, sf_dir).to_coo()
    xt = Matrix(x.df.select(F.col("j").cast("long").alias("i"), F.col("i").cast("int").alias("j"), "v"), "coo", DIM)
    return rounded(linalg.product_cells(xt, x).df, 5)


@query(f"WITH c AS ({_CELLS}) SELECT CAST(a.j AS BIGINT) AS i, b.j, round(sum(a.v * b.v), 5) + 0.0 AS v FROM c a JOIN c b USING (i) GROUP BY a.j, b.j")
def gram(spark, sf_dir):
    return rounded(Matrix.from_numpy(spark, linalg.gram(embeddings(spark, sf_dir))).to_coo().df, 5)


@query("SELECT p_partkey AS i, round(p_size - a, 6) AS f0, round(p_retailprice - b, 6) AS f1 FROM part, (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part)")
def sub_means(spark, sf_dir):
    x = parts(spark, sf_dir)
    return rounded(linalg.center(x, list(reductions.means(x).first())).df, 6)


@query("SELECT p_partkey AS i, round((p_size - a) * (p_size - a), 4) AS f0, round((p_retailprice - b) * (p_retailprice - b), 4) AS f1 FROM part, (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM part)")
def sqr_sub_means(spark, sf_dir):
    x = parts(spark, sf_dir)
    return rounded(linalg.sqr_center(x, list(reductions.means(x).first())).df, 4)


@query("""WITH s AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, sqrt((var_pop(p_size) + var_pop(p_retailprice)) * count(*) / (count(*) * 2 - 1)) AS s FROM part)
    SELECT p_partkey AS i, round((p_size - a) / s, 7) AS f0, round((p_retailprice - b) / s, 7) AS f1 FROM part, s""")
def normalize(spark, sf_dir):
    return rounded(linalg.normalize(parts(spark, sf_dir)).df, 7)


@query("SELECT p_partkey AS i, round((p_size - a) / sa, 7) AS f0, round((p_retailprice - b) / sb, 7) AS f1 FROM part, (SELECT avg(p_size) AS a, stddev_pop(p_size) AS sa, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS sb FROM part)")
def z_scores(spark, sf_dir):
    return rounded(linalg.z_scores(parts(spark, sf_dir)).df, 7)


@query("SELECT 0::BIGINT AS i, round(covar_pop(p_size, p_size), 5) AS f0, round(covar_pop(p_size, p_retailprice), 5) AS f1 FROM part UNION ALL SELECT 1, round(covar_pop(p_retailprice, p_size), 5), round(covar_pop(p_retailprice, p_retailprice), 5) FROM part")
def covariance(spark, sf_dir):
    return rounded(Matrix.from_numpy(spark, linalg.covariance(parts(spark, sf_dir))).to_wide().df, 5)


_M5 = [5, 0, 2, 3, 4, 5, 4, 0, 2, 4, 2, 3, 4, 0, 5, 1, 2, -4, 3, 5, 2, 0, 2, 0, 4]


@query("SELECT 1050.0::DOUBLE AS det, 1050.0::DOUBLE AS by_cofactors, 0.0::DOUBLE AS off_identity")
def determinant_and_inverse(spark, sf_dir):
    a = np.array(_M5, float).reshape(5, 5)
    off = float(np.abs(linalg.inverse(a) @ a - np.eye(5)).max())
    by = float(a[0] @ linalg.cofactor_matrix(a)[0])
    return rounded(spark.createDataFrame([(linalg.determinant(a), by, off)], "det double, by_cofactors double, off_identity double"), 6)


@query(f"WITH c AS (SELECT i, j, v FROM ({_CELLS}) WHERE i < 3 AND j < 3), g AS (SELECT " + ", ".join(f"max(v) FILTER (i = {i} AND j = {j}) AS a{i}{j}" for i in range(3) for j in range(3)) + " FROM c) SELECT round(a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20), 9) AS det FROM g")
def det_3x3(spark, sf_dir):
    return rounded(linalg.determinant_3x3(search.submatrix(embeddings(spark, sf_dir), 3, 3, 0, 0)), 9)


@query("SELECT CAST(i AS BIGINT) AS i, x::DOUBLE AS x FROM (VALUES (0, 1), (1, -2), (2, 3), (3, 0), (4, 5)) t(i, x)")
def lu_solve(spark, sf_dir):
    a, x = np.array(_M5, float).reshape(5, 5), np.array([1, -2, 3, 0, 5.0])
    return rounded(spark.createDataFrame(list(enumerate(map(float, linalg.LU(a).solve(a @ x)))), "i long, x double"), 9)


@query(f"SELECT round(sum(var), 7) AS total, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS off_unit, true AS falling FROM (SELECT var_pop(v) AS var FROM ({_CELLS}) GROUP BY j)")
def principal_components(spark, sf_dir):
    """All variances add up to those of the columns; C v = lambda v, the directions are orthonormal and the variances fall."""
    x = embeddings(spark, sf_dir)
    values, vectors = linalg.principal_components(x, DIM)
    c = linalg.covariance(x)
    checks = (float(values.sum()), float(np.abs(c @ vectors - vectors * values).max()), float(np.abs(vectors.T @ vectors - np.eye(DIM)).max()), bool((np.diff(values) <= 0).all()))
    return rounded(spark.createDataFrame([checks], "total double, residual double, off_unit double, falling boolean"), 7)


# --- Gaussian anomalies ---

_DENSE = "1 / sqrt(2 * pi()) / sqrt({v}) * exp(-({x} - {m}) * ({x} - {m}) / (2 * {v}))"
_PART = "(SELECT avg(p_size) AS m0, var_pop(p_size) AS v0, avg(p_retailprice) AS m1, var_pop(p_retailprice) AS v1 FROM part)"
_D0, _D1 = _DENSE.format(x="p_size", m="m0", v="v0"), _DENSE.format(x="p_retailprice", m="m1", v="v1")


@query(f"SELECT p_partkey AS i, round({_D0}, 9) AS f0, round({_D1}, 9) AS f1 FROM part, {_PART}")
def gaussian_features(spark, sf_dir):
    return rounded(anomaly.feature_densities(parts(spark, sf_dir)).df, 9)


@query(f"SELECT p_partkey AS i, round(({_D0}) * ({_D1}), 10) AS p FROM part, {_PART}")
def gaussian_vector(spark, sf_dir):
    return rounded(anomaly.row_densities(parts(spark, sf_dir)), 10)


@query("""WITH s AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b, var_pop(p_size) AS va, var_pop(p_retailprice) AS vb, covar_pop(p_size, p_retailprice) AS c FROM part)
    SELECT p_partkey AS i, round(1 / (2 * pi() * sqrt(va * vb - c * c)) * exp(-((p_size - a) * (p_size - a) * vb - 2 * (p_size - a) * (p_retailprice - b) * c + (p_retailprice - b) * (p_retailprice - b) * va) / (2 * (va * vb - c * c))), 10) AS p FROM part, s""")
def mv_gaussian(spark, sf_dir):
    x = parts(spark, sf_dir)
    return rounded(anomaly.multivariate(x, np.array(reductions.means(x).first()), linalg.covariance(x)), 10)


def _scores(spark, sf_dir) -> DataFrame:
    """Documents with a label: the density of the length as score, junk as the anomaly."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("n_chars") / 100.0).alias("p"), (1 - F.col("quality")).alias("y"))


_THRESHOLDS = """WITH s AS (SELECT n_chars / 100.0::DOUBLE AS p, 1 - quality AS y FROM labels JOIN documents USING (doc_id)), e AS (SELECT min(p) AS low, max(p) AS high FROM s),
    g AS (SELECT CAST(k AS INTEGER) AS step, low + k * ((high - low) / 200.0::DOUBLE) AS eps FROM range(1, 201) t(k), e),
    c AS (SELECT step, eps, CAST(count(*) FILTER (y = 1 AND p < eps) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND p < eps) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 1 AND p >= eps) AS BIGINT) AS fn FROM g, s GROUP BY step, eps),
    f AS (SELECT *, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1 FROM c)"""


@query(_THRESHOLDS + " SELECT step, round(eps, 6) AS eps, tp, fp, fn, round(f1, 9) AS f1 FROM f")
def threshold_scores(spark, sf_dir):
    return rounded(anomaly.threshold_scores(_scores(spark, sf_dir), 200), {"eps": 6, "f1": 9})


@query(_THRESHOLDS + " SELECT round(eps, 6) AS eps, round(f1, 9) AS f1 FROM f WHERE f1 IS NOT NULL ORDER BY f.f1 DESC, f.eps LIMIT 1")
def select_threshold(spark, sf_dir):
    return rounded(anomaly.select_threshold(_scores(spark, sf_dir), 200), {"eps": 6, "f1": 9})


# --- k-means ---


def _first_centroids(spark, sf_dir, k: int = 5) -> np.ndarray:
    x = embeddings(spark, sf_dir)
    return Matrix(x.df.where(F.col("i") < k), "vec", DIM).to_local()


_KM = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), c AS (SELECT vec_id AS k, x AS c FROM e WHERE vec_id < 5),
    d AS (SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, c),
    a AS (SELECT vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, struct_pack(d := d, k := k)) AS cluster FROM d GROUP BY vec_id)"""


@query(_KM + " SELECT vec_id AS i, CAST(cluster AS INTEGER) AS cluster, round(d, 7) AS dist2 FROM a")
def kmeans_assign(spark, sf_dir):
    return rounded(kmeans.assign(embeddings(spark, sf_dir), _first_centroids(spark, sf_dir)).drop("x"), 7)


@query(_KM + " SELECT CAST(cluster AS BIGINT) AS i, CAST(j AS INTEGER) AS j, round(avg(x[j + 1]), 7) + 0.0 AS v FROM a, range(64) t(j) GROUP BY cluster, j")
def kmeans_update(spark, sf_dir):
    c = _first_centroids(spark, sf_dir)
    return rounded(Matrix.from_numpy(spark, kmeans.update(kmeans.assign(embeddings(spark, sf_dir), c), c)).to_coo().df, 7)


@query(_KM + " SELECT round(avg(d), 7) AS distortion FROM a")
def kmeans_distortion(spark, sf_dir):
    return rounded(kmeans.distortion(kmeans.assign(embeddings(spark, sf_dir), _first_centroids(spark, sf_dir))), 7)


def _km_steps(steps: int) -> str:
    """SQL for so many steps: centroids c0, c1, .. and the last assignment a."""
    near = "SELECT vec_id, any_value(x) AS x, min(d) AS d, arg_min(k, struct_pack(d := d, k := k)) AS cluster FROM (SELECT vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, {c}) GROUP BY vec_id"
    out = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), c0 AS MATERIALIZED (SELECT vec_id AS k, x AS c FROM e WHERE vec_id < 5)"
    for n in range(steps):
        out += f", a{n} AS MATERIALIZED ({near.format(c=f'c{n}')}), m{n} AS (SELECT cluster, j, avg(x[j + 1]) AS v FROM a{n}, range(64) t(j) GROUP BY cluster, j)"
        out += f", c{n + 1} AS MATERIALIZED (SELECT k, coalesce(any_value(n), any_value(c)) AS c FROM c{n} LEFT JOIN (SELECT cluster, list(v ORDER BY j) AS n FROM m{n} GROUP BY cluster) ON cluster = k GROUP BY k)"
    return out + f", a AS ({near.format(c=f'c{steps}')})"


@query(_km_steps(8) + " SELECT vec_id AS i, CAST(cluster AS INTEGER) AS cluster, round(d, 6) AS dist2 FROM a")
def kmeans_fit(spark, sf_dir):
    x = embeddings(spark, sf_dir)
    c, _ = kmeans.fit(x, _first_centroids(spark, sf_dir), eps=-1, most=8)
    return rounded(kmeans.assign(x, c).select("i", "cluster", "dist2"), 6)


# --- regression ---


def _price_data(spark, sf_dir) -> DataFrame:
    scaled = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 1e5).alias("p"))
    return regression.design(scaled, ["q", "d"], "p")


_LIN = "(SELECT 1.0::DOUBLE AS f0, l_quantity / 50 AS f1, l_discount * 10 AS f2, l_extendedprice / 1e5 AS y FROM lineitem)"


@query(f"""WITH r AS (SELECT *, 0.1 * f0 + 0.2 * f1 - 0.3 * f2 - y AS r FROM {_LIN}) SELECT round(sum(r * r) / (2 * count(*)) + 2.0 / (2 * count(*)) * (0.2 * 0.2 + 0.3 * 0.3), 8) AS cost,
    round(sum(r * f0) / count(*), 8) AS g0, round(sum(r * f1) / count(*) + 2.0 * 0.2 / count(*), 8) AS g1, round(sum(r * f2) / count(*) - 2.0 * 0.3 / count(*), 8) AS g2 FROM r""")
def linreg_cost_grad(spark, sf_dir):
    cost, g = regression.linear_cost_grad(_price_data(spark, sf_dir), np.array([0.1, 0.2, -0.3]), 2.0)
    return rounded(spark.createDataFrame([(float(cost), *map(float, g))], "cost double, g0 double, g1 double, g2 double"), 8)


@query(f"""WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS m, sum(f1) AS s01, sum(f2) AS s02, sum(f1 * f1) AS s11, sum(f1 * f2) AS s12, sum(f2 * f2) AS s22, sum(y) AS y0, sum(f1 * y) AS y1, sum(f2 * y) AS y2 FROM {_LIN}),
    g AS (SELECT 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c UNION ALL SELECT step + 1, a - 0.5::DOUBLE * (m * a + s01 * b + s02 * c - y0) / m, b - 0.5::DOUBLE * (s01 * a + s11 * b + s12 * c - y1) / m, c - 0.5::DOUBLE * (s02 * a + s12 * b + s22 * c - y2) / m FROM g, s WHERE step < 20)
    SELECT round(a, 8) AS t0, round(b, 8) AS t1, round(c, 8) AS t2 FROM g WHERE step = 20""")
def linreg_descent(spark, sf_dir):
    theta = regression.linear_descent(_price_data(spark, sf_dir), np.zeros(3), 0.5, 20)
    return rounded(spark.createDataFrame([tuple(map(float, theta))], "t0 double, t1 double, t2 double"), 8)


@query("SELECT round(regr_intercept(y, x), 8) AS t0, round(regr_slope(y, x), 8) AS t1 FROM (SELECT l_extendedprice / 1e5 AS y, l_quantity / 50 AS x FROM lineitem)")
def linreg_exact(spark, sf_dir):
    theta = regression.linear_solve(_price_data(spark, sf_dir).drop("f2"), 2)
    return rounded(spark.createDataFrame([tuple(map(float, theta))], "t0 double, t1 double"), 8)


def _quality_data(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return regression.design(docs.select((F.log(F.col("n_chars") + 1) / 10).alias("n"), "toxic", "quality"), ["n", "toxic"], "quality")


_LOG = "(SELECT 1.0::DOUBLE AS f0, ln(n_chars + 1) / 10 AS f1, toxic::DOUBLE AS f2, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id))"
_H = "1 / (1 + exp(-(0.5 * f0 + 1.0 * f1 - 0.25 * f2)))"


@query(f"""WITH h AS (SELECT *, ({_H})::DOUBLE AS h FROM {_LOG}) SELECT round(-avg(y * ln(h) + (1 - y) * ln(1 - h)) + 3.0 / (2 * count(*)) * (1 + 0.0625), 8) AS cost,
    round(sum((h - y) * f0) / count(*), 8) AS g0, round(sum((h - y) * f1) / count(*) + 3.0 / count(*), 8) AS g1, round(sum((h - y) * f2) / count(*) - 3.0 * 0.25 / count(*), 8) AS g2 FROM h""")
def logreg_cost_grad(spark, sf_dir):
    cost, g = regression.logistic_cost_grad(_quality_data(spark, sf_dir), np.array([0.5, 1.0, -0.25]), 3.0)
    return rounded(spark.createDataFrame([(float(cost), *map(float, g))], "cost double, g0 double, g1 double, g2 double"), 8)


@query(f"WITH h AS (SELECT y, ({_H})::DOUBLE AS h FROM {_LOG}) SELECT CAST(count(*) FILTER ((h >= 0.5 AND y = 0) OR (h < 0.5 AND y = 1)) AS BIGINT) AS wrong, round(100 * avg(CASE WHEN (h >= 0.5) = (y = 1) THEN 1 ELSE 0 END), 8) AS accuracy FROM h")
def logreg_predict(spark, sf_dir):
    p = regression.logistic_predict(_quality_data(spark, sf_dir), np.array([0.5, 1.0, -0.25]))
    return rounded(regression.misclassified(p).join(regression.accuracy(p), how="cross"), 8)


@query("SELECT 0.0::DOUBLE AS slope, true AS falling")
def logreg_fit(spark, sf_dir):
    """At the end the gradient is 0 (the cost is convex, so this is the minimum), and no step raised the cost."""
    data = _quality_data(spark, sf_dir)
    theta, costs = regression.logistic_fit(data, 3, 1.0, 60)
    _, grad = regression.logistic_cost_grad(data, theta, 1.0)
    return rounded(spark.createDataFrame([(float(np.abs(grad).max()), bool((np.diff(costs) <= 0).all()))], "slope double, falling boolean"), 4)


# --- networks ---


def _net_data(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") + 1).alias("y"))


def _sin_layer(inputs: int, outputs: int) -> str:
    """SQL for the weights of ``neural.sin_weights``: output o, input k (0: bias) is sin(k * outputs + o + 1) / 10."""
    return f"SELECT o, k, sin(k * {outputs} + o + 1.0::DOUBLE) / 10 AS w FROM range({outputs}) a(o), range({inputs + 1}) b(k)"


_SIZES = [DIM, 8, 10]
_NET = f"""WITH w1 AS ({_sin_layer(DIM, 8)}), w2 AS ({_sin_layer(8, 10)}),
    x AS (SELECT vec_id, 0 AS k, 1.0::DOUBLE AS v FROM embeddings UNION ALL SELECT vec_id, k, embedding[k]::DOUBLE FROM embeddings, range(1, 65) t(k)),
    a AS (SELECT vec_id, o + 1 AS k, 1 / (1 + exp(-sum(v * w))) AS v FROM x JOIN w1 USING (k) GROUP BY vec_id, o),
    h AS (SELECT vec_id, o, 1 / (1 + exp(-sum(v * w))) AS v FROM (SELECT * FROM a UNION ALL SELECT vec_id, 0, 1.0::DOUBLE FROM embeddings) JOIN w2 USING (k) GROUP BY vec_id, o)"""


@query(_NET + " SELECT vec_id, round(max(v) FILTER (o = 0), 9) AS h0, round(max(v) FILTER (o = 5), 9) AS h5, round(max(v) FILTER (o = 9), 9) AS h9, CAST(arg_max(o, v) + 1 AS INTEGER) AS label FROM h GROUP BY vec_id")
def nn_predict(spark, sf_dir):
    p = neural.predict(_net_data(spark, sf_dir), neural.sin_weights(_SIZES))
    return rounded(p.select("vec_id", *(F.get("h", F.lit(k)).alias(f"h{k}") for k in (0, 5, 9)), "label"), 9)


@query(_NET + """ SELECT round(-sum(CASE WHEN label = o THEN ln(v) ELSE ln(1 - v) END) / (SELECT count(*) FROM embeddings)
    + (SELECT sum(w * w) FROM (SELECT w FROM w1 WHERE k > 0 UNION ALL SELECT w FROM w2 WHERE k > 0)) * 3.0 / (2 * (SELECT count(*) FROM embeddings)), 8) AS cost FROM h JOIN embeddings USING (vec_id)""")
def nn_cost(spark, sf_dir):
    c = neural.cost(_net_data(spark, sf_dir), neural.sin_weights(_SIZES), 3.0)
    return rounded(spark.createDataFrame([(float(c),)], "cost double"), 8)


@query(_NET + """ SELECT round(-sum(CASE WHEN label = o THEN ln(v) ELSE ln(1 - v) END) / (SELECT count(*) FROM embeddings)
    + (SELECT sum(w * w) FROM (SELECT w FROM w1 WHERE k > 0 UNION ALL SELECT w FROM w2 WHERE k > 0)) * 0.1 / (2 * (SELECT count(*) FROM embeddings)), 7) AS first_cost, true AS falling, true AS lower FROM h JOIN embeddings USING (vec_id)""")
def nn_train(spark, sf_dir):
    """The cost begins where the weights put it, no iteration raises it, and it ends lower by a tenth at least."""
    _, costs = neural.train(_net_data(spark, sf_dir), neural.sin_weights(_SIZES), 0.1, 8)
    return rounded(spark.createDataFrame([(float(costs[0]), bool((np.diff(costs) <= 0).all()), bool(costs[-1] < 0.9 * costs[0]))], "first_cost double, falling boolean, lower boolean"), 7)


# --- splits ---

_HASH = """SELECT doc_id, (((a % 65536) * 32749 + (a // 65536) * 40503 + a) % 2147483647) AS h FROM (SELECT doc_id, ((doc_id % 2147483647) * 48271 + 7) % 2147483647 AS a FROM documents)"""


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY h, doc_id) - 1 AS BIGINT) AS rank FROM ({_HASH})")
def shuffled(spark, sf_dir):
    return split.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7).select("doc_id", "rank")


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS r, count(*) OVER () AS m FROM ({_HASH})) SELECT doc_id FROM r WHERE r < floor(m * 0.25 + 0.5)")
def shuffle_split(spark, sf_dir):
    return split.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25, 7)[0]


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) - 1 AS r, count(*) OVER () AS m FROM ({_HASH})), t AS (SELECT *, floor(m * 0.7::DOUBLE + 0.5) AS a FROM r), u AS (SELECT *, a + floor((m - a) * least(1.0::DOUBLE, 0.15::DOUBLE * m / (m - a)) + 0.5) AS b FROM t)
    SELECT doc_id, CASE WHEN r < a THEN 'train' WHEN r < b THEN 'validation' ELSE 'test' END AS part FROM u""")
def validation_sets(spark, sf_dir):
    return split.validation_sets(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=7).select("doc_id", "part")


# --- generated matrices ---


def _grid(expr: str, m: int = 20, n: int = 15, places: int | None = 9) -> str:
    v = f"({expr})::DOUBLE" if places is None else f"round(({expr})::DOUBLE, {places}) + 0.0"
    return f"SELECT CAST(id // {n} AS BIGINT) AS i, CAST(id % {n} AS INTEGER) AS j, {v} AS v FROM range({m * n}) t(id)"


def _fill(name: str, make: Callable[[SparkSession], Matrix], expr: str, **grid) -> None:
    QUERIES[f"fill_{name}"] = lambda spark, sf_dir: rounded(make(spark).to_coo().df.select("i", "j", "v"), 9)
    ORACLE_SQL[f"fill_{name}"] = _grid(expr, **grid)


_fill("const", lambda s: generators.constant(s, 20, 15, 2.5), "2.5")
_fill("zeros", lambda s: generators.zeros(s, 20, 15), "0")
_fill("ones", lambda s: generators.ones(s, 20, 15), "1")
_fill("seq", lambda s: generators.sequence(s, 20, 15, 3, 0.5), "3 + id * 0.5")
_fill("seq_mod", lambda s: generators.sequence_mod(s, 20, 15, 2, 7), "(id + 2) % 7")
_fill("span", lambda s: generators.span(s, 20, 15, 1, 4), "1 + id * 3.0::DOUBLE / 300")
_fill("span_mod", lambda s: generators.span_mod(s, 20, 15, 1, 4, 25), "1 + (3.0::DOUBLE / 25) * (id % 25)")
_fill("inc_cols", lambda s: generators.increasing_columns(s, 20, 15, 4), "4 + id % 15")
_fill("inc_rows", lambda s: generators.increasing_rows(s, 20, 15, 4), "4 + id // 15")
_fill("evens", lambda s: generators.evens(s, 20, 15, 3), "2 * id + 4")
_fill("odds", lambda s: generators.odds(s, 20, 15, 2), "2 * id + 3")
_fill("sin", lambda s: generators.sin(s, 20, 15, 2, 0.5), "2 * sin((id % 15) * 20 + id // 15 + 0.5::DOUBLE)")
_fill("sin_wave", lambda s: generators.sin_wave(s, 20, 15, 2, 30, 3), "2 * sin(2 * pi() * (id - 3) / 30)")
_fill("cos_wave", lambda s: generators.cos_wave(s, 20, 15, 2, 30, 3), "2 * cos(2 * pi() * (id + 3) / 30)")
_fill("diagonal", lambda s: generators.diagonal(s, 12, 3), "CASE WHEN id // 12 = id % 12 THEN 3 ELSE 0 END", m=12, n=12)
_fill("identity", lambda s: generators.identity(s, 12), "CASE WHEN id // 12 = id % 12 THEN 1 ELSE 0 END", m=12, n=12)
_fill("pow", lambda s: generators.powers(s, 4, 5, 1.5), "pow(1.5::DOUBLE, id)", m=4, n=5)
_fill("one_over", lambda s: generators.one_over_index(s, 20, 15), "CASE WHEN id = 0 THEN 0 ELSE 1 / id::DOUBLE END")
_fill("step", lambda s: generators.step_index(s, 20, 15), "1 / (1 + id::DOUBLE)")
_fill("scalar", lambda s: generators.from_scalar(s, 8), "8", m=1, n=1)
_fill("freeform", lambda s: generators.freeform(s, 3, [0, 1, 4, 9, 16, 25]), "id * id", m=2, n=3)
_fill("extrude", lambda s: generators.extrude(generators.sequence(s, 1, 5, 1, 2), 3), "1 + 2 * (id % 5)", m=4, n=5)


def _sql_hash(key: str, seed: int) -> str:
    """The same arithmetic as ``split.integer_hash``."""
    a = f"((({key}) % 2147483647) * 48271 + {seed}) % 2147483647"
    return f"((({a}) % 65536) * 32749 + (({a}) // 65536) * 40503 + ({a})) % 2147483647"


_RAND = f"(2 * ((({_sql_hash(_sql_hash('id', 1234), 1234)})::DOUBLE + 0.5) / 2147483647.0::DOUBLE) - 1)"


@query(_grid(f"{_RAND} * 0.5", 50, 20))
def fill_rand_sym(spark, sf_dir):
    return rounded(generators.rand_sym(spark, 50, 20, 0.5).df, 9)


@query(_grid(f"CAST(trunc({_RAND} * 100) AS BIGINT) % 7", 50, 20))
def fill_rand_mod(spark, sf_dir):
    return rounded(generators.rand_mod(spark, 50, 20, 7, 100).df, 9)


# --- numbers ---


@query("""WITH p AS (SELECT x FROM range(2, 400) a(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 20) b(d) WHERE d < x AND x % d = 0)), v AS (SELECT range AS v FROM range(0, 400))
    SELECT v, CASE WHEN v < 4 THEN v ELSE min(x) END AS smallest_factor, CASE WHEN v < 4 THEN v ELSE max(x) END AS largest_factor, v > 1 AND (v < 4 OR max(x) = v) AS is_prime FROM v LEFT JOIN p ON x <= v AND v % x = 0 GROUP BY v""")
def prime_factors(spark, sf_dir):
    return numbers.prime_factors(spark.range(400).select(F.col("id").alias("v")), "v")


@query("""WITH p AS (SELECT x FROM range(2, 400) a(x) WHERE NOT EXISTS (SELECT 1 FROM range(2, 20) b(d) WHERE d < x AND x % d = 0)), v AS (SELECT a, b FROM range(1, 60) s(a), range(1, 60) t(b))
    SELECT a, b, min(x) AS smallest_common, max(x) AS largest_common FROM v LEFT JOIN p ON a % x = 0 AND b % x = 0 GROUP BY a, b""")
def common_factors(spark, sf_dir):
    v = spark.range(59 * 59).select((F.floor(F.col("id") / 59) + 1).alias("a"), (F.col("id") % 59 + 1).alias("b"))
    return numbers.common_factors(v, "a", "b")


@query("SELECT v, CAST(bit_count(v) AS INTEGER) AS bits, v > 0 AND (v & (v - 1)) = 0 AS is_pow2, CASE WHEN v <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(v))) AS BIGINT) END AS next_pow2, v % 7 AS mod7, CAST(v * v * v AS BIGINT) AS cube FROM (SELECT range AS v FROM range(0, 300))")
def integer_functions(spark, sf_dir):
    v = F.col("v")
    return spark.range(300).select(F.col("id").alias("v")).select("v", numbers.bit_count(v).cast("int").alias("bits"), numbers.is_power_of_two(v).alias("is_pow2"), numbers.next_power_of_two(v).alias("next_pow2"), numbers.modulus(v, F.lit(7)).alias("mod7"), E.cube(v).alias("cube"))


@query("SELECT round(root, 6) AS root FROM (VALUES (1 - sqrt(12.5)), (1 + sqrt(12.5))) t(root)")
def bisection_roots(spark, sf_dir):
    return rounded(numbers.roots(spark, E.poly2, -10, 10), 6)


@query("SELECT p_partkey, round(2 * x - 2, 5) + 0.0 AS g, 0.01 > 25 - x * x - p_size / 10.0 * p_size / 10.0 AS outside FROM (SELECT p_partkey, p_size, (p_retailprice - 950) / 10 AS x FROM part)")
def gradient_and_circle(spark, sf_dir):
    x = (F.col("p_retailprice") - 950) / 10
    return rounded(table(spark, sf_dir, "part").select("p_partkey", numbers.gradient(E.poly2, x).alias("g"), numbers.outside_circle(x, F.col("p_size") / 10.0, 0, 0, 5, 0.1).alias("outside")), 5)


@query("""SELECT vec_id, round(w * w - x * x - y * y - z * z, 9) + 0.0 AS sw, round(2 * w * x, 9) + 0.0 AS sx, round(2 * w * y, 9) + 0.0 AS sy, round(2 * w * z, 9) + 0.0 AS sz, round(w * w + x * x + y * y + z * z, 9) AS norm, 1.0::DOUBLE AS unit,
    0.0::DOUBLE AS self_cross FROM (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings)""")
def quaternions(spark, sf_dir):
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    q = numbers.quaternion(*(at(k) for k in range(4)))
    square, one = numbers.q_mul(q, q), numbers.q_mul(q, numbers.q_inverse(q))
    cross = numbers.cross3([at(1), at(2), at(3)], [at(1), at(2), at(3)])
    out = table(spark, sf_dir, "embeddings").select("vec_id", *(square[c].alias(f"s{c}") for c in "wxyz"), numbers.q_norm(q).alias("norm"), one["w"].alias("unit"), (cross[0] + cross[1] + cross[2]).alias("self_cross"))
    return rounded(out, 9)


# --- sources and streams ---


@query("SELECT n_nationkey::BIGINT AS i, 0 AS j, n_regionkey::DOUBLE AS v FROM nation")
def octave_round_trip(spark, sf_dir):
    path = fresh(spark, "octave")
    files.write_octave(Matrix.from_wide(table(spark, sf_dir, "nation"), "n_nationkey", ["n_regionkey"]), "regions", path)
    return files.read_octave(spark, path)["regions"].df


@query("SELECT p_partkey AS i, p_size::DOUBLE AS f0, p_retailprice AS f1 FROM part")
def table_round_trip(spark, sf_dir):
    path = fresh(spark, "matrix")
    files.write_table(parts(spark, sf_dir), path)
    return files.read_table(spark, path, 2).to_wide().df


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 8) AS mean, round(var_pop(value), 6) AS var FROM events GROUP BY 1, 2")
def windowed_moments(spark, sf_dir):
    out = moments.windowed_moments(table(spark, sf_dir, "events"), "ts", "value", "event_type")
    return rounded(out.select("start", "event_type", "n", "mean", "var"), {"mean": 8, "var": 6})


from gridloom import catalog_more  # noqa: E402, F401  registers its queries here
