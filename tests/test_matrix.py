from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import elementwise as E
from gridloom.operators import linalg, reductions, search, sets, shape, split
from gridloom.plans.matrix import Matrix
from gridloom.sources import generators

M5 = np.array([[5, 0, 2, 3, 4], [5, 4, 0, 2, 4], [2, 3, 4, 0, 5], [1, 2, -4, 3, 5], [2, 0, 2, 0, 4]], float)


@pytest.fixture(scope="module")
def a(spark):
    return Matrix.from_numpy(spark, np.arange(12.0).reshape(4, 3) - 3)


def test_layouts_agree(a):
    want = np.arange(12.0).reshape(4, 3) - 3
    for x in (a, a.to_coo(), a.to_wide(), a.to_coo().to_vec(), a.to_coo().to_wide(), a.to_wide().to_coo()):
        assert (x.to_local() == want).all()


def test_shape_of(a):
    assert a.dims == (4, 3) and a.length == 12 and a.long_axis == 4 and a.size_bytes == 96 and a.aspect == 4 / 3
    assert not (a.is_square or a.is_vector or a.is_scalar or a.is_empty) and a.contains(3, 2) and not a.contains(4, 0)


def test_operators(a):
    v = a.to_local()
    assert ((a * 2 + a).to_local() == 3 * v).all()
    assert ((a - a).to_local() == 0).all()
    assert ((1 - a).to_local() == 1 - v).all()
    assert ((a**2).to_local() == v**2).all()
    assert ((-a).to_local() == -v).all()
    assert ((a > 2).to_local() == (v > 2)).all() and ((a <= 2).to_local() == (v <= 2)).all()
    assert ((a & a).to_local() == (v != 0)).all()
    assert (12 / a).to_local()[1, 0] == 0  # one over zero is zero here
    with np.errstate(all="ignore"):
        assert np.isnan((a / a).to_local()[1, 0])


def test_incompatible(spark, a):
    with pytest.raises(errors.IncompatibleShapes):
        a + generators.ones(spark, 4, 4)
    with pytest.raises(errors.IncompatibleShapes):
        linalg.product(a, a)
    row, col = generators.sequence(spark, 1, 4), generators.sequence(spark, 4, 1)
    assert ((row + col).to_local() == [[0, 2, 4, 6]]).all()


def test_closed_form_sums(spark):
    assert reductions.total(generators.ones(spark, 200, 200)) == 40000
    assert reductions.total(generators.ones(spark, 200, 200) * 5) == 200000
    assert reductions.total(generators.ones(spark, 199, 201)) == 39999
    assert reductions.total(generators.ones(spark, 199, 201) * 5) == 199995
    rows = reductions.row_sums(generators.increasing_columns(spark, 50, 64)).select("v").distinct().collect()
    assert [r["v"] for r in rows] == [2016]


def test_truth_table(spark):
    x = generators.ones(spark, 20, 20)
    assert reductions.all_of(x, E.greater(0.5)) and reductions.any_of(x, E.equal(1)) and reductions.none_of(x, E.less(0.5))
    assert reductions.count_of(x, E.almost_equal(1.0004, 0.0005)) == 400
    nothing = Matrix(x.df.limit(0), "coo", 20)
    assert reductions.truths(nothing, E.equal(0)).first() == (True, False, True, 0)
    assert reductions.is_binary(x) and reductions.is_biased(x) and not reductions.is_zero(x)


def test_reductions(a):
    v = a.to_local()
    assert reductions.bounds(a) == (-3, 8) and reductions.auto_dot(a) == (v**2).sum()
    assert reductions.reduce(a, reductions.PROD) == 0
    assert (np.array(reductions.reduce_columns(a, reductions.PROD, only=[2]).first()) == v[:, 2].prod()).all()
    assert reductions.reduce_row(a, 2, reductions.SUM) == v[2].sum()
    assert reductions.factorial(a.df.sparkSession, 20) == 2.43290200817664e18 and reductions.factorial(a.df.sparkSession, 0) == 1
    assert reductions.same(a, a.to_coo()) and reductions.almost_same(a, a + 1e-12) and not reductions.same(a, a + 1)
    assert reductions.sum_sqr_diff(a, a + 1) == 12 and reductions.accuracy(a, a) == 3
    assert abs(reductions.exact_sum(a * 0.1) - v.sum() * 0.1) < 1e-12


def test_wide_rows_beyond_sixty_four(spark):
    x = generators.ones(spark, 3, 200)
    assert {r["v"] for r in reductions.by_row(x, reductions.SUM).collect()} == {200}


def test_search(a):
    assert sorted(r["idx"] for r in search.find(a, E.greater(5)).collect()) == [9, 10, 11]
    assert [r["idx"] for r in search.find_first(a, E.greater(0), 2).collect()] == [4, 5]
    assert search.index_of(a, 4).first() == (1, 2) and search.index_of(a, 99).first() == (-1, -1)
    assert search.get(a, 1, 2) == 2 and search.get_linear(a, 5) == 2
    assert list(search.column_indices(a, 1)) == [1, 4, 7, 10] and list(search.row_indices(a, 1)) == [3, 4, 5]
    with pytest.raises(errors.OutOfBounds):
        search.get(a, 9, 0)
    with pytest.raises(errors.OutOfBounds):
        search.submatrix(a, 4, 3, 1, 0)


def test_columns_in_all_layouts(a):
    want = a.to_local()[:, [2, 0, 2]]
    for x in (a, a.to_coo(), a.to_wide()):
        assert (search.columns(x, [2, 0, 2]).to_local() == want).all()


def test_shape_identities(spark, a):
    assert reductions.same(a.T.T, a)
    assert reductions.total(shape.right(a, a)) == 2 * reductions.total(a)
    assert (shape.below(a, a).to_local() == np.vstack([a.to_local()] * 2)).all()
    assert (shape.tile(a, 2, 3).to_local() == np.tile(a.to_local(), (2, 3))).all()
    assert (shape.unconcat(shape.concat([a, a * 2]), 4, 3, 12).to_local() == 2 * a.to_local()).all()
    assert (shape.reshape(a, 2, 5, 1).to_local() == a.to_local().ravel()[1:11].reshape(2, 5)).all()
    assert shape.to_scalar(generators.from_scalar(spark, 4)) == 4
    with pytest.raises(errors.BadDimensions):
        shape.tile(a, 0, 1)


def test_one_hot_bases(spark):
    col = lambda v: Matrix.from_numpy(spark, np.array(v, float)[:, None])
    assert (shape.one_hot(col([0, 2, 1])).to_local() == np.eye(3)[[0, 2, 1]]).all()
    assert (shape.one_hot(col([1, 3, 2])).to_local() == np.eye(3)[[0, 2, 1]]).all()


def test_poly_features_has_28_columns(spark):
    assert shape.poly_features(generators.ones(spark, 3, 2), 6).n == 28


def test_product_forms_agree(spark):
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(7, 5)), rng.normal(size=(5, 6))
    a, b = Matrix.from_numpy(spark, p), Matrix.from_numpy(spark, q)
    for got in (a @ b, linalg.product_cells(a, b), linalg.product_blocks(a, b, side=3)):
        assert np.allclose(got.to_local(), p @ q)
    eye = generators.identity(spark, 5)
    assert np.allclose((a @ eye).to_local(), p)
    assert np.allclose(linalg.gram(a), p.T @ p)
    wide = Matrix.from_numpy(spark, rng.normal(size=(9, 20)))
    assert np.allclose(linalg.gram(wide), wide.to_local().T @ wide.to_local())


def test_determinant_inverse_lu():
    assert linalg.determinant(M5) == pytest.approx(1050)
    assert np.allclose(linalg.inverse(M5) @ M5, np.eye(5)) and np.allclose(linalg.inverse(M5, 1050) @ M5, np.eye(5))
    assert np.allclose(linalg.LU(M5).solve(np.eye(5)), np.linalg.inv(M5))
    assert linalg.LU(np.ones((2, 2))).is_singular
    with pytest.raises(errors.SingularMatrix):
        linalg.LU(np.ones((2, 2))).solve(np.ones(2))
    with pytest.raises(errors.NotSquare):
        linalg.determinant(np.ones((2, 3)))
    assert linalg.LU(np.array([[4.0]])).solve(np.array([8.0])) == [2]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(0, 10_000))
def test_lu_against_numpy(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n))
    lu = linalg.LU(a)
    assert np.isclose(lu.det, np.linalg.det(a))
    if not lu.is_singular:
        assert np.allclose(a @ lu.solve(np.eye(n)), np.eye(n), atol=1e-5)


def test_sets(spark):
    a = [8, 6, 7, 5, 3, 0, 9, 4, 3, 3, 6, 3, 5, 3, 10, 1]
    b = [4, 22, 7, 5, 3, 0, 14, 23, 3, 6, 3, 15, 3, 10, 2]
    df = lambda v: spark.createDataFrame([(x, k) for k, x in enumerate(v)], "v int, pos int")
    assert sets.counted(df(a), "v").count() == 10
    assert sets.jaccard_of(df(a), df(b)).first()[0] == pytest.approx(7 / 15)
    firsts = {r["v"]: r["pos"] for r in sets.first_seen(df(a), "v", "pos").collect()}
    assert firsts == {x: a.index(x) for x in a}
    got = [(r["v"], r["cnt"]) for r in sets.almost_distinct(spark.createDataFrame([(1.0, 0), (1.05, 1), (2.0, 2), (0.96, 3)], "v double, pos int"), "v", "pos", 0.1).collect()]
    assert got == [(1.0, 3), (2.0, 1)]


def test_golf_frequencies(spark):
    rows = "s85 85fn s80 90tn o83 78fy r70 96fy r68 80fy r65 70tn o64 65ty s72 95fn s69 70fy r75 80fy s75 70ty o72 90ty o81 75fy r71 80tn".split()
    pairs = [(rows[k][0], int(rows[k][1:]), int(rows[k + 1][:2]), rows[k + 1][2], rows[k + 1][3]) for k in range(0, len(rows), 2)]
    df = spark.createDataFrame(pairs, "outlook string, temp int, humidity int, windy string, play string")
    got = sets.frequencies(df, df.columns).groupBy("col").agg(F.sum("freq").alias("f"), F.max("depth").alias("d")).collect()
    assert all(abs(r["f"] - 1) < 1e-12 for r in got) and {r["col"]: r["d"] for r in got}["outlook"] == 3
    assert {r["col"]: r["entropy"] for r in sets.column_entropy(df, ["play"]).collect()}["play"] == pytest.approx(0.940286, abs=1e-6)


def test_split_is_exact_and_aligned(spark):
    x = spark.range(100)
    first, rest = split.split(x, "id", 0.5, seed=3)
    a, b = {r[0] for r in first.collect()}, {r[0] for r in rest.collect()}
    assert len(a) == len(b) == 50 and not a & b
    again = split.split(x.withColumn("y", F.col("id") * 2), "id", 0.5, seed=3)[0]
    assert {r["y"] for r in again.collect()} == {2 * k for k in a}
    parts = dict(split.validation_sets(x, "id").groupBy("part").count().collect())
    assert parts == {"train": 70, "validation": 15, "test": 15}


def test_local_guard(spark):
    with pytest.raises(errors.TooLarge):
        generators.ones(spark, 100, 100).to_local(most=500)


def test_same_random_values_again(spark):
    x, y = (generators.rand_sym(spark, 30, 30, 2, seed=5).to_local() for _ in range(2))
    assert (x == y).all() and abs(x).max() < 2 and abs(x.mean()) < 0.2
