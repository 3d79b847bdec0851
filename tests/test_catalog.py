"""Every query that has SQL gives what DuckDB gives."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from gridloom import catalog

DIR = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.collect(), got.columns) == table(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_workers_without_the_package(tmp_path):
    """A session whose workers do not know where the package is: it is sent to them."""
    code = """
import sys; sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", SHARED).getOrCreate()
from gridloom import catalog
for name in ("nn_cost", "matrix_product", "kmeans_update", "idx_labels"):
    print(name, catalog.QUERIES[name](spark, DIR).count())
"""
    head = f"ROOT, DIR, SHARED = {ROOT!r}, {DIR!r}, 'file://{tmp_path}'\n"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", head + code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.split() == ["nn_cost", "1", "matrix_product", "1500", "kmeans_update", "320", "idx_labels", "25"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
