from __future__ import annotations

import struct

import numpy as np
import pytest

from gridloom import errors
from gridloom.plans.matrix import Matrix
from gridloom.sources import files
from gridloom.streaming import moments


def test_octave_several_sections(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# Created by hand\n# name: X\n# type: matrix\n# rows: 2\n# columns: 3\n 1 2 3\n 4.5 -5e1 6\n\n\n# name: k\n# type: scalar\n7\n# name: s\n# type: string\n# length: 2\nhi\n# name: y\n# type: matrix\n# rows: 2\n# columns: 1\n 0\n 1\n")
    got = files.read_octave(spark, str(tmp_path / "a.txt"))
    assert set(got) == {"X", "k", "y"}
    assert (got["X"].to_local() == [[1, 2, 3], [4.5, -50, 6]]).all() and got["k"].to_local() == 7 and (got["y"].to_local() == [[0], [1]]).all()
    assert {(r["name"], r["rows"], r["columns"]) for r in files.octave_dims(spark, str(tmp_path / "a.txt")).collect()} == {("X", 2, 3), ("k", 1, 1), ("y", 2, 1)}


def test_octave_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(25, 4))
    files.write_octave(Matrix.from_numpy(spark, x), "m", str(tmp_path / "o"))
    assert (files.read_octave(spark, str(tmp_path / "o"))["m"].to_local() == x).all()


def test_delimited(spark, tmp_path):
    (tmp_path / "w.csv").write_text('"a";"b";"c"\n1;;2;3\n4;x;-6.5e0\n7;8abc;9\n')
    x = files.read_delimited(spark, str(tmp_path / "w.csv"), ";")
    assert (x.to_local() == [[1, 2, 3], [4, 0, -6.5], [7, 8, 9]]).all()
    a, b = files.features_and_target(x)
    assert a.n == 2 and (b.to_local().ravel() == [3, -6.5, 9]).all()
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(errors.BadDimensions):
        files.read_delimited(spark, str(tmp_path / "e.csv"))


def test_idx(spark, tmp_path):
    img = np.arange(3 * 4 * 2, dtype=np.uint8)
    (tmp_path / "i").write_bytes(struct.pack(">4I", 2051, 3, 4, 2) + img.tobytes())
    (tmp_path / "l").write_bytes(struct.pack(">2I", 2049, 3) + bytes([5, 0, 9]))
    x = files.read_idx(spark, str(tmp_path / "i"))
    assert x.n == 8 and (x.to_local() == img.reshape(3, 8)).all()
    assert (files.read_idx(spark, str(tmp_path / "l"), images=False).to_local().ravel() == [5, 0, 9]).all()


def test_catalog_of_matrices(spark):
    c = files.Catalog(x=Matrix.from_numpy(spark, np.eye(2)))
    c.as_views()
    assert spark.sql("SELECT sum(v) FROM x").first()[0] == 2
    c.release("x")
    with pytest.raises(errors.MatrixError):
        c.matrix("x")


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = moments.windowed_moments(stream.withColumn("ts", stream["ts"].cast("timestamp")), "ts", "value", "event_type")
    q = out.writeStream.format("memory").queryName("moments_test").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): (r["n"], round(r["mean"], 8)) for r in spark.table("moments_test").collect()}
    want = {(r["start"], r["event_type"]): (r["n"], round(r["mean"], 8)) for r in moments.windowed_moments(events.withColumn("ts", events["ts"].cast("timestamp")), "ts", "value", "event_type").collect()}
    assert got == want
