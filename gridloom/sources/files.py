"""Reading and writing matrices: Octave text, delimited text, IDX binary, plain lines, Parquet."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.plans.matrix import Matrix
from gridloom.plans.workspace import ship

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: Columns of delimited text.
MOST_COLUMNS = 4096


def number(text: Column) -> Column:
    """The leading number of a text; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, _NUMBER, 1).try_cast("double"), F.lit(0.0))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, pos, value): the lines that are not empty, pos rising in each file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("pos"), "value")
    return rows.where(F.length("value") > 0)


def words_of(line: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(line, r"\s+"), lambda w: w != "")


def _octave(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their section's head fields."""
    each = lines(spark, path)
    order = Window.partitionBy("file").orderBy("pos")
    told = each.withColumn("section", F.count_if(F.col("value").rlike(r"^#\s*name:")).over(order))
    inside = Window.partitionBy("file", "section")
    head = lambda key: F.max(F.when(F.col("value").rlike(rf"^#\s*{key}:"), F.trim(F.regexp_extract("value", r":\s*(.*)$", 1)))).over(inside)
    return told.withColumns({"name": head("name"), "type": head("type"), "m": head("rows"), "n": head("columns")}).where("section > 0")


def octave_dims(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, type, rows, columns) from the heads alone; a scalar is 1x1."""
    found = _octave(spark, path).where(F.col("value").startswith("#")).select("name", "type", F.coalesce(F.col("m").cast("long"), F.lit(1).cast("long")).alias("rows"), F.coalesce(F.col("n").cast("int"), F.lit(1)).alias("columns"))
    return found.where(F.col("type").isin("matrix", "scalar")).distinct()


def octave_cells(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, i, j, v) of all matrices and scalars in the text files; other types are passed over.

    A file is one ordered text, so its lines are numbered in one task (sorted with spilling); files go side by side.
    """
    data = _octave(spark, path).where(F.col("type").isin("matrix", "scalar") & ~F.col("value").startswith("#"))
    i = (F.row_number().over(Window.partitionBy("file", "section").orderBy("pos")) - 1).cast("long")
    return data.withColumn("i", i).select("name", "i", F.posexplode(words_of(F.col("value"))).alias("j", "w")).select("name", "i", "j", number(F.col("w")).alias("v"))


def read_octave(spark: SparkSession, path: str) -> dict[str, Matrix]:
    """Matrices by name; a name that comes again replaces the one before."""
    dims = {r["name"]: (r["rows"], r["columns"]) for r in octave_dims(spark, path).collect()}
    cells = octave_cells(spark, path)
    return {name: Matrix(cells.where(F.col("name") == name).select("i", "j", "v"), "coo", n, m) for name, (m, n) in dims.items()}


def octave_text(x: Matrix, name: str) -> DataFrame:
    """Rows (pos, value): the text of one matrix. pos -1 is the head."""
    spark = x.df.sparkSession
    m, n = x.dims
    head = spark.createDataFrame([(-1, f"# name: {name}\n# type: matrix\n# rows: {m}\n# columns: {n}")], "pos long, value string")
    body = x.to_vec().df.select(F.col("i").alias("pos"), F.concat(F.lit(" "), F.array_join(F.transform("x", lambda v: v.cast("string")), " ")).alias("value"))
    return head.union(body)


def write_octave(x: Matrix, name: str, path: str) -> None:
    """One text file in the folder; the format is a single ordered text, so one task writes it."""
    octave_text(x, name).repartitionByRange(1, "pos").sortWithinPartitions("pos").select("value").write.mode("overwrite").text(path)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> Matrix:
    """Delimited text: the first line of each file is a head, runs of separators count as one, any character of sep separates, and what is no number is 0."""
    each = lines(spark, path)
    split = F.filter(F.split("value", "[" + "".join(f"\\{c}" for c in sep) + "]+"), lambda w: w != "")
    first = each.groupBy("file").agg(F.min("pos").alias("first"))
    head = each.join(F.broadcast(first), "file").where("pos = first").select(F.size(split).alias("n")).first()
    if head is None:
        raise errors.BadDimensions(f"{path} is empty")
    if head["n"] > MOST_COLUMNS:
        raise errors.BadDimensions(f"{head['n']} columns")
    rows = each.join(F.broadcast(first), "file").where("pos > first")
    # a line's number from counts by split and the rank in its split: no task orders a whole file
    at = Window.partitionBy("file", "pos.block").orderBy("pos.id")
    counts = rows.groupBy("file", F.col("pos.block").alias("block")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.withColumns({"k": F.row_number().over(at) - 1, "block": F.col("pos.block")}).join(F.broadcast(counts.withColumn("before", before)), ["file", "block"])
    n = head["n"]
    x = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: number(F.coalesce(F.get(split, j), F.lit(""))))
    return Matrix(ranked.select((F.col("before") + F.col("k")).cast("long").alias("i"), x.alias("x")), "vec", n)


def features_and_target(x: Matrix) -> tuple[Matrix, Matrix]:
    """All columns but the last, and the last."""
    from gridloom.operators import search

    return search.drop_last(x), search.column(x, x.n - 1)


def _idx(content: bytes, images: bool) -> tuple[int, np.ndarray]:
    """Size of a row and the rows, from a big-endian head and bytes."""
    if images:
        _, count, h, w = struct.unpack(">4I", content[:16])
        return h * w, np.frombuffer(content, np.uint8, count * h * w, 16).reshape(count, h * w)
    _, count = struct.unpack(">2I", content[:8])
    return 1, np.frombuffer(content, np.uint8, count, 8).reshape(count, 1)


def read_idx(spark: SparkSession, path: str, images: bool = True) -> Matrix:
    """An IDX file of images (a row each) or labels; rows leave in batches of bounded size."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                _, rows = _idx(content, images)
                for k in range(0, len(rows), 2000):
                    block = rows[k : k + 2000].astype(float)
                    yield pd.DataFrame({"i": np.arange(k, k + len(block)), "x": list(block)})

    df = files.mapInPandas(run, "i long, x array<double>")
    if not images:
        return Matrix(df, "vec", 1)
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 9, 8).alias("h")).first()["h"]
    h, w = struct.unpack(">2I", bytes(head))
    return Matrix(df, "vec", h * w)


def write_idx(x: Matrix, path: str, height: int | None = None) -> None:
    """An IDX file of bytes: images of so many lines from the rows of x, or without a height labels from its only column. For matrices that fit on the driver; larger ones go to Parquet."""
    rows = x.to_local().astype(np.uint8)
    head = struct.pack(">2I", 0x801, len(rows)) if height is None else struct.pack(">4I", 0x803, len(rows), height, rows.shape[1] // height)
    spark = x.df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(head + rows.tobytes()))
    out.close()


def read_table(spark: SparkSession, path: str, n: int) -> Matrix:
    return Matrix(spark.read.parquet(path), "vec", n)


def write_table(x: Matrix, path: str) -> None:
    x.to_vec().df.write.mode("overwrite").parquet(path)


class Catalog(dict):
    """Matrices by name, as a file or session holds them."""

    def matrix(self, name: str) -> Matrix:
        if name not in self:
            raise errors.MatrixError(f"no matrix {name}")
        return self[name]

    def release(self, name: str | None = None) -> None:
        """Unpersist and forget one matrix, or all."""
        for k in [name] if name is not None else list(self):
            self.pop(k).release()

    def as_views(self) -> None:
        for name, x in self.items():
            x.to_coo().df.createOrReplaceTempView(name)
