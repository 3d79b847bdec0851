"""What the training-data operators share: reading, staging, size-checked broadcasts, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.workspace import fresh, remove, ship

#: The white space of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class Stage:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    ``drop`` removes tables that nothing reads any more; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base, self.n = spark, fresh(spark, label), 0

    def put(self, df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
        """The table, read back; ``by`` names a column whose values get folders of their own."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        rows = df.write.option("compression", codec)
        (rows.partitionBy(by) if by else rows).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._gridloom_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._gridloom_path)


#: Rows of a narrow table that is sent to all tasks.
SENT_ROWS = 100_000


def small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many (narrow) rows; beyond, the join shuffles and AQE splits skewed parts."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of a key beyond which a join by it is split.
HOT = 1000


def join_split(rows: DataFrame, table: DataFrame, mine: str, theirs: str, n: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table on mine = theirs. table is staged, has one row for each value of theirs, and n, how many rows
    of ``rows`` have it. Keys of more than HOT rows, of which there are at most one for HOT rows, are looked up where the rows lie,
    so that no task gets all rows of a key; beyond what ``small`` sends, AQE splits them."""
    on = F.col(mine) == F.col(theirs)
    if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        return rows.join(F.broadcast(table), on, how)
    hot, cold = table.where(F.col(n) > HOT), table.where(F.col(n) <= HOT)
    if hot.isEmpty():
        return rows.join(table, on, how)
    apart = rows.join(small(hot.select(F.col(theirs).alias("gl_hot"))), F.col(mine) == F.col("gl_hot"), "left_anti")
    return rows.join(small(hot), on).unionByName(apart.join(cold, on, how))


#: Bytes of an Arrow batch that a function takes at a time, and its rows.
PIECE_BYTES, PIECE_ROWS = 16 << 20, 1500


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of bounded rows and (about) bytes; Spark itself bounds the bytes of a batch. Nothing is copied, and no setting of the session is touched."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * PIECE_BYTES // max(b.nbytes, 1)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by key, tables that hold whole runs of equal keys; only the last run waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(key))
        last = col[b.num_rows - 1]
        first = 0
        if held:
            before = held[-1].column(held[-1].schema.get_field_index(key))[held[-1].num_rows - 1]
            if before == last:
                held.append(b)
                continue
        lo, hi = 0, b.num_rows - 1  # the first row of the last run
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if col[mid] == last else (mid + 1, hi)
        first = lo
        done = [*held, b.slice(0, first)] if first else held
        if done:
            yield pa.Table.from_batches(done)
        held = [b.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


#: Edges whose components one task finds.
ONE_TASK_EDGES = 50_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of edges (u, v)."""
    up: dict = {}
    kind = None

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            up[max(p, q)] = min(p, q)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["node", "comp"])


def components(stage: Stage, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (node, comp), comp the smallest node reached; isolated nodes have no row.

    Alternating large-star and small-star steps on staged edge tables. Each step is a partial aggregate and an equi-join, so
    a node with very many edges is split by AQE, and nothing is gathered on the driver but one row of counts a round. No more
    than ONE_TASK_EDGES edges are joined up in one task instead.
    """
    cur = stage.put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if cur.count() <= ONE_TASK_EDGES:
        ship(stage.spark)
        return stage.put(cur.coalesce(1).mapInArrow(_joined_up, cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).schema))
    mark = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = stage.put(both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        stage.drop(cur)
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(low, F.col("u") == F.col("k"))
        nxt = stage.put(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("k", "m")).where("u <> v").distinct())
        stage.drop(large)
        cur = nxt
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of these names (in any case) renamed, and the renaming that brings them back."""
    taken = {n.lower() for n in names}
    away = {c: f"{c}__aside" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
