"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets the exponential key -ln(u) / w, u from a hash of seed, doc_id and text, w its quality weight. A source
whose target is t words and whose size is s gives floor(t / s) complete epochs; the rest of the budget goes to the documents
of smallest key, by prefix sum, the last one where that brings the sum nearer the budget. So a source's words differ from its target by at most
half a document.

Scale: a source may hold a third of all rows, so it is never sorted in one task. Keys fall into BINS bins in key order; words
are summed by (source, bin), the bin in which the budget ends is found from those sums, and only that bin's rows are ranked, equal
rows as one. The plan is a row a source: each document then decides for itself.

Nulls: a null text has size 0 and weight 1; null sources are one source, the last. Empty documents take nothing. Equal keys are ordered by
doc_id; rows that are equal in doc_id and text are interchangeable. An empty table gives an empty mix. Extra columns
pass; those named as the columns it adds (size, mix_key, mix_bin, source_size, target, copies) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Stage, read, small

SEED = "mix-1"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MOST_EPOCHS = 3
BINS = 4096
#: Characters that prose has few of; their share lowers a document's weight.
JUNK = "0123456789|#*%&$@{}[]<>=_~^"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: the less, the more of the text is junk characters."""
    text = F.coalesce(text, F.lit(""))
    kept = F.length(F.translate(text, JUNK, "")) / F.greatest(F.length(text), F.lit(1))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.05), 1 - 4 * (1 - kept)))


def measure(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size (words), mix_key and mix_bin."""
    told = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(told, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    docs = docs.withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "mix_key": -F.log(u) / quality_weight(F.col("text"))})
    return docs.withColumn("mix_bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("mix_key"))))).cast("int"))


def targets(bins: DataFrame) -> DataFrame:
    """From sums by (source, mix_bin): source, source_size, target. One row a source; only these rows meet in one task."""
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = sources.withColumn("w", w.cast("long")).withColumn("cap", MOST_EPOCHS * F.col("source_size"))
    # level rises until the budget is used up; sources fill in the order of cap / w, and one fills as its cap is below level * w
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    up = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    sources = sources.withColumns({"total": F.sum("source_size").over(every), "all_w": F.sum("w").over(every), "full": F.coalesce(F.sum("cap").over(up), F.lit(0)), "full_w": F.coalesce(F.sum("w").over(up), F.lit(0))})
    level = (F.col("total") - F.col("full")).cast("double") / (F.col("all_w") - F.col("full_w")).cast("double")
    sources = sources.withColumns({"level": level, "pos": F.row_number().over(fill)})
    sources = sources.withColumn("open_level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct("pos", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("open_level"), F.col("cap").cast("double")))
    return sources.select("source", "source_size", target.alias("target"))


def plan(measured: DataFrame, stage: Stage) -> DataFrame:
    """One row a source: source_size, target, epochs, the bin in which the fractional epoch ends, and there the last row in the order of (mix_key, doc_id, size) that it takes, with how many rows equal to that one there are and how many of them it takes. measured: staged rows (doc_id, source, size, mix_key, mix_bin)."""
    bins = stage.put(measured.groupBy("source", "mix_bin").agg(F.sum("size").alias("words")))
    per = targets(bins)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("mix_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("before", before).withColumnRenamed("source", "s").join(per.withColumnRenamed("source", "source_"), F.col("s").eqNullSafe(F.col("source_")))
    ends = ends.where("before <= rest AND rest < before + words").groupBy("s").agg(F.min(F.struct("mix_bin", "before")).alias("end"))
    out = per.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    out = stage.put(out.select(F.col("source").alias("gl_source"), "source_size", "target", F.col("epochs").alias("gl_epochs"), F.col("rest").alias("gl_rest"), F.coalesce("end.mix_bin", F.lit(BINS)).alias("gl_end"), F.coalesce("end.before", F.lit(0)).cast("long").alias("gl_before")))
    # rows that are equal are one with a count, so a row repeated any number of times is ranked once
    last = measured.join(small(out.where("gl_rest > 0")), F.col("source").eqNullSafe(F.col("gl_source")) & (F.col("mix_bin") == F.col("gl_end")))
    last = last.groupBy("gl_source", "gl_rest", "gl_before", "mix_key", "doc_id", "size").agg(F.count("*").alias("n"))
    order = Window.partitionBy("gl_source").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("gl_rest") - F.col("gl_before") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0))
    # of n equal rows the k-th (from 0) is taken if k * size + size / 2 <= room
    takes = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(room / F.col("size") + 0.5))).otherwise(F.when(room >= 0, F.col("n")).otherwise(0))
    taken = last.withColumn("takes", takes).where("takes > 0").groupBy("gl_source").agg(F.max(F.struct("mix_key", "doc_id", "size", "n", "takes")).alias("gl_last")).withColumnRenamed("gl_source", "s")
    return stage.put(out.drop("gl_before").join(taken, F.col("gl_source").eqNullSafe(F.col("s")), "left").drop("s"))


def mix(measured: DataFrame, plans: DataFrame) -> DataFrame:
    """measured rows with source_size, target and copies, how often the mix takes the document (0 to 3). Each row decides for itself; only of rows equal to the last one taken some may be in and others out, and these are numbered."""
    rows = measured.drop("source_size", "target", "copies").join(small(plans), F.col("source").eqNullSafe(F.col("gl_source")))
    here, last = F.struct("mix_key", "doc_id", "size"), F.struct("gl_last.mix_key", "gl_last.doc_id", "gl_last.size")
    inside = (F.col("mix_bin") < F.col("gl_end")) | (F.col("mix_bin") == F.col("gl_end")) & F.col("gl_last").isNotNull() & (here <= last)
    rows = rows.withColumn("copies", F.col("gl_epochs") + F.when((F.col("gl_rest") > 0) & inside, 1).otherwise(0))
    if not plans.where("gl_last.takes < gl_last.n").isEmpty():
        part = F.coalesce((F.col("mix_bin") == F.col("gl_end")) & here.eqNullSafe(last) & F.col("gl_last.takes").isNotNull() & (F.col("gl_last.takes") < F.col("gl_last.n")), F.lit(False))
        number = F.row_number().over(Window.partitionBy("source").orderBy("mix_key"))
        split = rows.where(part).withColumn("gl_k", number).withColumn("copies", F.col("gl_epochs") + F.when(F.col("gl_k") <= F.col("gl_last.takes"), 1).otherwise(0)).drop("gl_k")
        rows = rows.where(~part).unionByName(split)
    return rows.drop("gl_source", "gl_epochs", "gl_rest", "gl_end", "gl_last")


NARROW = ["doc_id", "source", "size", "mix_key", "mix_bin"]


def mixed(docs: DataFrame, stage: Stage) -> DataFrame:
    """docs with what ``measure`` and ``mix`` add. Sums and ranks are taken on a stored table of five narrow columns; texts are read a second time for the result, and moved nowhere."""
    measured = measure(docs)
    return mix(measured, plan(stage.put(measured.select(NARROW)), stage))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "op3")
    measured = stage.put(measure(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return mix(measured, plan(measured, stage)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


_JUNK_SQL = JUNK.replace("'", "''")
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  -ln((CAST(('0x' || substr(md5(concat('{SEED}', '|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', t)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / CASE WHEN length(t) = 0 THEN 1.0::DOUBLE ELSE greatest(0.05::DOUBLE, 1 - 4 * (1 - length(translate(t, '{_JUNK_SQL}', ''))::DOUBLE / greatest(length(t), 1)::DOUBLE)) END AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM m GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
f AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(3 * source_size) OVER o, 0) AS full_, coalesce(sum(w) OVER o, 0) AS full_w FROM w
  WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - full_)::DOUBLE / (all_w - full_w)::DOUBLE AS level, row_number() OVER (ORDER BY cap::DOUBLE / w::DOUBLE, source NULLS LAST) AS pos FROM f),
p AS (SELECT *, (SELECT level FROM l WHERE cap >= level * w ORDER BY pos LIMIT 1) AS open_level FROM l),
q AS (SELECT source AS src, source_size, least(cap::DOUBLE, coalesce(w * open_level, cap::DOUBLE)) AS target FROM p),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END AS epochs FROM q),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
x AS (SELECT m.*, r.source_size, r.target, r.epochs, r.rest,
  coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m JOIN r ON m.source IS NOT DISTINCT FROM r.src)
SELECT doc_id, size, source_size, target,
CAST(size * (epochs + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken,
CAST(epochs + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS INTEGER) AS copies FROM x
"""
