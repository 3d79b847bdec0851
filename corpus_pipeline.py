"""From raw documents to shards: quality, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes the columns of documents and all but the last return them. Rows with null columns, empty texts, repeated rows
and extra columns go through as the operators' own docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, line_quality, mixture, near_dup, shards
from gridloom.llm.common import Stage, read, set_aside

#: Documents whose score is lower are rejected.
LEAST_QUALITY = 0.5


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score LEAST_QUALITY or more, by the field fitted on the labelled ones among them."""
    field = line_quality.train(docs, read(spark, sf_dir, "labels"))
    return line_quality.score(docs, field, name="gl_score").where(F.col("gl_score") >= LEAST_QUALITY).drop("gl_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at a similarity of 0.8."""
    return near_dup.keep_one(docs, Stage(spark, "pipeline-near"))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; documents that are mostly benchmark go whole."""
    return decontaminate.remove_hits(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none to three times."""
    names = docs.columns
    docs, back = set_aside(docs, ["size", "mix_key", "mix_bin", "source_size", "target", "copies"])
    mixed = mixture.mixed(docs, Stage(spark, "pipeline-mix"))
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("gl_copy")).drop("gl_copy").withColumnsRenamed(back).select(names)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, text_crc32, virtual slot and shard; columns of these names are replaced."""
    placed = shards.shard(docs, shards.MapStore(spark, f"pipeline-{zlib.crc32(sf_dir.encode())}"))
    return placed.select(*dict.fromkeys([*docs.columns, "size", "text_crc32", "virtual_slot", "shard"]))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", assign_shards),
]
#: A trained field, a similarity join and a balanced slot map have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what each keeps is written and read again by the next."""
    kept = Stage(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
