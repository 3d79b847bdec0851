from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def stage(spark, tmp_path):
    from gridloom.llm.common import Stage

    spark.conf.set("gridloom.shared.dir", f"file://{tmp_path}/shared")
    yield Stage(spark, "test")
    spark.conf.unset("gridloom.shared.dir")


@pytest.fixture()
def sf_dir(spark, tmp_path):
    """Writes tables to a folder as the queries read them."""
    spark.conf.set("gridloom.shared.dir", f"file://{tmp_path}/shared")

    def write(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.parquet(f"{tmp_path}/in/{name}.parquet")
        return f"{tmp_path}/in"

    yield write
    spark.conf.unset("gridloom.shared.dir")


def edge_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a long text, characters beyond the basic plane."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return [(1, "plain words here"), (1, "plain words here"), (2, None), (3, ""), (4, " \t\n "), (None, "no id at all"), (None, None), (5, long, None), (6, "𝒜bc é ü 𝒜bc\n\nlast", "src1"), (7, "x"), (2**40, "plain words here", "src2")]


@pytest.fixture(scope="session")
def edges(documents):
    return documents(edge_rows())
