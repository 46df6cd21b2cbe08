"""The registered vector searches over tables of their own."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as registered


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Vectors of which hardly any id is divisible by 20, one without a direction."""
    root = str(tmp_path_factory.mktemp("vectors"))
    rng = np.random.default_rng(5)
    rows = [(key, [float(value) for value in rng.normal(size=64)]) for key in range(1, 121)] + [(121, [0.0] * 64)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{root}/embeddings.parquet")
    return root


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_grid", "vector_topk_ann"])
def test_every_vector_is_a_question(spark, folder, name):
    rows = registered.queries()[name](spark, folder).select("query_id", "chunk_id", "rank").collect()
    assert {row.query_id for row in rows} == set(range(1, 121))
    assert all(row.chunk_id == row.query_id for row in rows if row["rank"] == 1)
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet/*.parquet' WHERE vec_id < 121")
        wanted = con.sql(f"SELECT query_id, chunk_id, rank FROM ({registered.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(wanted)


def test_recall_is_over_every_vector(spark, folder):
    row = registered.queries()["vector_ann_recall"](spark, folder).first()
    assert row.exact_hits == 120 * 20 and row.recall >= 0.9
