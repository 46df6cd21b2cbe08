"""The trained cell search: recall, pruning of cells, and inputs over a provider's limit."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passagemill.operators import embed, vector
from passagemill.plans import retrieval


def grouped(spark, groups=20, members=60, dimensions=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(groups, dimensions))
    rows = [
        (f"c{group * members + i:05d}", (centres[group] + 0.25 * rng.normal(size=dimensions)).tolist())
        for group in range(groups) for i in range(members)
    ]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>").repartition(4)


def recall(exact, found):
    return vector.recall_against(exact, found).first().recall


def test_trained_cells_reach_the_stated_recall_with_few_probes(spark, tmp_path):
    chunks = grouped(spark)
    asked = chunks.where(F.col("chunk_id") < "c00400").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = vector.vector_topk(asked, chunks, 16, k=10)
    centres = vector.trained_centres(chunks)
    assert centres.shape == (35, 16) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    celled = vector.write_cells(chunks, centres, str(tmp_path / "cells"))
    assert celled.count() == chunks.count()
    probes = vector.probes_for_recall(asked, celled, centres, 0.92, k=10, sample=100)
    found = vector.probed_topk(asked, celled, centres, probes, k=10)
    assert probes <= 12 and recall(exact, found) >= 0.9
    one = asked.limit(1)
    opened = vector.probe_cells(one, centres, probes).first().probes
    pruned = celled.where(F.col("cell").isin(opened))
    assert "PartitionFilters: [cell" in pruned._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    assert len(pruned.inputFiles()) and pruned.select(F.input_file_name()).distinct().count() < celled.select(F.input_file_name()).distinct().count() / 2


def test_probes_are_chosen_for_noise(spark):
    rng = np.random.default_rng(5)
    chunks = spark.createDataFrame([(f"c{i}", rng.normal(size=12).tolist()) for i in range(400)], "chunk_id string, embedding array<double>")
    asked = chunks.select(F.col("chunk_id").alias("query_id"), "embedding")
    assert recall(vector.vector_topk(asked, chunks, 12), vector.vector_topk_ann(asked, chunks, 12)) >= 0.9


def test_texts_over_the_limit_fail_loudly(spark):
    provider = embed.Provider(lambda texts: [[1.0, 0.0]] * len(texts), 2, max_input_tokens=4)
    corpus = spark.createDataFrame([("a.md", "short text"), ("b.md", "a text of far too many words")], "source_path string, content string")
    with pytest.raises(PySparkException, match="b.md has .* the provider takes 4"):
        retrieval.build_index(corpus, 2, whole_texts=True, provider=provider)
    index = retrieval.build_index(corpus.where("source_path = 'a.md'"), 2, whole_texts=True, provider=embed.Provider(provider.embed, 2, max_input_tokens=6))
    asked = spark.createDataFrame([(1, "one two three four five six seven")], "query_id long, question string")
    with pytest.raises(PySparkException, match="text of 1 has 7 tokens"):
        retrieval.hybrid_search(asked, index).collect()
