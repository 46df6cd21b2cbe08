"""Greedy requests against one sequential pass, whatever the partitions and slices."""

import random

import pytest

from passagemill.operators import embed, requests


def sequential(rows, provider):
    out, used, filled, number = {}, 0, 0, 0
    for key, size in sorted(rows):
        if size > provider.max_input_tokens:
            out[key] = None
            continue
        if filled and (filled >= provider.max_batch_size or used + size > provider.max_request_tokens):
            number, used, filled = number + 1, 0, 0
        used, filled = used + size, filled + 1
        out[key] = number
    return out


@pytest.mark.parametrize("partitions, slices", [(1, 8), (7, 8), (3, 50), (2, 100_000)])
def test_same_requests_for_any_partitions(spark, monkeypatch, partitions, slices):
    monkeypatch.setattr(requests, "GROUP_SLICES", 3)
    pick = random.Random(5)
    rows = [(key, pick.choice([0, 1, 5, 40, 90, 120])) for key in range(300)]
    pick.shuffle(rows)
    provider = embed.Provider(lambda texts: [], 4, max_input_tokens=100, max_request_tokens=130, max_batch_size=7)
    df = spark.createDataFrame(rows, "key long, size int").repartition(partitions)
    found = requests.token_budget_batches(df, "key", "size", provider, slices).collect()
    assert {r.key: r.request_id for r in found} == sequential(rows, provider)
    assert all(r.oversize == (r.request_id is None) for r in found)


def test_no_texts(spark):
    provider = embed.Provider(lambda texts: [], 4)
    none = spark.createDataFrame([], "key string, size int")
    assert requests.token_budget_batches(none, "key", "size", provider).collect() == []
    one = spark.createDataFrame([("a", None), ("b", 10_000_000)], "key string, size int")
    found = {r.key: (r.request_id, r.oversize) for r in requests.token_budget_batches(one, "key", "size", provider).collect()}
    assert found == {"a": (0, False), "b": (None, True)}
