import __spark_entry__ as registered
import catalog_queries


def test_every_checked_query_is_registered():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert len(registered.queries()) > 80


def test_flagship_query(spark):
    result = registered.entry(spark)
    assert result.columns[:2] == ["query_id", "pos"] and result.count() > 0


def test_recall_of_the_cell_search(spark):
    row = catalog_queries.QUERIES["vector_ann_recall"](spark, registered.SMOKE_DIR).first()
    assert row.recall >= 0.9  # these vectors are plain noise, so three quarters of the cells are probed
