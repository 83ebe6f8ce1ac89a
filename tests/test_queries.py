import pytest

from sonalake.plans import catalog, evaluation

from .compare import by_sql, same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(catalog.QUERIES[name](spark, data).toPandas(), by_sql(catalog.ORACLES[name], data))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_features_of_short_and_long_signals(spark, data):
    got = catalog.QUERIES["embedding_features"](spark, data).toPandas()
    assert (got["status"] == "ok").all() and got["centroid"].between(0, 500).all()


def test_models_see_every_component_and_fold(spark, data):
    width = len(spark.read.parquet(f"{data}/embeddings.parquet").first()["embedding"])
    assert [c for c in evaluation.numeric(spark, data).columns if c.startswith("ft_")] == [f"ft_{i}" for i in range(width)]
    assert catalog.QUERIES["rf_cv"](spark, data).count() == 3
