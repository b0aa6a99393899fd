"""Every query of the engine against its SQL in DuckDB."""

import pytest
from conftest import SF, rows

from vexel.plans import queries as engine


@pytest.mark.parametrize("name", sorted(engine.ORACLES))
def test_same_rows(spark, duck, name):
    ours, theirs = engine.QUERIES[name](spark, SF).toPandas(), duck.execute(engine.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLES)))
def test_without_sql(spark, name):
    out = engine.QUERIES[name](spark, SF).toPandas()
    assert out["n"].sum() == 500 and len(out) <= engine.N_CLUSTERS


def test_insert_checks_the_whole_corpus(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    found = engine.QUERIES["insert_dedup"](spark, SF).toPandas()
    assert len(found) == n and found["status"].value_counts().to_dict() == {"duplicate id": n - n // 2, "ok": n // 2}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
