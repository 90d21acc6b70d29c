import pytest

from wavemill.plans import catalog

from duck import same

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["q04_chunk_rms_db", "q06_reservoir_window", "q12_toc100", "q21_linear_resample"])
def test_partitions_change_nothing(spark, name):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(str, catalog.QUERIES[name](spark, SMALL).collect()))

    try:
        assert rows(1) == rows(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
