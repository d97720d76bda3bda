"""Every registered query next to its SQL twin on the smallest tables, and stability of results."""

import pytest

import __spark_entry__ as entry
from checks import stages
from checks.compare import compare, connect, rows_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_twin(spark, con, name):
    same, note = compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert same, note


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "loyalty_segment"


@pytest.mark.parametrize("name", ["loyalty_categories", "stratified_split", "random_oversample", "curve_areas"])
def test_results_do_not_depend_on_partitioning(spark, name):
    def result(partitions):
        stages.forget()
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = entry.queries()[name](spark, FOLDER)
        return rows_of(df.columns, [tuple(r) for r in df.collect()])

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert result("3") == result("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
