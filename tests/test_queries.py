import pytest

from lodestone.plans.catalogue import QUERIES, SQL
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_its_sql_gives(spark, db, name):
    assert rows(QUERIES[name](spark, FOLDER).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_runs(spark, name):
    # no page of the tables holds items in JSON-LD
    assert (QUERIES[name](spark, FOLDER).count() > 0) == (name != "jsonld_items")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
