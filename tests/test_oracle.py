import pytest

from skyweave.plans import catalog

from .oracle import SMALL, compare, views

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    assert not compare(catalog.queries()[name](spark, SMALL), SQL[name], con)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(SQL)


def test_entry_is_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['skyweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)
