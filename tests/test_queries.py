import pytest
from comparing import same_rows

from assayframe.plans.oracles import ORACLES
from assayframe.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        same_rows(got, duck.sql(ORACLES[name]))
    else:
        assert got.count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 106
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_randomisations_are_the_reference_number(spark, sf_dir):
    assert QUERIES["curveball_null"](spark, sf_dir).count() == 200
