"""Registered queries against their SQL on the smallest tables; ``tests/compare.py`` does the same at any scale."""

import pytest

import __spark_entry__ as contract
from compare import DATA, connect, difference
from logweave.plans import views
from logweave.plans.oracle import ORACLE

FOLDER = DATA / "sf0.001"
# The text operators bring their own tests.
NAMES = list(ORACLE)


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    result = contract.queries()[name](spark, str(FOLDER))
    assert difference(result, connect(FOLDER), contract.oracle_sql()[name]) is None


def test_every_query_has_a_statement():
    from logweave.plans import catalog

    # What boosted trees predict cannot be said in SQL; tests/test_models.py holds it against plain counts.
    assert set(catalog.QUERIES) == set(ORACLE) | {"d2_tree_classifier"}
    assert set(ORACLE) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
def test_entry(spark):
    made = contract.entry(spark)
    assert made.columns == ["k", "f1", "rc", "pc", "acc"] and made.count() == 5


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_order_of_the_order_lines_is_total(spark, scale):
    folder = FOLDER.parent / scale
    if not folder.exists():
        pytest.skip("test tables are not here")
    items = views.table(spark, str(folder), "lineitem").select(views.ITEM_ORDER)
    assert items.count() == items.distinct().count()
