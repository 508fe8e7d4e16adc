import pytest
from leafmill.plans import changes, core, life, running, text, work
from oracle import assert_matches

MODULES = (core, text, work, life, changes, running)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
#: Their inputs make no row at the smallest scale.
MAY_BE_EMPTY = {"passage_to_page", "deleted_captures", "patched_overlap"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, data, name):
    rows = assert_matches(spark, data, QUERIES[name], ORACLES[name])
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_give_the_same_rows_again(spark, data, name):
    rows = [sorted(map(str, QUERIES[name](spark, data).collect())) for _ in range(2)]
    assert rows[0] == rows[1]
    assert rows[0] or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
