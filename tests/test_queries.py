"""Every query beside its SQL over the smallest tables."""

import pytest

from tests.compare import DATA, entry_module, same

E = entry_module()
Q, O = E.queries(), E.oracle_sql()


@pytest.mark.skipif(not (DATA / "sf0.001").exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(O))
def test_same(spark, name):
    ok, note = same(spark, str(DATA / "sf0.001"), Q[name], O[name])
    assert ok, note


def test_every_sql_has_a_query():
    assert set(O) <= set(Q)
