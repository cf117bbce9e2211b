import pytest

from strandframe.plans import annotations, extras, models, problems, scans, sequences
from tests import oracle

MODULES = [problems, sequences, annotations, models, extras, scans]
WITH_SQL = [(m, n) for m in MODULES for n in m.ORACLE]


@pytest.fixture(scope="module")
def con():
    if not oracle.DATA.exists():
        pytest.skip("no test tables here")
    return oracle.connection()


@pytest.mark.parametrize("module, name", WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_query_equals_its_sql(spark, con, module, name):
    assert not oracle.differs(spark, con, module.QUERIES[name], module.ORACLE[name])


def test_every_sql_has_a_query():
    assert all(n in m.QUERIES for m, n in WITH_SQL)
