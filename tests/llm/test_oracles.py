import pytest

from strandframe.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    if not oracle.DATA.exists():
        pytest.skip("no test tables here")
    assert not oracle.differs(spark, oracle.connection(), queries.QUERIES[name], queries.ORACLE[name])
