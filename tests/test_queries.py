import os

import pytest

from lumenlake.plans import annotation_queries, dataset_queries, detection_queries, exchange_queries, frame_queries, image_queries
from tests.compare import database, same

SF = "/root/testdata/sf0.001"
MODULES = (annotation_queries, dataset_queries, detection_queries, exchange_queries, frame_queries, image_queries)
CASES = [(m, name) for m in MODULES for name in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, con, module, name):
    df = module.QUERIES[name](spark, SF)
    if name in module.ORACLES:
        same(df, con, module.ORACLES[name])
    else:
        assert df.count() >= 0


def test_entry_without_extras():
    import __spark_entry__ as e

    assert {n for m in MODULES for n in m.QUERIES} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
