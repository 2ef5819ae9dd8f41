import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from claimscope.session import local_session
    s = local_session("*", shuffle_partitions=8, app="claimscope-tests")
    yield s


@pytest.fixture(scope="session")
def claims(spark):
    from claimscope.sources.tables import claims_view
    return claims_view(spark, SF_SMALL).cache()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from claimscope.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
