import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the package wherever the tests are started from.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from bizlens.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", shuffle_partitions=8, conf={"spark.driver.memory": "4g"})
    checkpoint_dir(s)  # local session: a scratch checkpoint folder
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from bizlens.plans.views import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="bizlens-test-")
