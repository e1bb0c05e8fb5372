import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spanlake.session import local_session
    s = local_session(cpus="*", app="spanlake-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    import tempfile
    con.sql(f"SET temp_directory='{tempfile.mkdtemp(prefix='duck-')}'")
    con.sql("SET max_temp_directory_size='2GB'")
    for t in ("documents", "benchmark", "conversations", "labels", "embeddings", "events", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
