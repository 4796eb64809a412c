import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trawl.session import local_session

    s = local_session("4", 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def views(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def compare(df, sql: str, sf_dir: str) -> None:
    """Rows of a DataFrame equal those of DuckDB SQL, whatever their order."""
    c = views(sf_dir)
    want = c.sql(sql)
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    got = sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))
    rows = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    assert got == sorted(map(repr, rows))
