"""Every query over the driver's tables against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from lattisect import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    plain = lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    return sorted(repr(tuple(plain(x.item() if hasattr(x, "item") else x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLES:
        assert rows(got) == rows(duck.execute(queries.ORACLES[name]).df())
    else:
        assert len(got)
