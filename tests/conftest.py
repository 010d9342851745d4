import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duskveil.session import build_session, ship_package  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session


@pytest.fixture(scope="session")
def against_sql():
    """Compares a query with its oracle over one data folder."""
    import duckdb
    import pandas as pd

    def normal(frame):
        cols = sorted(frame.columns)

        def cell(v):
            if v is None or v is pd.NA or v != v:
                return None
            return f"{v:.6g}" if isinstance(v, float) else str(v)

        return cols, sorted((tuple(map(cell, row)) for row in frame[cols].itertuples(index=False)), key=str)

    def compare(spark, name, query, sql, folder=SMALL):
        con = duckdb.connect()
        for file in os.listdir(folder):
            con.execute(f"create view {file[:-8]} as select * from '{folder}/{file}'")
        assert normal(query(spark, folder).toPandas()) == normal(con.execute(sql).df()), name

    return compare
