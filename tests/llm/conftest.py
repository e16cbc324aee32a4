import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{path}')")
    return con


@pytest.fixture()
def tables(tmp_path):
    """Writes tables for a query or a pipeline: a folder with name.parquet."""

    def write(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
