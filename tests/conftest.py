import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(duck):
    import math
    import numbers

    import pandas as pd

    def normal(df):
        df = df[sorted(df.columns)]
        show = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)
        return sorted((tuple(map(show, r)) for r in df.itertuples(index=False)), key=repr)

    def check(frame, sql):
        one, two = frame.toPandas(), duck.sql(sql).df()
        assert sorted(one.columns) == sorted(two.columns)
        assert normal(one) == normal(two)

    return check
