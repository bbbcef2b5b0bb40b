import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if v != v else f"{v:.9g}"
        return str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck):
    """Runs a query in both engines and compares all rows."""

    def run(query, sql):
        df = query(spark, DATA)
        columns = sorted(df.columns)
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        want = found.select(*[f'"{c}"' for c in columns]).fetchall()
        assert canonical(df.select(*columns).collect()) == canonical(want)

    return run
