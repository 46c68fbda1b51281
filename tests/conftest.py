import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.master": "local[4]",
        "spark.driver.memory": "6g",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Asserts that a query and its SQL give the same rows at the smallest scale."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    queries, sql = entry.queries(), entry.oracle_sql()

    def same(name):
        ours, theirs = queries[name](spark, SF).toPandas(), con.sql(sql[name]).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)

        def plain(x):
            x = x[columns].copy()
            for c in columns:
                if x[c].dtype.kind == "f" and (x[c].dropna() % 1 == 0).all():  # whole numbers with nulls among them
                    x[c] = x[c].astype("Int64")
                elif x[c].dtype.kind == "f":
                    x[c] = x[c].round(6)
            return x.astype(str).sort_values(columns).reset_index(drop=True)

        assert plain(ours).equals(plain(theirs)), name

    return same
