import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("opsloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
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
    for file in Path(SF).iterdir():
        name = file.name.split(".")[0]
        source = f"{file}/*.parquet" if file.is_dir() else str(file)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


@pytest.fixture(scope="session")
def same():
    import pandas as pd

    def lines(rows):
        rows = rows[sorted(rows.columns)].astype(object)
        return sorted("|".join("NULL" if not isinstance(v, (list, dict)) and pd.isna(v) else str(v) for v in r) for r in rows.values.tolist())

    def check(found, wanted):
        assert sorted(found.columns) == sorted(wanted.columns)
        # whole numbers with nulls come as doubles from Spark
        found = found.astype({c: "Int64" for c in found if str(wanted[c].dtype) == "Int64"})
        assert lines(found) == lines(wanted)

    return check
