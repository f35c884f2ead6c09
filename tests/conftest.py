import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same_rows():
    """Compare a DataFrame with a DuckDB query on the tables of a folder, values to six places, order aside."""
    import duckdb

    def norm(v):
        if isinstance(v, float):
            return None if v != v else round(v, 6) + 0.0
        return v

    def check(df, sql, folder):
        con = duckdb.connect()
        for f in Path(folder).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        got = con.sql(sql)
        names = sorted(got.columns)
        assert sorted(df.columns) == names
        at = [got.columns.index(n) for n in names]
        want = sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=repr)
        have = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
        assert have == want

    return check
