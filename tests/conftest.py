from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """compare(query, sql, sf_dir): rows and names of Spark's and DuckDB's results agree."""
    import duckdb

    def text(v):
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    def rows(names, data):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in data)

    def run(query, sql, sf_dir):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = con.execute(sql)
        df = query(spark, sf_dir)
        assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())

    return run
