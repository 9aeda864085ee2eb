import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(frame, relation):
    """The rows of both, as sorted lists of text, columns by name."""
    import pandas as pd

    a, b = frame.toPandas(), relation.df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)

    def rows(x):
        def cell(v):
            if pd.api.types.is_scalar(v) and pd.isna(v):
                return "null"
            return repr(float(v) + 0.0) if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v)

        return sorted(tuple(cell(v) for v in r) for r in x[columns].astype(object).itertuples(index=False))

    return rows(a) == rows(b)
