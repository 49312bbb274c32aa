import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


def duck(folder):
    """DuckDB with the tables of a folder as views."""
    import duckdb

    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def same_rows(df, oracle_rows, names):
    """Both sides as sorted rows of text, floats to six places."""

    def shown(v):
        if isinstance(v, float):
            return f"{v:.6f}".replace("-0.000000", "0.000000")
        return repr(list(v)) if isinstance(v, (list, tuple)) else repr(v)

    order = sorted(names)
    ours = sorted([tuple(shown(r[n]) for n in order) for r in df.collect()])
    theirs = sorted([tuple(shown(r[names.index(n)]) for n in order) for r in oracle_rows])
    assert sorted(df.columns) == order
    assert ours == theirs
