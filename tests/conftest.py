import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.fixture(scope="session")
def same():
    """Rows of both frames agree, in any order; doubles to nine digits."""

    def norm(rows):
        return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=repr)

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        ours = norm([tuple(r[c] for c in names) for r in df.collect()])
        theirs = norm(relation.project(", ".join(f'"{c}"' for c in names)).fetchall())
        assert ours == theirs

    return check
