from __future__ import annotations

import os
import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def _plain(v):
    return Decimal(repr(v)).normalize() if isinstance(v, float) else v.normalize() if isinstance(v, Decimal) else Decimal(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture
def same(spark, sf_dir, duck):
    """Runs a query and its SQL, and compares columns and the multiset of rows."""

    def check(query, sql):
        found = query(spark, sf_dir)
        cursor = duck.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(found.columns) == sorted(names)
        order = sorted(names)
        ours = Counter(tuple(_plain(r[n]) for n in order) for r in found.collect())
        theirs = Counter(tuple(_plain(r[names.index(n)]) for n in order) for r in cursor.fetchall())
        assert ours, "no rows"
        assert not (ours - theirs) and not (theirs - ours), (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])

    return check
