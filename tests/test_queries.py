"""Every registered query against its SQL, over the whole smallest tables."""

import datetime
import os
from collections import Counter

import duckdb
import pytest

from plenumlens.plans import REGISTRY

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value.isoformat() if isinstance(value, datetime.datetime) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = REGISTRY[name].run(spark, SF_DIR)
    got = rows_of(df.columns, df.collect())
    assert sum(got[1].values()) > 0
    relation = con.sql(REGISTRY[name].sql)
    assert got == rows_of(relation.columns, relation.fetchall())


@pytest.mark.parametrize("kind", ["null times", "empty"])
@pytest.mark.parametrize("name", ["str_dedup", "str_notify", "str_quota"])
def test_parts_keep_null_times(spark, tmp_path, name, kind):
    of = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts" if kind == "null times" else "ts"
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr("* except (ts)", of)
    rows.where("true" if kind == "null times" else "false").write.parquet(str(tmp_path / "events.parquet"))
    df = REGISTRY[name].run(spark, str(tmp_path))
    got = rows_of(df.columns, df.collect())
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        relation = connection.sql(REGISTRY[name].sql)
        assert got == rows_of(relation.columns, relation.fetchall())
