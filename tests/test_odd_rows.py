"""Queries against their SQL twins on tables with large keys, nulls and values next to a half."""

import shutil

import duckdb
import pytest

from sparkloom.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

#: Table: its rows here, made from those of DIR.
ODD = {
    "lineitem": "SELECT * FROM t UNION ALL SELECT * REPLACE (l_partkey + 3000000 AS l_partkey, l_suppkey + 2000000 AS l_suppkey) FROM t UNION ALL SELECT * REPLACE (l_orderkey + 5000000 AS l_orderkey) FROM t",
    "events": "SELECT * FROM t UNION ALL SELECT * REPLACE (-1 - event_id AS event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS ts) FROM t UNION ALL SELECT * REPLACE (NULL AS event_id) FROM t",
    "orders": "SELECT * FROM t UNION ALL SELECT * REPLACE (o_orderkey + 1000000 AS o_orderkey, 258000.5 + o_orderkey AS o_totalprice) FROM t",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    for t in TABLES:
        if t in ODD:
            c.sql(f"COPY (WITH t AS (SELECT * FROM '{DIR}/{t}.parquet') {ODD[t]}) TO '{d}/{t}.parquet' (FORMAT parquet)")
        else:
            shutil.copy(f"{DIR}/{t}.parquet", d)
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["dat_stamps", "stm_quota_check", "str_compact_number", "src_chat_streams"])
def test_same_rows(spark, odd, name):
    d, c = odd
    df = registry.queries()[name](spark, d)
    want = c.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    at = [want.columns.index(x) for x in columns]
    got = sorted(tuple(str(r[x]) for x in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["dat_stamps", "stm_quota_check"])
@pytest.mark.parametrize("years", [-80, 9000])
def test_far_times(spark, tmp_path, name, years):
    c = duckdb.connect()
    c.sql(f"COPY (SELECT * REPLACE (ts + INTERVAL '{years} years' AS ts) FROM '{DIR}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(registry.oracle_sql()[name])
    at = [want.columns.index(x) for x in df.columns]
    assert sorted(tuple(map(str, r)) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
