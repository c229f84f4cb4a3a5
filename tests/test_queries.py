"""Every query against its SQL, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

from tripleloom.queries import Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RANDOM = {"fn_uuid", "fn_math_randomNumber", "fn_date_now"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.keys() - RANDOM))
def test_query_equals_its_sql(spark, sf, db, name):
    df = Q[name](spark, sf)
    cols = sorted(df.columns)
    cursor = db.execute(Q[name].sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cursor.fetchall())
    assert want, "an empty result shows nothing"
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(RANDOM))
def test_random_queries_give_a_row_each(spark, sf, name):
    rows = Q[name](spark, sf).collect()
    source = "orders" if name == "fn_date_now" else "part"
    assert len({r.s for r in rows}) == len(rows) == spark.read.parquet(f"{sf}/{source}.parquet").count()
    if name == "fn_math_randomNumber":
        assert all(1 <= float(r.o.strip('"')) <= 9 for r in rows)
