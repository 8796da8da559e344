"""Every registered core query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from brineloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.5f}" if v else "0.00000"
    return str(v)


def close(a, b):
    if a == b:
        return True
    try:
        return abs(float(a) - float(b)) <= 2e-5 * max(1, abs(float(a)))
    except ValueError:
        return False


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    sql = registry.oracle_sql().get(name)
    assert sql, "every core query has SQL"
    table = duck.execute(sql).df()
    assert sorted(table.columns) == columns
    theirs = sorted(tuple(shown(v.item() if hasattr(v, "item") else v) for v in r) for r in table[columns].itertuples(index=False, name=None))
    assert len(mine) == len(theirs)
    assert all(close(a, b) for x, y in zip(mine, theirs, strict=True) for a, b in zip(x, y, strict=True))


def test_term_text_does_not_depend_on_parts(spark, tmp_path):
    """Means halfway between two roundings, scattered over parts; null means; small negative terms."""
    db = duckdb.connect(config={"threads": 1})
    db.sql("create table events as select * from '/root/testdata/sf0.1/events.parquet' order by event_id")
    db.sql("insert into events values (200000, timestamp '2024-01-01 10:00:00', -1, 'view', 0.0001, '{}'), (200001, timestamp '2024-01-01 10:00:00', -2, 'view', null, '{}')")
    db.sql(f"copy (select * from events order by hash(event_id)) to '{tmp_path}/plain.parquet'")
    spark.read.parquet(f"{tmp_path}/plain.parquet").repartition(13).write.parquet(f"{tmp_path}/events.parquet")
    want = dict(db.sql(registry.oracle_sql()["scl04_term_text"]).fetchall())
    got = {r["px"]: r["terms"] for r in registry.queries()["scl04_term_text"](spark, str(tmp_path)).collect()}
    assert got == want and want[-1] == "mean=0.0000;cos1=-0.0000" and want[-2] is None
