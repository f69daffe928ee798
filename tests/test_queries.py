"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

ORACLES = {k: v for k, v in __spark_entry__.oracle_sql().items() if k.startswith(("q_", "x_"))}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck, sf_dir):
    rows = __spark_entry__.queries()[name](spark, sf_dir)
    names = sorted(rows.columns)
    got = sorted(map(repr, (tuple(r[c] for c in names) for r in rows.collect())))
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == names
    order = [relation.columns.index(c) for c in names]
    assert got == sorted(map(repr, (tuple(r[i] for i in order) for r in relation.fetchall())))


def test_every_query_has_a_name_and_entry_runs(spark):
    assert len(ORACLES) > 80
    assert __spark_entry__.entry(spark).count() > 0
