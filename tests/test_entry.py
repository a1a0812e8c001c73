import os

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    from quire.plans.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    text = lambda rows: sorted(str(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)
    for name, sql in ORACLE_SQL.items():
        found = QUERIES[name](spark, DATA)
        columns = sorted(found.columns)
        wanted = db.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({sql})").fetchall()
        assert text(tuple(r) for r in found.select(*columns).collect()) == text(wanted), name
    assert contract.entry(spark).count() > 0
