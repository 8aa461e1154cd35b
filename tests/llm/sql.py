"""Compare a registered query with its SQL over the smallest tables."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    from panelwright.llm.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{file}'")
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(str, result.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want
