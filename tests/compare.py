"""Order-insensitive comparison of a query's rows with those of its SQL in DuckDB."""

import os

import duckdb


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def check(spark, sf, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{name}')")
    mine, theirs = _norm(query(spark, sf).toPandas()), _norm(con.execute(sql).df())
    assert list(mine.columns) == list(theirs.columns)
    assert len(mine) == len(theirs)
    assert mine.equals(theirs), mine.compare(theirs).head()
