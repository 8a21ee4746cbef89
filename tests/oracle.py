"""Runs a query's SQL in DuckDB over the same tables and compares rows as multisets."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, columns):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 9) if isinstance(v, float) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


def assert_same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a, b = rows_of(got, columns), rows_of(want, columns)
    a, b = [x.replace("True", "1").replace("False", "0") for x in a], [x.replace("True", "1").replace("False", "0") for x in b]
    assert len(a) == len(b)
    assert a == b or [eval_close(x, y) for x, y in zip(a, b)].count(False) == 0


def eval_close(x, y):
    import numpy as np  # noqa: F401

    p, q = eval(x), eval(y)  # noqa: S307
    return all(u == v or (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) < 1e-8) for u, v in zip(p, q))
