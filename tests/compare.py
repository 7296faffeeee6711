"""Spark rows against DuckDB rows of the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].map(lambda v: tuple(v) if hasattr(v, "__iter__") and not isinstance(v, str) else v)
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(tuple, frame.values.tolist()), key=repr)


def oracle(sql, folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c.sql(sql).df()
