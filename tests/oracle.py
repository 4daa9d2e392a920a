"""Compare a query's rows with those of its DuckDB SQL."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _plain(v):
    if isinstance(v, (list, dict)):
        return v
    if pd.isna(v):
        return None
    if "bool" in str(type(v)):
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v


def rows(frame, names):
    return sorted(repr(tuple(map(_plain, r))) for r in frame[names].astype(object).itertuples(index=False))


def check(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = df.toPandas(), con.sql(sql).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want, names)
