"""Compares a query with its SQL, without regard to order."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df)].copy()
    for k in df:
        if str(df[k].dtype).lower().startswith(("int", "uint", "float")):
            df[k] = df[k].astype(float).round(6)
        elif df[k].map(lambda v: isinstance(v, (list, np.ndarray))).any():
            df[k] = df[k].map(lambda v: str(list(v)))
    df = df.astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"})
    return df.sort_values(list(df)).reset_index(drop=True)


def same(spark_df, sql, connection):
    got, want = plain(spark_df.toPandas()), plain(connection.execute(sql).df())
    assert list(got) == list(want)
    assert len(got) == len(want)
    differs = ~(got == want).all(axis=1)
    assert not differs.any(), f"\n{got[differs].head(3)}\n{want[differs].head(3)}"
