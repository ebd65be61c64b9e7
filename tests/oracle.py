"""Runs a query in Spark and its SQL in DuckDB, and compares rows without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = df.astype(object).where(df.notna(), None).values.tolist()
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not v.is_integer() else int(v) if isinstance(v, float) else v for v in r) for r in out), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    assert a == b
