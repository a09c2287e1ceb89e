"""Comparison of a Spark result with DuckDB rows, without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def _text(v) -> str:
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ").split("+")[0]
    return str(v)


def same_rows(frame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    got = sorted("|".join(_text(r[c]) for c in order) for r in frame.collect())
    expected = sorted("|".join(_text(r[names.index(c)]) for c in order) for r in want)
    assert got == expected
    return len(got)
