"""Runs a query and its SQL on the same tables and compares rows and values."""

import math
from pathlib import Path

import duckdb


def database(folder):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    mine = df.collect()
    rel = con.sql(sql)
    theirs = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns), (df.columns, rel.columns)
    a, b = rows(df.columns, mine), rows(rel.columns, theirs)
    assert len(a) == len(b), (len(a), len(b), [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
    return len(a)
