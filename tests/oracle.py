"""Compares registered queries with their SQL in DuckDB, as sets of rows."""

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(norm(r[k]) for k in order) for r in data)


def differences(spark, sf_dir, name, query, sql, con):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got == want:
        return ""
    return f"{name}: {got[0]} {want[0]} {sum(got[1].values())} {sum(want[1].values())} only spark {list((got[1] - want[1]).items())[:3]} only sql {list((want[1] - got[1]).items())[:3]}"
