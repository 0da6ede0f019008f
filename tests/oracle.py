"""Runs a registered query and its SQL over the same folder."""

import math
import os


def duck(folder):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        path = f"{folder}/{t}"
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def compare(spark, connection, folder, f, sql):
    df = f(spark, folder)
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert ours == theirs
