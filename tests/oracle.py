"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark, name, query, sql, sf_dir, con):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{name}: {len(got)} and {len(want)} rows; only here {a}; only there {b}"
    return None if want else f"{name}: no rows"


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
