"""Compare a Spark result with a DuckDB result: names, row count and values in any row order."""

import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def differences(df, con, sql):
    """An empty list when both agree, else what differs."""
    cur = con.execute(sql)
    theirs_names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    ours = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(theirs_names):
        return [f"columns {sorted(df.columns)} / {sorted(theirs_names)}"]
    if len(ours) != len(theirs):
        return [f"rows {len(ours)} / {len(theirs)}"]
    a, b = rows_of(df.columns, ours), rows_of(theirs_names, theirs)
    bad = [f"{x} / {y}" for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    return bad[:5] + ([f"... {len(bad)} rows"] if bad else [])
