"""Spark rows against DuckDB rows, as the driver compares them: columns by name, rows as a bag."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(rows, names, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def check(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    assert bag(df.collect(), df.columns, columns) == bag(cur.fetchall(), names, columns)
