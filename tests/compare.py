"""Results of Spark and of DuckDB as comparable lists."""

import decimal
from pathlib import Path


def views(con, root):
    for p in sorted(Path(root).iterdir()):
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, float | decimal.Decimal):
        return None if v != v else round(float(v), 6)
    return v


def spark_rows(df):
    order = sorted(df.columns)
    return order, sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
