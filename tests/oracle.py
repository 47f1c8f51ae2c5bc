"""Rows of a Spark query and of its SQL, made comparable."""

import glob
import math

import duckdb


def sql_rows(sf, sql):
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if glob.glob(path + '/*') else ''}'")
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def comparable(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    one = lambda x: None if x is None else round(float(x), 5) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    nan = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(nan(one(r[k])) for k in order) for r in rows), key=repr)
