"""Rows of a Spark query and of its SQL, as comparable values."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float | Decimal):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    return tuple(map(value, x)) if isinstance(x, list | tuple) else x


def spark_rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql, sf_dir):
    with duckdb.connect() as con:
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        at = [names.index(c) for c in sorted(names)]
        return sorted(names), sorted((tuple(value(r[k]) for k in at) for r in found.fetchall()), key=repr)
