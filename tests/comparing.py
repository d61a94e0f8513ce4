"""Run a query and its SQL twin on the same files and compare all values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def connect(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(connection, sql):
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    return table(columns, cursor.fetchall())


FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def types_differ(df, connection, sql):
    duck = {r[0]: r[1] for r in connection.execute(f"DESCRIBE {sql}").fetchall()}
    return {c: (t, duck.get(c)) for c, t in df.dtypes if FAMILIES.get(t, t) != duck.get(c)}
