"""Run registered queries in Spark and in DuckDB and compare the rows as multisets."""

from __future__ import annotations

import math
import time
from collections import Counter

import duckdb

from sqltrail.plans.inputs import TABLES


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


# Spark type by the other engine's type.
TYPES = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double"}


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, connection, name, plan, sql, sf_dir):
    """(problem or None, Spark rows, seconds)."""
    start = time.time()
    df = plan(spark, sf_dir)
    found = df.collect()
    seconds = time.time() - start
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(found), seconds
    types = {d[0]: TYPES.get(str(d[1]).upper(), str(d[1])) for d in cursor.description}
    if types != dict(df.dtypes):
        wrong = {c: (t, types[c]) for c, t in df.dtypes if types[c] != t}
        return f"types {wrong}", len(found), seconds
    left, right = _rows(found, df.columns), _rows(wanted, columns)
    if left != right:
        extra, missing = left - right, right - left
        return f"rows {len(found)} != {len(wanted)}: extra {list(extra)[:2]} missing {list(missing)[:2]}", len(found), seconds
    return None, len(found), seconds
