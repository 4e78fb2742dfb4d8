"""Insert or replace by primary key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.functions.text import cast_or_null
from sqltrail.operators.sizing import scaled_join


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"key column {name} is NULL"))).alias(name)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that is last by `order`, whole, NULLs included; `order` must be unique per key."""
    payload = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_row"))
    return last.select(*keys, "_row.*")


def _as_type(df: DataFrame, name: str, kind: str) -> Column:
    """The column in the table's type; text that does not fit is NULL."""
    return F.col(name) if dict(df.dtypes)[name] == kind else cast_or_null(F.col(name), kind)


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str
) -> DataFrame:
    """`existing` after loading `incoming`, in the columns of `existing`.

    A key that comes in replaces the whole row: columns the input lacks become NULL. Of several input
    rows with one key the last by `order` wins. A NULL key fails the query. Rows that are not replaced
    pass through untouched; they are shuffled only when the incoming keys exceed the broadcast bound.
    """
    keys = list(keys)
    checked = incoming.select(*[_required(c) if c in keys else F.col(c) for c in incoming.columns])
    winners = latest_by_key(checked, keys, order).drop(order)
    kept = scaled_join(existing, incoming.select(*keys).distinct(), keys, "left_anti")
    columns = [
        (_as_type(winners, name, kind) if name in winners.columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in existing.dtypes
    ]
    return kept.select(*existing.columns).unionByName(winners.select(*columns))


def write_upsert(
    path: str, incoming: DataFrame, keys: Sequence[str], order: str, schema=None
) -> str:
    """Upsert into the newest version of the parquet table under `path` and write the next version.

    Versions are sub-folders `v=N`. Readers use the newest one that was written to its end, so a job
    that is lost half-way leaves the table as it was.
    """
    spark = incoming.sparkSession
    version = newest_version(spark, path)
    if version is None:
        if schema is None:
            raise ValueError("the first load needs the schema of the table")
        existing = spark.createDataFrame([], schema)
    else:
        existing = spark.read.parquet(f"{path}/v={version}")
    target = f"{path}/v={0 if version is None else version + 1}"
    upsert(existing, incoming, keys, order).write.mode("overwrite").parquet(target)
    return target


def newest_version(spark, path: str) -> int | None:
    """Highest version under `path` that is complete, or None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    versions = [
        int(status.getPath().getName()[2:])
        for status in fs.listStatus(root)
        if status.getPath().getName().startswith("v=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    ]
    return max(versions, default=None)


def read_table(spark, path: str) -> DataFrame:
    """The newest version of a table written by `write_upsert`."""
    version = newest_version(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v={version}")
