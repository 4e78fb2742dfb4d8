"""Tables whose rows are kept by buckets of their keys, so that a load writes only the buckets it touches.

A folder holds `<table>/<load>/bucket=N` with rows, and `versions/v=N` with the manifest of a version: which folder
is which bucket of which table. A version is there once its manifest is written to its end; it covers all tables
of the folder, so readers see all tables of a load or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqltrail.operators.upsert import newest_version, upsert

#: Buckets of a new table; a table keeps the number it began with.
BUCKETS = 64
MANIFEST = "table_name string, buckets int, bucket int, path string"


@dataclass(frozen=True)
class Load:
    """Rows that come into one table; of several rows with one key the last by `order` wins."""

    incoming: DataFrame
    keys: Sequence[str]
    order: str
    schema: T.StructType


def _manifest(spark: SparkSession, folder: str, version: int | None) -> list[T.Row]:
    """The manifest's rows: one for each bucket of each table."""
    if version is None:
        return []
    return spark.read.schema(MANIFEST).parquet(f"{folder}/versions/v={version}").collect()


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _rows(spark: SparkSession, schema: T.StructType, places: Sequence[T.Row]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[place["path"] for place in places])


def stage(folder: str, name: str, load: Load, places: Sequence[T.Row], buckets: int = BUCKETS) -> list[tuple]:
    """Write the buckets of one table that `load` changes, aside; returns the manifest rows of the table after it.

    `places` are its rows in the manifest before. Files of other buckets are neither read nor written. The rows of
    a bucket may be in several files: adaptive execution cuts a large one.
    """
    spark = load.incoming.sparkSession
    buckets = places[0]["buckets"] if places else buckets
    # Keys in the table's types, as 1 and '1' have different hashes.
    incoming = load.incoming.withColumns({k: F.col(k).cast(load.schema[k].dataType) for k in load.keys})
    # At most one row for each bucket.
    touched = {row["bucket"] for row in incoming.select(_bucket(load.keys, buckets).alias("bucket")).distinct().collect()}
    if not touched:
        return [tuple(place) for place in places]
    changed = upsert(_rows(spark, load.schema, [p for p in places if p["bucket"] in touched]), incoming, load.keys, load.order)
    target = f"{folder}/{name}/{uuid.uuid4().hex}"
    changed.withColumn("bucket", _bucket(load.keys, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(target)
    kept = [tuple(place) for place in places if place["bucket"] not in touched]
    return kept + [(name, buckets, bucket, f"{target}/bucket={bucket}") for bucket in sorted(touched)]


def publish(spark: SparkSession, folder: str, version: int, rows: Sequence[tuple]) -> None:
    """Write the manifest of `version`; fails if another load has written it."""
    spark.createDataFrame(list(rows), MANIFEST).coalesce(1).write.mode("error").parquet(f"{folder}/versions/v={version}")


def load_tables(spark: SparkSession, folder: str, loads: Mapping[str, Load], buckets: int = BUCKETS, check=None) -> int:
    """Load several tables and publish them together; returns the version.

    Tables are independent of each other and are written at once. `check`, called with a reader of the tables as
    they would be (table name and schema to rows), may raise; then, as after a lost job, all tables stay as they were.
    A NULL key fails the load. A table without rows has no place in the manifest. A column of a table cannot be
    called `bucket`.
    """
    before = newest_version(spark, f"{folder}/versions")
    places = _manifest(spark, folder, before)
    of = lambda name, rows: [row for row in rows if row["table_name"] == name]
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(loads)))) as pool:
        staged = pool.map(lambda item: stage(folder, item[0], item[1], of(item[0], places), buckets), loads.items())
        after = [tuple(row) for row in places if row["table_name"] not in loads] + [row for rows in staged for row in rows]
    if check is not None:
        names = [field.split(" ")[0] for field in MANIFEST.split(", ")]
        listed = [T.Row(*names)(*row) for row in after]
        check(lambda name, schema: _rows(spark, schema, of(name, listed)))
    version = 0 if before is None else before + 1
    publish(spark, folder, version, after)
    return version


def read_bucketed(spark: SparkSession, folder: str, name: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a table in the newest version, or in `version`; no rows if it was never loaded."""
    version = newest_version(spark, f"{folder}/versions") if version is None else version
    return _rows(spark, schema, [row for row in _manifest(spark, folder, version) if row["table_name"] == name])


def remove_old(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete what only versions before the last `keep` name; returns the deleted folders.

    Only buckets that some manifest names are looked at, so a load that is still running keeps its files.
    """
    newest = newest_version(spark, f"{folder}/versions")
    if newest is None or newest < keep:
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda text: jvm.org.apache.hadoop.fs.Path(text)
    fs = path(folder).getFileSystem(conf)
    current = {row["path"] for v in range(newest - keep + 1, newest + 1) for row in _manifest(spark, folder, v)}
    deleted = []
    for version in range(newest - keep + 1):
        manifest = f"{folder}/versions/v={version}"
        if not fs.exists(path(manifest)):
            continue
        for old in {row["path"] for row in _manifest(spark, folder, version)} - current:
            if fs.delete(path(old), True):
                deleted.append(old)
        # Last, so that a lost run finds the rest again.
        fs.delete(path(manifest), True)
    return sorted(deleted)
