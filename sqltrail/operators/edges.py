"""Lineage edges between code objects and database objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.constants import RELATIONSHIPS
from sqltrail.schemas import CATALOG_TABLES

NARROW_KEY = ("from_code", "to_code")
WIDE_KEY = ("from_code", "to_code", "map_type", "file_path", "file_name", "line_number")


def refs_to_edges(refs: DataFrame) -> DataFrame:
    """One `map` row per hit with an operation: file -> owner.object, read or modify."""
    relation = F.when(F.col("operation") == "R", "read").when(F.col("operation") == "M", "modify")
    return refs.filter(relation.isNotNull()).select(
        F.concat_ws("/", "repo_name", "file_path", "file_name").alias("from_code"),
        F.concat_ws(".", "owner", "object_name").alias("to_code"),
        relation.alias("map_type"),
        F.col("operation").alias("db_operation"),
        F.col("line").alias("line_text"),
        "line_number",
        "file_path",
        "file_name",
    )


def build_edges(edges: DataFrame, key: Sequence[str] = NARROW_KEY) -> DataFrame:
    """One edge per key, the last by file and line, in the layout of the `map` table.

    With the narrow key a read and a change of the same pair collapse into the later one; the wide
    key keeps both. Each task reduces its own rows before the shuffle, so a hot pair stays small.
    """
    columns = [f.name for f in CATALOG_TABLES["map"].schema.fields]
    order = [c for c in ("file_path", "file_name", "line_number", "db_operation", "line_text") if c in edges.columns]
    payload = [c for c in edges.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order])
    last = (
        edges.groupBy(*key)
        .agg(F.max_by(F.struct(*payload), rank).alias("_row") if payload else F.lit(None).alias("_row"))
        .select(*key, *([f"_row.*"] if payload else []))
    )
    kinds = {f.name: f.dataType for f in CATALOG_TABLES["map"].schema.fields}
    return last.select(
        *[
            (F.col(c) if c in last.columns else F.lit(None)).cast(kinds[c]).alias(c)
            for c in columns
        ]
    )


def bad_relationships(edges: DataFrame) -> DataFrame:
    """Edges whose kind is not one of the known relationships."""
    return edges.filter(~F.col("map_type").isin(*RELATIONSHIPS) | F.col("map_type").isNull())
