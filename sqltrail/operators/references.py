"""Source lines to references: literals, tokens, operations and the join with the catalog."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltrail.constants import CODE_MAP_TYPES, RELATION_TYPES
from sqltrail.functions import text as X
from sqltrail.operators import sizing
from sqltrail.operators.sizing import scaled_join
from sqltrail.schemas import CODE_REFS


def to_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line of each file, numbered from 1 and stripped; replaces `content`."""
    keep = [c for c in files.columns if c != content]
    split = F.split(X.normalize_newlines(F.col(content)), "\n", -1)
    return files.select(*keep, F.posexplode(split).alias("_pos", "_line")).select(
        *keep,
        (F.col("_pos") + 1).alias("line_number"),
        X.py_strip(F.col("_line")).alias("line"),
    )


def where_owner(df: DataFrame, owners: Iterable[str] | None) -> DataFrame:
    """Keep the owners asked for; None keeps all."""
    return df if owners is None else df.filter(F.col("owner").isin(*owners))


def where_type(df: DataFrame, types: Iterable[str] | None) -> DataFrame:
    """Keep the object types asked for; None keeps all."""
    return df if types is None else df.filter(F.upper("object_type").isin(*types))


def literals(lines: DataFrame, extractors: dict[str, X.Extractor] | None = None) -> DataFrame:
    """One row per literal of each line; `literal_number` counts from 1 within the line."""
    found = X.literals_for_ext(F.col("line"), F.col("ext"), extractors)
    return lines.select("*", F.posexplode(found).alias("_pos", "literal")).select(
        *lines.columns, (F.col("_pos") + 1).alias("literal_number"), "literal"
    )


def operation_tokens(
    lines: DataFrame,
    extractors: dict[str, X.Extractor] | None = None,
    strict: bool = False,
) -> DataFrame:
    """One row per upper-cased token of each literal, with the operation that holds at it.

    The operation carries on from the last keyword of the same literal. Cutting the literal into
    stretches before each keyword makes it a property of the stretch: no window and no shuffle.
    """
    found = X.literals_for_ext(F.col("line"), F.col("ext"), extractors)
    cut = F.flatten(F.transform(found, lambda literal: X.stretches(literal, strict)))
    return (
        lines.select("*", F.explode(cut).alias("_stretch"))
        .select(
            *lines.columns,
            X.stretch_operation(F.col("_stretch")).alias("operation"),
            F.explode(X.stretch_tokens(F.col("_stretch"))).alias("token"),
        )
    )


def map_references(
    lines: DataFrame,
    catalog: DataFrame,
    types: Iterable[str] | None = CODE_MAP_TYPES,
    owners: Iterable[str] | None = None,
    extractors: dict[str, X.Extractor] | None = None,
    with_operation: bool = True,
    strict: bool = False,
    fits: bool | None = None,
) -> DataFrame:
    """Every catalog object whose name is a token of a literal.

    One row per object and token occurrence: repeated tokens repeat, and a name that several owners
    have gives a row for each. One pass over the lines; they are not shuffled while the catalog is
    within the broadcast bound. Beyond it, tokens that a Bloom filter of the names lets pass meet them in a
    plain shuffle join; the others are not shuffled. `fits` says whether the names are within the bound, where
    that is known.
    """
    names = (
        where_type(where_owner(catalog, owners), types)
        .filter(F.col("object_name") != "")
        .select("owner", "object_type", "object_name")
        .dropDuplicates()
    )
    found = operation_tokens(lines, extractors, strict).withColumnRenamed("token", "object_name")
    if not with_operation:
        found = found.withColumn("operation", F.lit(""))
    hits = scaled_join(found, names, ["object_name"], fits=sizing.fits_broadcast(names) if fits is None else fits, few_match=True)
    return hits.withColumn("valid", F.lit("")).select(*CODE_REFS.fieldNames())


def keep_known(
    df: DataFrame, catalog: DataFrame, name: str = "table_name", upper_names: bool = True
) -> DataFrame:
    """Rows whose name the catalog has. Without `upper_names`, lower-case catalog rows never match."""
    known = F.upper("object_name") if upper_names else F.col("object_name")
    return scaled_join(df, catalog.select(known.alias(name)).distinct(), [name], "left_semi", few_match=True)


def resolve_in_owner(
    df: DataFrame, catalog: DataFrame, owner: str, name: str = "table_name"
) -> DataFrame:
    """Type of the named object of one owner; a table wins over a view, a view over a materialized one.

    The winner is picked on the catalog side, once per name, so the rows looked up are not grouped.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in RELATION_TYPES]), F.upper("object_type"))
    best = (
        where_type(where_owner(catalog, [owner]), RELATION_TYPES)
        .groupBy(F.upper("object_name").alias(name))
        .agg(F.element_at(F.array(*[F.lit(t) for t in RELATION_TYPES]), F.min(rank).cast("int")).alias("object_type"))
    )
    return scaled_join(df, best, [name], few_match=True).withColumn("owner", F.lit(owner))
