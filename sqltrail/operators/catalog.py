"""The object catalog and the relational catalog: shaping, joins, checks and views."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.constants import CATALOG_KINDS, KNOWN_OBJECT_TYPES, RELATION_TYPES
from sqltrail.functions.text import cast_or_null, nullif_empty
from sqltrail.operators.sizing import fits_broadcast, scaled_join
from sqltrail.schemas import CATALOG_TABLES, TableSpec


# --- object catalog -------------------------------------------------------------------------


def catalog_for_owners(objects: DataFrame, owners: Iterable[str]) -> DataFrame:
    """Objects of the given owners, every type, upper-cased, without repeats.

    The rows are upper-cased before the comparison, `owners` are not.
    """
    upper = objects.select(*[F.upper(c).alias(c) for c in ("owner", "object_type", "object_name")])
    return upper.filter(F.col("owner").isin(*owners)).dropDuplicates()


def catalog_known_types(objects: DataFrame) -> DataFrame:
    """Objects of the known types, upper-cased, without repeats."""
    upper = objects.select(*[F.upper(c).alias(c) for c in ("owner", "object_type", "object_name")])
    return upper.filter(F.col("object_type").isin(*KNOWN_OBJECT_TYPES)).dropDuplicates()


def catalog_relations(
    objects: DataFrame, owner: str | None = None, upper_names: bool = True
) -> DataFrame:
    """Tables, views and materialized views of one owner or, with None, of all."""
    kept = objects.filter(F.upper("object_type").isin(*RELATION_TYPES))
    if owner is not None:
        kept = kept.filter(F.upper("owner") == owner.upper())
    name = F.upper("object_name") if upper_names else F.col("object_name")
    return kept.select("owner", "object_type", name.alias("object_name")).dropDuplicates()


def object_type_of(value: Column) -> Column:
    """The object type itself when known, else NULL."""
    return F.when(value.isin(*KNOWN_OBJECT_TYPES), value)


def catalog_by_type(objects: DataFrame) -> DataFrame:
    """Each object of an owner under its kind and under `all`; types without a kind are only in `all`."""
    kind = F.create_map(*[F.lit(x) for pair in CATALOG_KINDS.items() for x in pair])
    upper = objects.select(*[F.upper(c).alias(c) for c in ("owner", "object_type", "object_name")])
    kinds = F.array_compact(F.array(F.lit("all"), F.try_element_at(kind, F.col("object_type"))))
    return upper.dropDuplicates().select("owner", F.explode(kinds).alias("kind"), "object_type", "object_name")


def catalog_kind_counts(objects: DataFrame) -> DataFrame:
    """Number of objects per owner, one column per kind."""
    kinds = ["all", *CATALOG_KINDS.values()]
    return catalog_by_type(objects).groupBy("owner").pivot("kind", kinds).count().na.fill(0)


def dedup_catalog(objects: DataFrame, identity: Iterable[str] = ("owner", "object_type", "object_name")) -> DataFrame:
    """One row per identity; where an object sits is not part of it."""
    return objects.select(*identity).dropDuplicates()


def object_index(objects: DataFrame, origin: str) -> DataFrame:
    """The index of one origin: a row per (origin, namespace, type) and name.

    Kept as rows, because a namespace may hold most of the objects.
    """
    return dedup_catalog(objects).select(
        F.lit(origin).alias("origin"),
        F.col("owner").alias("namespace"),
        F.col("object_type").alias("type"),
        F.col("object_name").alias("name"),
    )


def index_get(index: DataFrame, origin: str, namespace: str, type: str) -> DataFrame:
    """Names under a key; no rows when the key is absent."""
    return index.filter(_index_key(origin, namespace, type)).select("name")


def index_remove(index: DataFrame, origin: str, namespace: str, type: str) -> DataFrame:
    """The index without a key; an absent key is an error."""
    if index.filter(_index_key(origin, namespace, type)).isEmpty():
        raise KeyError(f"no entry for {(origin, namespace, type)}")
    return index.filter(~_index_key(origin, namespace, type))


def _index_key(origin: str, namespace: str, type: str) -> Column:
    return (F.col("origin") == origin) & (F.col("namespace") == namespace) & (F.col("type") == type)


# --- column mapping of loaded files ---------------------------------------------------------


def map_columns(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    exclude: Iterable[str] = (),
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Drop, rename and, with `types`, cast columns; old names compare without case.

    Names that are not mapped pass through in lower case. A value that does not fit its type is NULL.
    """
    renamed = {old.lower(): new for old, new in (mapping or {}).items()}
    dropped = {name.lower() for name in exclude}
    columns = []
    for name in df.columns:
        if name.lower() in dropped:
            continue
        target = renamed.get(name.lower(), name.lower())
        value = F.col(f"`{name}`")
        if types and target in types:
            value = cast_or_null(value, types[target])
        columns.append(value.alias(target))
    return df.select(*columns)


def empty_to_null(df: DataFrame) -> DataFrame:
    """Empty text becomes NULL in every text column."""
    return df.select(
        *[
            nullif_empty(F.col(f"`{name}`")).alias(name) if kind == "string" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


# --- relational catalog ---------------------------------------------------------------------


def root_domains(domain: DataFrame) -> DataFrame:
    return domain.filter(F.col("parent_code").isNull())


def sub_domains(domain: DataFrame) -> DataFrame:
    return domain.filter(F.col("parent_code").isNotNull())


def _prefixed(df: DataFrame, prefix: str, key: str, columns: Iterable[str]) -> DataFrame:
    return df.select(
        F.col("code").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in columns if c != "code"]
    )


def with_parent(df: DataFrame) -> DataFrame:
    """Adds the parent's name; rows without a parent keep NULL."""
    return scaled_join(df, _prefixed(df, "parent", "parent_code", ["name"]), ["parent_code"], "left")


def catalog_wide(
    code_object: DataFrame,
    object_type: DataFrame,
    component: DataFrame,
    component_type: DataFrame,
    domain: DataFrame,
) -> DataFrame:
    """Code objects with their type, component, component type and domain; missing ends are NULL."""
    wide = scaled_join(
        code_object, _prefixed(object_type, "object_type", "type_code", ["name"]), ["type_code"], "left"
    )
    parts = _prefixed(component, "component", "component_code", ["name", "domain_code", "type_code"])
    wide = scaled_join(wide, parts, ["component_code"], "left")
    kinds = _prefixed(component_type, "component_type", "component_type_code", ["name"])
    wide = scaled_join(wide, kinds, ["component_type_code"], "left")
    return scaled_join(
        wide, _prefixed(domain, "domain", "component_domain_code", ["name"]), ["component_domain_code"], "left"
    )


def edges_named(edges: DataFrame, code_object: DataFrame) -> DataFrame:
    """Edges whose two ends are code objects, with the names and types of both."""
    columns = ["name", "type_code"]
    # Both ends look up the same table, which is measured once.
    fits = fits_broadcast(code_object.select("code", *columns))
    starts = scaled_join(edges, _prefixed(code_object, "from", "from_code", columns), ["from_code"], fits=fits)
    return scaled_join(starts, _prefixed(code_object, "to", "to_code", columns), ["to_code"], fits=fits)


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "code", fits: bool | None = None) -> DataFrame:
    """Rows whose foreign key is set and has no parent. `fits` passes on a measurement of the parent's keys."""
    keys = parent.select(F.col(parent_key).alias(fk)).distinct()
    return scaled_join(child.filter(F.col(fk).isNotNull()), keys, [fk], "left_anti", fits=fits)


def fk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign-key values without a parent and their row counts, for every declared key of `tables`."""
    found = []
    # A parent of several keys is measured once.
    fits: dict[tuple[str, str], bool] = {}
    for name, spec in CATALOG_TABLES.items():
        for fk, parent, parent_key in spec.foreign_keys:
            if name in tables and parent in tables and fk in tables[name].columns:
                # Counting per value first leaves one row per value to look up.
                values = tables[name].groupBy(fk).agg(F.count(F.lit(1)).alias("row_count"))
                if (parent, parent_key) not in fits:
                    fits[parent, parent_key] = fits_broadcast(tables[parent].select(parent_key).distinct())
                lost = orphans(values, fk, tables[parent], parent_key, fits[parent, parent_key])
                found.append(
                    lost.select(
                        F.lit(name).alias("child_table"),
                        F.lit(fk).alias("fk_column"),
                        F.col(fk).alias("missing_key"),
                        "row_count",
                    )
                )
    result = found[0]
    for other in found[1:]:
        result = result.unionByName(other)
    return result


def constraint_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Broken constraints of one table: NULLs in required columns, and repeated keys.

    `violations` counts rows with the NULL, or rows beyond the first of their key.
    """
    required = [c for c in spec.required if c in df.columns]
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required]).unpivot(
        [], required, "constraint_name", "violations"
    )
    nulls = nulls.select(
        F.lit(spec.name).alias("table_name"),
        F.concat(F.lit("not_null:"), "constraint_name").alias("constraint_name"),
        "violations",
    )
    repeats = (
        df.groupBy(*spec.key)
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"))
        .select(
            F.lit(spec.name).alias("table_name"),
            F.lit("primary_key:" + ",".join(spec.key)).alias("constraint_name"),
            "violations",
        )
    )
    return nulls.unionByName(repeats)


def register_catalog(spark: SparkSession, folder: str | None = None) -> None:
    """Create the catalog tables as temporary views, from parquet under `folder` or empty, and two views."""
    for name, spec in CATALOG_TABLES.items():
        if folder is None:
            df = spark.createDataFrame([], spec.schema)
        else:
            df = spark.read.schema(spec.schema).parquet(f"{folder}/{name}")
        df.createOrReplaceTempView(name)
    root_domains(spark.table("domain")).createOrReplaceTempView("vw_domain")
    sub_domains(spark.table("domain")).createOrReplaceTempView("vw_subdomain")


def drop_catalog(spark: SparkSession) -> None:
    for name in ("vw_domain", "vw_subdomain", *CATALOG_TABLES):
        spark.catalog.dropTempView(name)
