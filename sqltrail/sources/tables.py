"""Object lists, mapped CSV files and load plans."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.operators.catalog import catalog_for_owners, catalog_known_types, catalog_relations
from sqltrail.operators.catalog import constraint_report, empty_to_null, fk_orphans, map_columns
from sqltrail.operators.upsert import write_upsert
from sqltrail.schemas import CATALOG_TABLES, TableSpec
from sqltrail.sources.buckets import BUCKETS, Load, load_tables


def read_object_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """OWNER, OBJECT_TYPE and OBJECT_NAME of a CSV with a heading row; other columns are not read.

    With `multi_line`, quoted fields may hold line ends, and a file is read by one task; without, large
    files that hold none are read in parts.
    """
    raw = spark.read.options(header=True, escape='"', multiLine=multi_line, encoding="utf-8").csv(path)
    return raw.select(
        F.col("OWNER").alias("owner"),
        F.col("OBJECT_TYPE").alias("object_type"),
        F.col("OBJECT_NAME").alias("object_name"),
    )


def read_catalog(
    spark: SparkSession,
    path: str,
    owners: Iterable[str] | None = None,
    mode: str = "owners",
    owner: str | None = None,
    upper_names: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """The catalog of an object list.

    `owners` keeps the listed owners and every type, `known_types` the known types of all owners,
    `relations` the tables and views of one owner or all.
    """
    objects = read_object_list(spark, path, multi_line)
    if mode == "owners":
        return catalog_for_owners(objects, owners or ())
    if mode == "known_types":
        return catalog_known_types(objects)
    if mode == "relations":
        return catalog_relations(objects, owner, upper_names)
    raise ValueError(f"unknown mode {mode}")


@dataclass(frozen=True)
class CsvInfo:
    """One file to load: where it is, how it is written, and where its columns go.

    `multi_line` allows line ends in quoted fields; such a file is read by one task.
    """

    csv_file: str
    table_name: str
    separator: str = ";"
    has_header: bool = True
    column_order: Sequence[str] | None = None
    exclude_columns: Sequence[str] = ()
    column_mapping: Mapping[str, str] = field(default_factory=dict)
    multi_line: bool = True


def read_mapped_csv(spark: SparkSession, info: CsvInfo, order: str | None = None) -> DataFrame:
    """The mapped columns of one file as text, empty text as NULL.

    With `order`, adds a column that rises with the position in the file: by block of the file, then
    by row within the block. A folder of files has no such order and is refused.
    """
    reader = spark.read.options(
        sep=info.separator, header=info.has_header, escape='"', encoding="utf-8", emptyValue="",
        enforceSchema=False, multiLine=info.multi_line,
    )
    raw = reader.csv(info.csv_file)
    if not info.has_header:
        if not info.column_order:
            raise ValueError("a file without a heading row needs column_order")
        raw = raw.toDF(*info.column_order)
    mapped = empty_to_null(map_columns(raw, info.column_mapping, info.exclude_columns))
    if order is None:
        return mapped
    if len(raw.inputFiles()) != 1:
        raise ValueError("row order needs a single file")
    # The block start is where this task began reading; rows of one block are numbered in order.
    positions = F.struct(
        F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return mapped.withColumn(order, positions)


def _spec(info: CsvInfo) -> TableSpec:
    name = info.table_name.lower().removeprefix("tb_")
    if name not in CATALOG_TABLES:
        raise ValueError(f"unknown table {info.table_name}")
    return CATALOG_TABLES[name]


def _refuse_nulls(info: CsvInfo, incoming: DataFrame) -> None:
    spec = _spec(info)
    missing = [c for c in spec.required if c not in incoming.columns]
    if missing:
        raise ValueError(f"{info.csv_file}: no column {', '.join(missing)}")
    report = constraint_report(incoming, spec)
    broken = report.filter(F.col("constraint_name").startswith("not_null") & (F.col("violations") > 0)).collect()
    if broken:
        raise ValueError(f"{info.csv_file}: " + ", ".join(row["constraint_name"] for row in broken))


_PLAN_KEYS = {"csv_file", "table_name", "separator", "has_header", "column_order", "exclude_columns", "column_mapping", "multi_line"}


def read_plan(text: str, folder: str = "") -> list[CsvInfo]:
    """The files of a load plan, a JSON text or, where the `yaml` module is there, a YAML text.

    `csv_files_info` lists the files. A column is mapped to a name, or to `name` and `type`; the type is that of the
    table. Relative file names are below `folder`. Other settings of the plan, such as where a database is, are ignored;
    unknown settings of a file are refused.
    """
    try:
        plan = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError("the plan is no JSON, and YAML cannot be read here") from missing
        plan = yaml.safe_load(text)
    if not isinstance(plan, dict) or not isinstance(plan.get("csv_files_info"), list):
        raise ValueError("a load plan lists its files in csv_files_info")
    infos = []
    for item in plan["csv_files_info"]:
        unknown = set(item) - _PLAN_KEYS
        if unknown or not {"csv_file", "table_name"} <= set(item):
            raise ValueError(f"file of a load plan: needs csv_file and table_name, does not know {sorted(unknown)}")
        mapping = {old: new["name"] if isinstance(new, dict) else new for old, new in (item.get("column_mapping") or {}).items()}
        path = item["csv_file"]
        path = path if not folder or "://" in path or path.startswith("/") else f"{folder}/{path}"
        rest = {k: v for k, v in item.items() if v is not None}
        infos.append(CsvInfo(**(rest | {"csv_file": path, "column_mapping": mapping})))
        _spec(infos[-1])
    return infos


def load_plan(spark: SparkSession, infos: Iterable[CsvInfo], folder: str, check_keys: bool = True, buckets: int = BUCKETS) -> int:
    """Load the files of a plan into bucketed tables below `folder`, all or none; returns the version.

    The order in which tables are listed does not matter, as all are published together. Of several files for one
    table a later one wins, as do later rows. A NULL in a required column stops the load, and so does, with
    `check_keys`, a foreign key of a loaded table, old rows included, that has no parent after it.
    """
    parts: dict[str, list[DataFrame]] = {}
    for number, info in enumerate(infos):
        incoming = read_mapped_csv(spark, info, order="_position")
        _refuse_nulls(info, incoming.drop("_position"))
        place = F.struct(F.lit(number).alias("file"), F.col("_position"))
        parts.setdefault(_spec(info).name, []).append(incoming.withColumn("_position", place))
    loads = {}
    for name, files in parts.items():
        incoming = files[0]
        for other in files[1:]:
            incoming = incoming.unionByName(other, allowMissingColumns=True)
        spec = CATALOG_TABLES[name]
        loads[name] = Load(incoming, spec.key, "_position", spec.schema)

    def no_orphans(read) -> None:
        tables = {name: read(name, spec.schema) for name, spec in CATALOG_TABLES.items()}
        for name in loads:
            if not CATALOG_TABLES[name].foreign_keys:
                continue
            family = {name: tables[name]} | {parent: tables[parent] for _, parent, _ in CATALOG_TABLES[name].foreign_keys}
            lost = fk_orphans(family).where(F.col("child_table") == name).limit(1).collect()
            if lost:
                raise ValueError(f"{name}: {lost[0]['fk_column']} {lost[0]['missing_key']} has no parent")

    return load_tables(spark, folder, loads, buckets, no_orphans if check_keys else None)


def load_all(
    spark: SparkSession, infos: Iterable[CsvInfo], folder: str, check: bool = True
) -> dict[str, str]:
    """Load each file into its table under `folder`, in turn; returns where each table was written.

    With `check`, a file that lacks a required column or breaks NOT NULL stops the load before its table changes.
    """
    written = {}
    for info in infos:
        spec = _spec(info)
        incoming = read_mapped_csv(spark, info, order="_position")
        if check:
            _refuse_nulls(info, incoming.drop("_position"))
        written[spec.name] = write_upsert(
            f"{folder}/{spec.name}", incoming, spec.key, "_position", spec.schema
        )
    return written
