"""Declared schemas of the inputs, the reference hits and the relational catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """`a! b c:int` -> a string not null, b string, c int."""
    fields = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        data_type = T.IntegerType() if kind == "int" else T.StringType()
        fields.append(T.StructField(name.rstrip("!"), data_type, not name.endswith("!")))
    return T.StructType(fields)


SOURCE_LINES = _struct("repo_name file_path file_name ext line_number:int line")
CATALOG = _struct("owner object_type object_name")
CODE_REFS = _struct(
    "owner object_name object_type line line_number:int file_path file_name repo_name valid operation"
)
FILE_KEY = ("repo_name", "file_path", "file_name")


@dataclass(frozen=True)
class TableSpec:
    """One catalog table: columns, primary key, and foreign keys as (column, parent, parent column)."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    foreign_keys: tuple[tuple[str, str, str], ...] = ()

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


CATALOG_TABLES = {
    spec.name: spec
    for spec in (
        TableSpec("component_tech", _struct("code! name!"), ("code",)),
        TableSpec("component_type", _struct("code! name!"), ("code",)),
        TableSpec(
            "domain", _struct("code! name! description parent_code"), ("code",),
            (("parent_code", "domain", "code"),),
        ),
        TableSpec("object_type", _struct("code! name!"), ("code",)),
        TableSpec(
            "component", _struct("code! name! domain_code! type_code parent_code"), ("code",),
            (
                ("domain_code", "domain", "code"),
                ("parent_code", "component", "code"),
                ("type_code", "component_type", "code"),
            ),
        ),
        TableSpec(
            "code_object", _struct("code! name! type_code! source_file component_code!"), ("code",),
            (("component_code", "component", "code"), ("type_code", "object_type", "code")),
        ),
        TableSpec(
            "map",
            _struct(
                "from_code! to_code! map_type! db_operation integration_style integration_volume "
                "start_time duration:int line_text line_number:int file_path file_name"
            ),
            ("from_code", "to_code"),
            (("from_code", "code_object", "code"), ("to_code", "code_object", "code")),
        ),
    )
}
