"""Registered queries over Java files with deep nesting, reassembled texts, and names across files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sqltrail.operators import builders as bld
from sqltrail.operators import definitions as dfn
from sqltrail.operators import java as jav
from sqltrail.plans.inputs import deep_files, java_files, view
from sqltrail.plans.queries import _generic_text, _int, _joined, _rows_sql, query

# --- brackets of any depth ---


def _deep(spark, sf_dir):
    return jav.statements(deep_files(spark, sf_dir))


@query(
    """
SELECT file_name, 'sql' AS field_name, CAST(5 AS INT) AS line_number, 'String[]' AS field_type, '{"SELECT a FROM T_' || c7 || '","b"}' AS value FROM deep_keys
UNION ALL SELECT file_name, 'none', CAST(5 AS INT), 'int[]', '{}' FROM deep_keys
UNION ALL SELECT file_name, 'nest', CAST(6 AS INT), 'Object[]', 'newObject[]' || repeat('{', d + 1) || '"x"' || repeat('}', d + 1) FROM deep_keys
UNION ALL SELECT file_name, 'k', CAST(7 AS INT), 'int', repeat('f(', d) || '1' || repeat(')', d) FROM deep_keys
UNION ALL SELECT file_name, 'm', CAST(7 AS INT), 'int', '2' FROM deep_keys""",
    "deep_keys",
)
def deep_fields(spark, sf_dir):
    return jav.fields(_deep(spark, sf_dir)).select("file_name", "field_name", "line_number", "field_type", "value")


@query(
    """
SELECT file_name, 'class Deep' || k AS name, CAST(4 AS INT) AS line_number, 'Base<' || repeat('List<', d) || 'Long' || repeat('>', d) || '>' AS type,
  '({' || repeat('@M({', d) || '1' || repeat('})', d) || '})' AS marks FROM deep_keys
UNION ALL SELECT file_name, 'run', CAST(8 AS INT), repeat('Map<', d) || 'Long' || repeat('>', d), '' FROM deep_keys""",
    "deep_keys",
)
def deep_types(spark, sf_dir):
    stmts = _deep(spark, sf_dir)
    types = jav.type_decls(stmts).select(
        "file_name", F.concat_ws(" ", "kind", "type_name").alias("name"), "line_number", _generic_text(F.col("extends")).alias("type"),
        _joined(F.col("annotations.arguments")).alias("marks"),
    )
    return types.unionByName(
        jav.methods(stmts).select("file_name", F.col("method_name").alias("name"), "line_number", F.col("return_type").alias("type"), F.lit("").alias("marks"))
    )


@query(
    f"""
SELECT file_name, {_int(1).replace("CAST(1", "CAST(n")} AS level, kind, name, CAST(first AS INT) AS line_number, CAST(last AS INT) AS end_line FROM deep_keys,
  (VALUES (1, 'type', NULL, 4, 17), (2, 'method', 'run', 8, 16), (3, 'block', '', 15, 15)) s (n, kind, given, first, last),
  LATERAL (SELECT coalesce(given, 'Deep' || k) AS name) t""",
    "deep_keys",
)
def deep_scopes(spark, sf_dir):
    return jav.scopes(_deep(spark, sf_dir)).select("file_name", "level", "kind", "name", "line_number", "end_line")


@query(
    """SELECT file_name, 'sb' AS variable, CAST(9 AS INT) AS line_number, CAST(7 AS INT) AS appends,
  'SELECT b FROM TB_' || p || ' b JOIN T_' || c7 || ' c ' AS content FROM deep_keys""",
    "deep_keys",
)
def deep_builders(spark, sf_dir):
    return jav.string_builders(_deep(spark, sf_dir)).drop("repo_name", "file_path")


# A name split over two appends has the line of the one it begins in.
@query(
    """SELECT file_name, 'R' AS operation, 'TB_' || p AS table_name, CAST(12 AS INT) AS line_number, 'TB_' AS line FROM deep_keys
UNION ALL SELECT file_name, 'R', 'T_' || c7, CAST(14 AS INT), 'JOIN T_' || c7 FROM deep_keys""",
    "deep_keys",
)
def builder_hits(spark, sf_dir):
    return bld.builder_hits(_deep(spark, sf_dir)).select("file_name", "operation", "table_name", "line_number", "line")


# --- references and edges of reassembled texts ---

_HITS = _rows_sql(
    "variable, decl_line, object_name, operation, line_number, line",
    f"0: 'sql' ; {_int(23)} ; 'TB_' || p ; 'R' ; {_int(24)} ; 'SELECT * FROM TB_' || p || ' a '",
    f"0: 'sql' ; {_int(23)} ; 'T_' || c7 ; 'R' ; {_int(25)} ; 'JOIN T_' || c7 || ' b '",
    f"0: 'sql' ; {_int(28)} ; 'T_' || c9 ; 'M' ; {_int(29)} ; 'UPDATE T_' || c9 || ' SET a = ' || k",
    f"1: 'out' ; CAST(NULL AS INT) ; 'T_' || c7 ; 'M' ; {_int(9)} ; 'DELETE FROM T_' || c7 || ' '",
    f"1: 'q' ; {_int(14)} ; 'TB_' || p ; 'M' ; {_int(15)} ; 'INSERT INTO TB_' || p || ' '",
)
_REFS = f"""best AS (SELECT owner, object_name, arg_min(object_type, CASE object_type WHEN 'TABLE' THEN 1 WHEN 'VIEW' THEN 2 ELSE 3 END) AS object_type
  FROM catalog WHERE object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW') GROUP BY owner, object_name),
refs AS (SELECT hits.*, owner, object_type, 'src/p' || (CAST(regexp_extract(file_name, '[0-9]+') AS BIGINT) % 20) AS file_path
  FROM ({_HITS}) hits JOIN best ON hits.object_name = best.object_name)"""


@query(
    f"WITH {_REFS} SELECT owner, object_name, object_type, line, line_number, file_path, file_name, 'repo' AS repo_name, operation, variable, decl_line FROM refs",
    "java_keys", "catalog",
)
def builder_refs(spark, sf_dir):
    stmts = jav.statements(java_files(spark, sf_dir))
    return bld.builder_refs(stmts, view(spark, sf_dir, "catalog")).drop("valid")


@query(
    f"""WITH {_REFS}, edges AS (SELECT 'repo/' || file_path || '/' || file_name AS from_code, owner || '.' || object_name AS to_code,
  CASE operation WHEN 'R' THEN 'read' ELSE 'modify' END AS map_type, operation AS db_operation, line AS line_text, line_number, file_path, file_name FROM refs)
SELECT from_code, to_code, map_type, db_operation, line_text, line_number, file_path, file_name FROM (
  SELECT *, row_number() OVER (PARTITION BY from_code, to_code ORDER BY line_number DESC, db_operation DESC, line_text DESC) AS rn FROM edges) n WHERE rn = 1""",
    "java_keys", "catalog",
)
def builder_edges(spark, sf_dir):
    stmts = jav.statements(java_files(spark, sf_dir))
    edges = bld.builder_edges(bld.builder_refs(stmts, view(spark, sf_dir, "catalog")))
    return edges.select("from_code", "to_code", "map_type", "db_operation", "line_text", "line_number", "file_path", "file_name")


# --- names across files ---


def _app(spark, sf_dir):
    return jav.statements(view(spark, sf_dir, "app_files"))


_EDGE_ROWS = (
    ("entity", "'TB_CUST_' || k", "entity_def", "NULL", "model", "", 5),
    ("repository", "entity", "repository_def", "NULL", "repo", "Repo", 6),
    ("repository", "repository || '.findTop5ByNameAndPhoneIsNotNullOrderByNameDesc'", "repository_method_def", "'R'", "repo", "Repo", 7),
    ("repository", "repository || '.listAll'", "repository_method_def", "'R'", "repo", "Repo", 9),
    ("repository", "repository || '.rename'", "repository_method_def", "'M'", "repo", "Repo", 12),
    ("repository", "repository || '.deleteByName'", "repository_method_def", "'M'", "repo", "Repo", 13),
    ("service || '.run'", "repository || '.rename'", "repository_method_invocation", "NULL", "service", "Service", 12),
    ("service || '.run'", "repository || '.save'", "repository_method_invocation", "NULL", "service", "Service", 13),
    ("service || '.run'", "audit || '.note'", "call", "NULL", "service", "Service", 14),
    ("service || '.run'", "entity || '.label'", "call", "NULL", "service", "Service", 14),
    ("service || '.run'", "service || '.check'", "call", "NULL", "service", "Service", 15),
    ("service || '.check'", "audit || '.flush'", "call", "NULL", "service", "Service", 17),
)


@query(
    " UNION ALL ".join(
        f"SELECT {a} AS from_code, {b} AS to_code, '{kind}' AS map_type, CAST({operation} AS VARCHAR) AS db_operation, '{folder}' AS file_path, "
        f"'Cust' || k || '{suffix}.java' AS file_name, CAST({line} AS INT) AS line_number FROM app_keys"
        for a, b, kind, operation, folder, suffix, line in _EDGE_ROWS
    ),
    "app_keys",
)
def definition_edges(spark, sf_dir):
    return dfn.definition_edges(_app(spark, sf_dir))


_METHOD_TABLES = (
    ("findTop5ByNameAndPhoneIsNotNullOrderByNameDesc", 7, "derived", "R", "'TB_CUST_' || k", "'name,phone|name desc|5'"),
    ("listAll", 9, "native", "R", "'TB_CUST_' || k", "NULL"),
    ("listAll", 9, "native", "R", "'TB_SEG_' || s", "NULL"),
    ("rename", 12, "query", "M", "'TB_CUST_' || k", "NULL"),
    ("deleteByName", 13, "derived", "M", "'TB_CUST_' || k", "'name|'"),
)


@query(
    " UNION ALL ".join(
        f"SELECT repository, '{name}' AS method_name, CAST({line} AS INT) AS line_number, entity, '{kind}' AS query_kind, '{operation}' AS operation, "
        f"{table} AS table_name, CAST({asked} AS VARCHAR) AS asked FROM app_keys"
        for name, line, kind, operation, table, asked in _METHOD_TABLES
    ),
    "app_keys",
)
def repository_methods(spark, sf_dir):
    said = F.col("derived")
    asked = F.concat_ws("|", _joined(said["properties"], ","), _joined(said["ordered"], ","), said["most"].cast("string"))
    return dfn.repository_methods(_app(spark, sf_dir)).select(
        "repository", "method_name", "line_number", "entity", "query_kind", "operation", "table_name", F.when(said.isNotNull(), asked).alias("asked")
    )
