"""Registered queries: name, Spark plan, and the same question in SQL over the same tables.

For Java files the SQL does not read the text: it says from the order keys which rows the text, as
written in `inputs`, must give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail import constants as C
from sqltrail.functions import text as X
from sqltrail.operators import catalog as cat
from sqltrail.operators import edges as edg
from sqltrail.operators import hierarchy as hier
from sqltrail.operators import java as jav
from sqltrail.operators import references as ref
from sqltrail.operators import report as rep
from sqltrail.operators import upsert as ups
from sqltrail.operators import usage as use
from sqltrail.plans.inputs import java_files, src_lines, table, view, with_views
from sqltrail.schemas import CATALOG_TABLES
from sqltrail.session import ensure_checkpoint_dir
from sqltrail.sources.buckets import Load, load_tables, read_bucketed

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None, *views: str) -> Callable[[Plan], Plan]:
    """Register a plan under its function's name, with its SQL over the derived inputs it reads."""

    def register(plan: Plan) -> Plan:
        text = None if sql is None else (with_views(sql, *views) if views else sql)
        REGISTRY[plan.__name__] = Query(plan, text)
        return plan

    return register


def _joined(items: Column, separator: str = "|") -> Column:
    return F.array_join(items, separator)


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# White space and word characters of `functions.text`, in the other engine's notation.
RE_WS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
RE_WORD = r"\p{L}\p{N}_"
LINE_KEY = "repo_name, file_path, file_name, line_number"


def _split_lines(table_name: str, keys: str, text: str) -> str:
    """SQL for the stripped, numbered lines of a text column."""
    return f"""
  SELECT {keys}, CAST(line_number AS INT) AS line_number,
    regexp_replace(raw, '^[{RE_WS}]+|[{RE_WS}]+$', '', 'g') AS line
  FROM (SELECT {keys}, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line_number
        FROM (SELECT {keys}, string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM {table_name}) t) u"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ref.to_lines(table(spark, sf_dir, "pages").select("page_id", "html"), "html")


PAGE_LINES = _split_lines("pages", "page_id", "html")

# --- lines, literals, tokens ----------------------------------------------------------------


@query(f"SELECT * FROM ({_split_lines('documents', 'doc_id', 'text')}) x")
def src_lines_explode(spark, sf_dir):
    return ref.to_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(
    """
SELECT url AS path, 'pages' AS repo_name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS file_path,
  regexp_extract(url, '([^/]*)$', 1) AS file_name, lower(regexp_extract(url, '\\.([^./]*)$', 1)) AS ext FROM pages"""
)
def file_info(spark, sf_dir):
    from sqltrail.sources.files import with_file_info

    return with_file_info(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), "/data/pages/")


@query(
    f"""SELECT conv_id, turn, regexp_replace(chr(9) || ' ' || text || chr(160) || chr(10), '^[{RE_WS}]+|[{RE_WS}]+$', '', 'g') AS line
FROM conversations"""
)
def strip_lines(spark, sf_dir):
    padded = F.concat(F.lit("\t "), "text", F.lit("\u00a0\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.py_strip(padded).alias("line"))


# The patterns of quoted texts with escapes.
RE_ESCAPED_SINGLE = r"''(?:\\.|[^\\''])*''"
RE_ESCAPED_DOUBLE = r'"(?:\\.|[^\\"])*"'
RE_ESCAPED_BACKTICK = r"`(?:\\.|[^\\`])*`"
RE_PHP = f"{RE_ESCAPED_SINGLE}|{RE_ESCAPED_DOUBLE}"
RE_JS = f"{RE_PHP}|{RE_ESCAPED_BACKTICK}"
SQL_DQ = """regexp_extract_all(line, '"(.*?)"', 1)"""
SQL_PHP = f"regexp_extract_all(line, '{RE_PHP}')"
SQL_JS = f"regexp_extract_all(line, '{RE_JS}')"
SQL_SQ = "regexp_extract_all(line, '''(.*?)''', 1)"


def _literal_sql(found: str) -> str:
    return f"""
SELECT page_id, line_number, CAST(generate_subscripts(found, 1) AS INT) AS literal_number, unnest(found) AS literal
FROM (SELECT page_id, line_number, {found} AS found FROM ({PAGE_LINES}) p) q"""


def _page_literals(spark, sf_dir, extractor) -> DataFrame:
    lines = page_lines(spark, sf_dir).withColumn("ext", F.lit("x"))
    return ref.literals(lines, {"x": extractor}).select("page_id", "line_number", "literal_number", "literal")


@query(_literal_sql(SQL_DQ))
def literals_java(spark, sf_dir):
    return _page_literals(spark, sf_dir, X.literals_dq)


def _source_literal_sql(found: str) -> str:
    return f"""
SELECT {LINE_KEY}, CAST(generate_subscripts(found, 1) AS INT) AS literal_number, unnest(found) AS literal
FROM (SELECT *, {found} AS found FROM src_lines) t"""


def _source_literals(spark, sf_dir, extractor) -> DataFrame:
    """Literals of one dialect on every source line, whatever its suffix."""
    lines = src_lines(spark, sf_dir).withColumn("ext", F.lit("x"))
    return ref.literals(lines, {"x": extractor}).drop("ext", "line")


@query(_source_literal_sql(SQL_SQ), "src_lines")
def literals_single(spark, sf_dir):
    return _source_literals(spark, sf_dir, X.literals_sq)


@query(_source_literal_sql(SQL_JS), "src_lines")
def literals_js(spark, sf_dir):
    return _source_literals(spark, sf_dir, X.literals_js)


@query(_source_literal_sql(SQL_PHP), "src_lines")
def literals_php(spark, sf_dir):
    return _source_literals(spark, sf_dir, X.literals_php)


@query(_source_literal_sql(SQL_DQ), "src_lines")
def literals_sql(spark, sf_dir):
    return _source_literals(spark, sf_dir, X.EXTRACTORS["sql"])


LITERALS_BY_EXT = f"CASE WHEN ext IN ('java', 'sql') THEN {SQL_DQ} WHEN ext = 'php' THEN {SQL_PHP} ELSE {SQL_JS} END"


@query(
    f"""
SELECT {LINE_KEY}, ext, CAST(generate_subscripts(found, 1) AS INT) AS literal_number, unnest(found) AS literal
FROM (SELECT *, {LITERALS_BY_EXT} AS found FROM src_lines) t""",
    "src_lines",
)
def literals_by_ext(spark, sf_dir):
    return ref.literals(src_lines(spark, sf_dir)).drop("line")


@query(
    f"""
SELECT conv_id, turn, CAST(len(parts) AS INT) AS token_count, array_to_string(parts, '|') AS tokens
FROM (SELECT *, string_split_regex(text, '[,;:{RE_WS}][{RE_WS}]*') AS parts FROM conversations) t"""
)
def tokenize(spark, sf_dir):
    parts = X.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(parts).alias("token_count"), _joined(parts).alias("tokens")
    )


# Tokens with the operation that holds at each, by a window over the tokens of each literal.
TOKEN_OPS = f"""
lits AS (SELECT *, unnest(found) AS literal, generate_subscripts(found, 1) AS ln
         FROM (SELECT *, {LITERALS_BY_EXT} AS found FROM src_lines) a),
toks AS (SELECT *, upper(unnest(parts)) AS token, generate_subscripts(parts, 1) AS tn
         FROM (SELECT *, string_split_regex(literal, '[,;:\\s]\\s*') AS parts FROM lits) b),
token_ops AS (SELECT *, coalesce(last_value(CASE WHEN token IN ('FROM', 'JOIN') THEN 'R'
           WHEN token IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE') THEN 'M' END IGNORE NULLS)
         OVER (PARTITION BY {LINE_KEY}, ln ORDER BY tn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS operation FROM toks)"""


@query(
    f"WITH {TOKEN_OPS} SELECT {LINE_KEY}, token, operation FROM token_ops WHERE token <> ''", "src_lines"
)
def sticky_operation(spark, sf_dir):
    return ref.operation_tokens(src_lines(spark, sf_dir)).drop("ext", "line")


# --- references -----------------------------------------------------------------------------


def _refs_sql(types, owners=None, operation: str = "operation", columns: str | None = None) -> str:
    owner_filter = f" AND c.owner IN ({_sql_list(owners)})" if owners else ""
    listed = columns or (
        "owner, object_name, object_type, line, line_number, file_path, file_name, repo_name, valid, operation"
    )
    return f"""
WITH {TOKEN_OPS},
refs AS (SELECT c.owner, c.object_name, c.object_type, t.line, t.line_number, t.file_path, t.file_name, t.repo_name,
    '' AS valid, {operation} AS operation
  FROM token_ops t JOIN (SELECT DISTINCT owner, object_type, object_name FROM catalog) c ON c.object_name = t.token
  WHERE c.object_type IN ({_sql_list(types)}){owner_filter})
SELECT {listed} FROM refs"""


@query(_refs_sql(C.CODE_MAP_TYPES), "src_lines", "catalog")
def code_refs(spark, sf_dir):
    return ref.map_references(src_lines(spark, sf_dir), view(spark, sf_dir, "catalog"))


@query(_refs_sql(C.CODE_MAP_TYPES), "src_lines", "catalog")
def code_refs_shuffled(spark, sf_dir):
    """As for a catalog beyond the broadcast bound."""
    return ref.map_references(src_lines(spark, sf_dir), view(spark, sf_dir, "catalog"), fits=False)


@query(_refs_sql(C.REFERENCES_TYPES, operation="''"), "src_lines", "catalog")
def code_refs_references(spark, sf_dir):
    return ref.map_references(
        src_lines(spark, sf_dir), view(spark, sf_dir, "catalog"), C.REFERENCES_TYPES, with_operation=False
    )


@query(_refs_sql(C.CODE_MAP_TYPES, ["OWN_A", "OWN_1"]), "src_lines", "catalog")
def refs_owner_filter(spark, sf_dir):
    return ref.map_references(
        src_lines(spark, sf_dir), view(spark, sf_dir, "catalog"), owners=["OWN_A", "OWN_1"]
    )


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS preset, owner, object_type, object_name FROM catalog WHERE object_type IN ({_sql_list(types)})"
        for name, types in C.TYPE_PRESETS.items()
    ),
    "catalog",
)
def refs_type_presets(spark, sf_dir):
    objects = view(spark, sf_dir, "catalog")
    presets = [
        ref.where_type(objects, types).withColumn("preset", F.lit(name)) for name, types in C.TYPE_PRESETS.items()
    ]
    return presets[0].unionByName(presets[1]).unionByName(presets[2])


_REPORT = (
    'owner AS "Owner", object_name AS "Object Name", object_type AS "Object Type", line AS "Line", '
    'line_number AS "Line Number", file_path AS "File Path", file_name AS "File Name", repo_name AS "Repo Name", valid AS "Valid"'
)


@query(_refs_sql(C.CODE_MAP_TYPES, columns=f'{_REPORT}, operation AS "Operation"'), "src_lines", "catalog")
def refs_report_columns(spark, sf_dir):
    return rep.refs_report(code_refs(spark, sf_dir))


@query(
    _refs_sql(
        C.CODE_MAP_TYPES,
        columns=f"""{_REPORT}, CASE WHEN operation = 'R' THEN 'R' ELSE '' END AS "Read",
  CASE WHEN operation = 'M' THEN 'M' ELSE '' END AS "Modify" """,
    ),
    "src_lines", "catalog",
)
def refs_report_rw(spark, sf_dir):
    return rep.refs_report(code_refs(spark, sf_dir), layout="rw")


_EDGES = """
SELECT from_code, to_code, map_type, db_operation, CAST(NULL AS VARCHAR) AS integration_style, CAST(NULL AS VARCHAR) AS integration_volume,
  CAST(NULL AS VARCHAR) AS start_time, CAST(NULL AS INT) AS duration, line_text, line_number, file_path, file_name
FROM (SELECT *, row_number() OVER (PARTITION BY from_code, to_code ORDER BY file_path DESC, file_name DESC, line_number DESC,
    db_operation DESC, line_text DESC) AS rn
  FROM (SELECT repo_name || '/' || file_path || '/' || file_name AS from_code, owner || '.' || object_name AS to_code,
    CASE operation WHEN 'R' THEN 'read' ELSE 'modify' END AS map_type, operation AS db_operation, line AS line_text,
    line_number, file_path, file_name FROM refs WHERE operation <> '') e) n WHERE rn = 1"""


@query(_refs_sql(C.CODE_MAP_TYPES).rsplit("SELECT", 1)[0] + _EDGES, "src_lines", "catalog")
def lineage_edges(spark, sf_dir):
    return edg.build_edges(edg.refs_to_edges(code_refs(spark, sf_dir)))


# --- SQL patterns and usage -----------------------------------------------------------------

RELATIONS = "SELECT object_name FROM catalog WHERE object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW')"

# The patterns whose groups are the names read and changed.
SQL_READS = r"list_concat(regexp_extract_all({0}, '(?is)SELECT\s.*?\sFROM\s+(\w+)', 1), regexp_extract_all({0}, '(?is)JOIN\s+(\w+)\s', 1))"
SQL_CHANGES = r"regexp_extract_all({0}, '(?i)(INSERT INTO|UPDATE|DELETE FROM)\s+(\w+)', 2)"


@query(
    f"SELECT {LINE_KEY}, upper(array_to_string({SQL_READS.format('line')}, '|')) AS targets FROM src_lines",
    "src_lines",
)
def read_targets(spark, sf_dir):
    return src_lines(spark, sf_dir).select(
        *LINE_KEY.split(", "), _joined(X.read_targets(F.col("line"))).alias("targets")
    )


@query(
    f"SELECT {LINE_KEY}, upper(array_to_string({SQL_CHANGES.format('line')}, '|')) AS targets FROM src_lines",
    "src_lines",
)
def modify_targets(spark, sf_dir):
    return src_lines(spark, sf_dir).select(
        *LINE_KEY.split(", "), _joined(X.modify_targets(F.col("line"))).alias("targets")
    )


TAGS = f"""tags AS (
  SELECT {LINE_KEY}, upper(unnest({SQL_READS.format('line')})) AS table_name, TRUE AS read, FALSE AS modified FROM src_lines
  UNION ALL SELECT {LINE_KEY}, upper(unnest({SQL_CHANGES.format('line')})), FALSE, TRUE FROM src_lines)"""


def _tags(spark, sf_dir) -> DataFrame:
    return use.tag_lines(src_lines(spark, sf_dir)).drop("ext", "line")


@query(f"WITH {TAGS} SELECT * FROM tags", "src_lines")
def line_tags(spark, sf_dir):
    return _tags(spark, sf_dir)


@query(
    f"SELECT {LINE_KEY}, unnest(regexp_extract_all(line, '\\b[A-Z_][A-Z0-9_]*\\b')) AS table_name FROM src_lines",
    "src_lines",
)
def upper_identifiers(spark, sf_dir):
    return use.upper_identifiers(src_lines(spark, sf_dir)).drop("ext", "line")


@query(
    f"""WITH {TAGS} SELECT table_name, bool_or(read) AS read, bool_or(modified) AS modified, count(*) AS occurrences
FROM tags WHERE table_name IN ({RELATIONS}) GROUP BY table_name""",
    "src_lines", "catalog",
)
def table_usage(spark, sf_dir):
    return use.table_usage(use.keep_relations(_tags(spark, sf_dir), view(spark, sf_dir, "catalog")))


@query(
    f"""WITH {TAGS} SELECT DISTINCT table_name, repo_name, file_path, file_name, line_number
FROM tags WHERE table_name IN ({RELATIONS})""",
    "src_lines", "catalog",
)
def usage_by_file(spark, sf_dir):
    return use.usage_by_file(use.keep_relations(_tags(spark, sf_dir), view(spark, sf_dir, "catalog")))


_USAGE_REPORT = f"""
WITH numbered AS (SELECT file_path, file_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM java_files),
all_tags AS (SELECT *, upper(unnest({SQL_READS.format('line')})) AS table_name, TRUE AS read, FALSE AS modified FROM numbered
  UNION ALL SELECT *, upper(unnest({SQL_CHANGES.format('line')})), FALSE, TRUE FROM numbered),
tags AS (SELECT all_tags.*, CASE WHEN shape <> 1 THEN 'app.' || CASE shape WHEN 0 THEN 'm' ELSE 'repo.r' END || m ELSE 'None' END AS package_name,
    CASE shape WHEN 0 THEN 'Fake' WHEN 1 THEN 'Dao' || k ELSE 'None' END AS class_name
  FROM all_tags JOIN java_keys USING (file_name) WHERE table_name IN ({RELATIONS}))
SELECT table_name, table_name || ': ' || concat_ws(', ', CASE WHEN bool_or(read) THEN 'read' END,
    CASE WHEN bool_or(modified) THEN 'modified' END) AS text FROM tags GROUP BY table_name
UNION ALL SELECT table_name, '  - File: ' || file_path || ', Package: ' || package_name || ', Class: ' || class_name || ', Lines: ' || line_number FROM tags"""


@query(_USAGE_REPORT, "java_files", "java_keys", "catalog")
def usage_report_lines(spark, sf_dir):
    lines = ref.to_lines(use.with_package_class(java_files(spark, sf_dir)))
    return use.usage_report_lines(use.keep_relations(use.tag_lines(lines), view(spark, sf_dir, "catalog")))


@query(
    f"""WITH {TAGS} SELECT * FROM tags WHERE table_name IN (
  SELECT object_name FROM catalog WHERE object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW'))""",
    "src_lines", "catalog",
)
def known_tables_semi(spark, sf_dir):
    return ref.keep_known(_tags(spark, sf_dir), cat.catalog_relations(view(spark, sf_dir, "catalog")))


@query(
    f"""WITH {TAGS}, best AS (SELECT object_name, arg_min(object_type, CASE object_type WHEN 'TABLE' THEN 1 WHEN 'VIEW' THEN 2 ELSE 3 END) AS object_type
  FROM catalog WHERE owner = 'OWN_1' AND object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW') GROUP BY object_name)
SELECT tags.*, best.object_type, 'OWN_1' AS owner FROM tags JOIN best ON tags.table_name = best.object_name""",
    "src_lines", "catalog",
)
def resolve_priority(spark, sf_dir):
    return ref.resolve_in_owner(_tags(spark, sf_dir), view(spark, sf_dir, "catalog"), "OWN_1")


@query(
    """
SELECT file_name, CASE WHEN shape <> 1 THEN 'app.' || CASE shape WHEN 0 THEN 'm' ELSE 'repo.r' END || m END AS package_name,
  CASE shape WHEN 0 THEN 'Fake' WHEN 1 THEN 'Dao' || k END AS class_name FROM java_keys""",
    "java_keys",
)
def package_class(spark, sf_dir):
    found = use.with_package_class(java_files(spark, sf_dir))
    return found.select("file_name", "package_name", "class_name")


# The patterns that say what a name of a whole file is used for.
_FILE_USAGE = r"""
named AS (SELECT DISTINCT file_name, content, unnest(regexp_extract_all(content, '\b[A-Z_][A-Z0-9_]*\b')) AS table_name FROM java_files),
usage AS (SELECT file_name, table_name, regexp_matches(content, '(?is)SELECT.*?FROM.*?\b' || table_name || '\b') AS read,
    regexp_matches(content, '(?is)(?:INSERT INTO|UPDATE|DELETE FROM)\b.*?\b' || table_name || '\b') AS modified
  FROM named WHERE table_name IN (SELECT object_name FROM catalog WHERE object_type IN ('TABLE', 'VIEW', 'MATERIALIZED VIEW')))"""


@query(f"WITH {_FILE_USAGE} SELECT * FROM usage", "java_files", "catalog")
def file_usage_flags(spark, sf_dir):
    return use.classify_file_usage(
        java_files(spark, sf_dir), view(spark, sf_dir, "catalog"), keys=["file_name"]
    )


@query(
    f"""WITH {_FILE_USAGE},
numbered AS (SELECT file_name, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM java_files),
found AS (SELECT DISTINCT file_name, line_number, unnest(regexp_extract_all(line, '\\b[A-Z_][A-Z0-9_]*\\b')) AS table_name FROM numbered)
SELECT usage.file_name, usage.table_name, array_to_string(list_sort(list(line_number)), ', ') AS lines, read, modified
FROM usage JOIN found ON usage.file_name = found.file_name AND usage.table_name = found.table_name GROUP BY ALL""",
    "java_files", "catalog",
)
def usage_simple(spark, sf_dir):
    files = java_files(spark, sf_dir).select("file_name", "content")
    found = use.usage_simple(files, view(spark, sf_dir, "catalog"), keys=["file_name"])
    return found.withColumn("lines", _joined(F.col("lines").cast("array<string>"), ", "))


WORDS = ("page", "ref", "The", "en", "and")


@query(
    f"""
SELECT page_id, array_to_string(list_filter([{_sql_list(sorted(WORDS))}], lambda w: len(list_filter(segments, lambda s: contains(s, w))) > 0), '|') AS found
FROM (SELECT page_id, list_filter(string_split(html, '"')[2:-2],
    lambda s: regexp_matches(s, '(?:^|[^{RE_WORD}])(?:{"|".join(WORDS)})(?:$|[^{RE_WORD}])')) AS segments FROM pages) t"""
)
def keywords_in_quotes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", _joined(X.keywords_in_quotes(F.col("html"), WORDS)).alias("found")
    )


# --- object catalog -------------------------------------------------------------------------

_UPPER_OBJECTS = "SELECT DISTINCT upper(owner) AS owner, upper(object_type) AS object_type, upper(object_name) AS object_name FROM object_list"


@query(f"SELECT * FROM ({_UPPER_OBJECTS}) u WHERE owner IN ('OWN_1', 'OWN_3')", "object_list")
def catalog_owner_filter(spark, sf_dir):
    return cat.catalog_for_owners(view(spark, sf_dir, "object_list"), ["OWN_1", "OWN_3", "own_2"])


@query(f"SELECT * FROM ({_UPPER_OBJECTS}) u WHERE object_type IN ({_sql_list(C.KNOWN_OBJECT_TYPES)})", "object_list")
def catalog_known_types(spark, sf_dir):
    return cat.catalog_known_types(view(spark, sf_dir, "object_list"))


@query(
    f"""SELECT DISTINCT owner, object_type, upper(object_name) AS object_name FROM object_list
WHERE upper(owner) = 'OWN_2' AND upper(object_type) IN ({_sql_list(C.RELATION_TYPES)})""",
    "object_list",
)
def catalog_relations_only(spark, sf_dir):
    return cat.catalog_relations(view(spark, sf_dir, "object_list"), owner="own_2")


@query(
    f"""SELECT owner, 'all' AS kind, object_type, object_name FROM ({_UPPER_OBJECTS}) u
UNION ALL SELECT owner, CASE object_type {" ".join(f"WHEN '{t}' THEN '{k}'" for t, k in C.CATALOG_KINDS.items())} END, object_type, object_name
FROM ({_UPPER_OBJECTS}) u WHERE object_type IN ({_sql_list(C.CATALOG_KINDS)})""",
    "object_list",
)
def catalog_by_type(spark, sf_dir):
    return cat.catalog_by_type(view(spark, sf_dir, "object_list"))


@query(
    "SELECT DISTINCT owner, object_type, object_name FROM object_list", "object_list"
)
def catalog_dedup(spark, sf_dir):
    return cat.dedup_catalog(view(spark, sf_dir, "object_list"))


@query(
    "SELECT DISTINCT 'list' AS origin, owner AS namespace, object_type AS type, object_name AS name FROM object_list",
    "object_list",
)
def object_index(spark, sf_dir):
    return cat.object_index(view(spark, sf_dir, "object_list"), "list")


@query(
    f"""SELECT object_name, object_type, CASE WHEN upper(object_type) IN ({_sql_list(C.KNOWN_OBJECT_TYPES)}) THEN upper(object_type) END AS known_type
FROM object_list""",
    "object_list",
)
def object_type_lookup(spark, sf_dir):
    return view(spark, sf_dir, "object_list").select(
        "object_name", "object_type", cat.object_type_of(F.upper("object_type")).alias("known_type")
    )


# --- relational catalog ---------------------------------------------------------------------


@query("SELECT * FROM domain WHERE parent_code IS NULL", "domain")
def vw_domain(spark, sf_dir):
    return cat.root_domains(view(spark, sf_dir, "domain"))


@query("SELECT * FROM domain WHERE parent_code IS NOT NULL", "domain")
def vw_subdomain(spark, sf_dir):
    return cat.sub_domains(view(spark, sf_dir, "domain"))


@query(
    "SELECT o_orderkey AS from_code, o_custkey AS to_code, o_orderstatus AS map_type, o_orderpriority AS start_time FROM orders"
)
def map_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "Map_Type"})
    mapping = {"O_ORDERKEY": "from_code", "o_custkey": "to_code", "o_OrderPriority": "start_time"}
    return cat.map_columns(orders, mapping, exclude=["O_TOTALPRICE", "o_orderdate"])


@query(
    """SELECT 'P' || l_partkey AS from_code, CAST(l_linenumber AS INT) AS duration,
  CASE WHEN regexp_matches(l_returnflag, '^[0-9]+$') THEN 1 END AS line_number FROM lineitem"""
)
def map_columns_cast(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("from"), F.col("l_linenumber").cast("string").alias("duration"),
        F.col("l_returnflag").alias("line_number"),
    )
    types = {"duration": "int", "line_number": "int"}
    return cat.map_columns(raw, {"from": "from_code"}, types=types)


@query(
    """SELECT doc_id, nullif(CASE lang WHEN 'en' THEN '' ELSE lang END, '') AS lang, nullif(CASE WHEN n_chars > 500 THEN '' ELSE source END, '') AS source
FROM documents"""
)
def empty_to_null(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") > 500, "").otherwise(F.col("source")).alias("source"),
    )
    return cat.empty_to_null(docs)


_PATHS = """
WITH RECURSIVE tree(code, name, description, level, path) AS (
  SELECT code, name, description, CAST(0 AS INT), code FROM domain WHERE parent_code IS NULL
  UNION ALL SELECT d.code, d.name, d.description, CAST(tree.level + 1 AS INT), tree.path || '->' || d.code
  FROM domain d JOIN tree ON d.parent_code = tree.code)
SELECT * FROM tree"""


@query(_PATHS, "domain")
def domain_paths(spark, sf_dir):
    return hier.domain_paths(view(spark, sf_dir, "domain"))


@query(_PATHS.replace("FROM domain", "FROM shared_domain"), "shared_domain")
def shared_domain_paths(spark, sf_dir):
    return hier.domain_paths(view(spark, sf_dir, "shared_domain"))


@query(_PATHS, "domain")
def sql_file_hierarchy(spark, sf_dir):
    view(spark, sf_dir, "domain").createOrReplaceTempView("domain")
    return hier.run_sql(spark, hier.DOMAIN_PATHS_SQL)


@query(
    """SELECT c.parent_code, c.code, c.name, c.domain_code, c.type_code, p.name AS parent_name
FROM component c LEFT JOIN component p ON c.parent_code = p.code""",
    "component",
)
def parent_join(spark, sf_dir):
    return cat.with_parent(view(spark, sf_dir, "component"))


@query(
    """SELECT o.code, o.name, o.type_code, o.source_file, o.component_code, t.name AS object_type_name, c.name AS component_name,
  c.domain_code AS component_domain_code, c.type_code AS component_type_code, k.name AS component_type_name, d.name AS domain_name
FROM code_object o LEFT JOIN object_type t ON o.type_code = t.code LEFT JOIN component c ON o.component_code = c.code
LEFT JOIN component_type k ON c.type_code = k.code LEFT JOIN domain d ON c.domain_code = d.code""",
    "code_object", "object_type", "component", "component_type", "domain",
)
def catalog_wide(spark, sf_dir):
    names = ("code_object", "object_type", "component", "component_type", "domain")
    return cat.catalog_wide(*[view(spark, sf_dir, name) for name in names])


@query(
    """SELECT m.*, a.name AS from_name, a.type_code AS from_type_code, b.name AS to_name, b.type_code AS to_type_code
FROM map m JOIN code_object a ON m.from_code = a.code JOIN code_object b ON m.to_code = b.code""",
    "map", "code_object",
)
def edges_named(spark, sf_dir):
    return cat.edges_named(view(spark, sf_dir, "map"), view(spark, sf_dir, "code_object"))


def _orphan_sql(child: str, fk: str, parent: str) -> str:
    return (
        f"SELECT '{child}' AS child_table, '{fk}' AS fk_column, {fk} AS missing_key, count(*) AS row_count FROM {child} "
        f"WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT code FROM {parent}) GROUP BY {fk}"
    )


_CATALOG_NAMES = ("domain", "component_type", "object_type", "component", "code_object", "map")


@query(
    " UNION ALL ".join(
        _orphan_sql(name, fk, parent)
        for name, spec in CATALOG_TABLES.items()
        for fk, parent, _ in spec.foreign_keys
    ),
    *_CATALOG_NAMES,
)
def fk_orphans(spark, sf_dir):
    return cat.fk_orphans({name: view(spark, sf_dir, name) for name in _CATALOG_NAMES})


def _null_sql(column: str) -> str:
    return (
        f"SELECT 'map' AS table_name, 'not_null:{column}' AS constraint_name, count(*) FILTER (WHERE {column} IS NULL) AS violations FROM map"
    )


@query(
    " UNION ALL ".join(_null_sql(c) for c in ("from_code", "to_code", "map_type"))
    + """ UNION ALL SELECT 'map', 'primary_key:from_code,to_code', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM map GROUP BY from_code, to_code) g""",
    "map",
)
def constraint_report(spark, sf_dir):
    return cat.constraint_report(view(spark, sf_dir, "map"), CATALOG_TABLES["map"])


@query(
    """
WITH incoming AS (
  SELECT o_custkey AS code, 'Order ' || o_orderkey AS name, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS balance, o_orderkey AS ord FROM orders
  UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal, -1 FROM supplier),
winners AS (SELECT code, name, balance FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord DESC) AS rn FROM incoming) i WHERE rn = 1)
SELECT c_custkey AS code, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  WHERE c_custkey NOT IN (SELECT code FROM winners)
UNION ALL SELECT code, name, balance, NULL FROM winners"""
)
def upsert_customers(spark, sf_dir):
    existing = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("code"), F.concat(F.lit("Order "), "o_orderkey").alias("name"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("balance"), F.col("o_orderkey").alias("ord"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
        F.lit(-1).cast("long").alias("ord"),
    )
    return ups.upsert(existing, orders.unionByName(suppliers), ["code"], "ord")


@query(
    """
WITH incoming AS (SELECT o_custkey AS code, 'Order ' || o_orderkey AS name, o_orderkey AS ord FROM orders WHERE o_totalprice > 250000),
winners AS (SELECT code, name FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ord DESC) AS rn FROM incoming) i WHERE rn = 1)
SELECT 'customer' AS table_name, c_custkey AS code, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey NOT IN (SELECT code FROM winners)
UNION ALL SELECT 'customer', code, name, NULL FROM winners
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier"""
)
def load_bucketed(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/load-{uuid.uuid4().hex}"
    schema = spark.createDataFrame([], "code long, name string, segment string").schema
    rows = lambda name, *columns: table(spark, sf_dir, name).select(*[F.col(c).alias(a) for c, a in columns])
    customers = rows("customer", ("c_custkey", "code"), ("c_name", "name"), ("c_mktsegment", "segment"))
    suppliers = rows("supplier", ("s_suppkey", "code"), ("s_name", "name"))
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(
        F.col("o_custkey").alias("code"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), F.col("o_orderkey").alias("ord")
    )
    one = F.lit(0).alias("ord")
    first = {name: Load(df.select("*", one), ["code"], "ord", schema) for name, df in (("customer", customers), ("supplier", suppliers))}
    load_tables(spark, folder, first)
    load_tables(spark, folder, {"customer": Load(orders, ["code"], "ord", schema)})
    found = [read_bucketed(spark, folder, name, schema).select(F.lit(name).alias("table_name"), "*") for name in first]
    return found[0].unionByName(found[1])


_WORKSPACE = """
WITH placed AS (SELECT c.code, c.name FROM component c WHERE c.domain_code IN (SELECT code FROM domain)),
elements AS (SELECT o.* FROM code_object o WHERE o.component_code IN (SELECT code FROM placed))
SELECT 'workspace trail  {' AS value UNION ALL SELECT '  model {' UNION ALL SELECT '    properties {'
UNION ALL SELECT '      "structurizr.groupSeparator" "/"' UNION ALL SELECT '    }' UNION ALL SELECT '  }' UNION ALL SELECT '}'
UNION ALL SELECT '    ' || code || ' = Group ' || name || ' {' FROM domain UNION ALL SELECT '    }' FROM domain
UNION ALL SELECT '      ' || code || ' = Component ' || name || ' {' FROM placed UNION ALL SELECT '      }' FROM placed
UNION ALL SELECT '        ' || code || ' = ' || type_code || ' ' || name || ' "' || source_file || '"' FROM elements"""


@query(_WORKSPACE, "domain", "component", "code_object")
def workspace_text(spark, sf_dir):
    elements = view(spark, sf_dir, "code_object").select(
        "code", "name", F.col("type_code").alias("type"), F.col("source_file").alias("description"), "component_code"
    )
    return rep.render_workspace(
        view(spark, sf_dir, "domain"), view(spark, sf_dir, "component"), elements, name="trail"
    )


# --- Java files -----------------------------------------------------------------------------


def _statements(spark, sf_dir, *containing: str) -> DataFrame:
    return jav.statements(java_files(spark, sf_dir), containing=containing)


def _rows_sql(columns: str, *rows: str) -> str:
    """One SELECT per expected row; a row is `shape: expression, …` in the order of `columns`."""
    names = columns.split(", ")
    selects = []
    for row in rows:
        shape, _, values = row.partition(": ")
        listed = [v.strip() for v in values.split(" ; ")]
        assert len(listed) == len(names), row
        fields = ", ".join(f"{v} AS {n}" for v, n in zip(listed, names))
        selects.append(f"SELECT file_name, {fields} FROM java_keys WHERE shape = {shape}")
    return " UNION ALL ".join(selects)


def _int(*values: int) -> str:
    return " ; ".join(f"CAST({v} AS INT)" for v in values)


# The statements of the three file shapes, as position, line, depth, end mark, shape, name.
_STATEMENT_ROWS = {
    0: [
        (1, 0, ";"), (3, 0, ";"), (4, 0, ";"), (9, 0, "{", "type", "'Item' || k"), (11, 1, ";"), (14, 1, ";"),
        (16, 1, "{", "constructor", "'Item' || k"), (17, 2, ";"), (18, 2, "}"), (21, 1, "{", "method", "'load'"),
        (22, 2, ";"), (23, 2, ";"), (24, 2, ";"), (25, 2, ";"), (27, 2, "{"), (28, 3, ";"), (29, 3, ";"),
        (30, 3, "}"), (31, 2, ";"), (32, 2, ";"), (33, 2, "}"), (34, 1, "}"),
    ],
    1: [
        (1, 0, ";"), (2, 0, ";"), (4, 0, "{", "type", "'Dao' || k"), (5, 1, ";"), (6, 1, ";"),
        (8, 1, "{", "method", "'fill'"), (9, 2, ";"), (10, 2, "}"), (12, 1, "{", "type", "'Inner' || k"),
        (13, 2, "{", "method", "'run'"), (14, 3, ";"), (15, 3, ";"), (16, 3, ";"), (17, 3, ";"), (18, 3, ";"),
        (18, 3, ";"), (18, 3, "{"), (18, 4, ";"), (18, 4, "}"), (19, 3, "}"), (20, 2, "}"), (21, 1, "}"),
    ],
    2: [
        (1, 0, ";"), (3, 0, ";"), (6, 0, "{", "type", "'Item' || k || 'Repo'"), (8, 1, ";", "method", "'findAll'"),
        (12, 1, ";", "method", "'deleteById'"), (14, 1, ";", "method", "'findById'"), (15, 1, "}"),
    ],
}


def _statement_rows() -> list[str]:
    rows = []
    for shape, listed in _STATEMENT_ROWS.items():
        for pos, (line, depth, mark, *named) in enumerate(listed):
            kind, name = named or ("block", "''")
            rows.append(f"{shape}: {_int(pos, line, depth)} ; '{mark}' ; '{kind}' ; {name}")
    return rows


@query(_rows_sql("pos, line_number, depth, end_mark, shape, name", *_statement_rows()), "java_keys")
def statements(spark, sf_dir):
    return _statements(spark, sf_dir).select(
        "file_name", "pos", "line_number", "depth", "end_mark", "shape", "name"
    )


@query(
    _rows_sql(
        "level, kind, name, line_number, end_line, statements",
        f"0: {_int(1)} ; 'type' ; 'Item' || k ; {_int(9, 34)} ; 5",
        f"0: {_int(2)} ; 'constructor' ; 'Item' || k ; {_int(16, 18)} ; 2",
        f"0: {_int(2)} ; 'method' ; 'load' ; {_int(21, 33)} ; 8",
        f"0: {_int(3)} ; 'block' ; '' ; {_int(27, 30)} ; 3",
        f"1: {_int(1)} ; 'type' ; 'Dao' || k ; {_int(4, 21)} ; 5",
        f"1: {_int(2)} ; 'method' ; 'fill' ; {_int(8, 10)} ; 2",
        f"1: {_int(2)} ; 'type' ; 'Inner' || k ; {_int(12, 20)} ; 2",
        f"1: {_int(3)} ; 'method' ; 'run' ; {_int(13, 19)} ; 8",
        f"1: {_int(4)} ; 'block' ; '' ; {_int(18, 18)} ; 2",
        f"2: {_int(1)} ; 'type' ; 'Item' || k || 'Repo' ; {_int(6, 15)} ; 4",
    ),
    "java_keys",
)
def scopes(spark, sf_dir):
    return jav.scopes(_statements(spark, sf_dir)).drop("repo_name", "file_path", "scope_id")


@query(
    _rows_sql(
        "line_number, import_name",
        f"0: {_int(3)} ; 'java.util.List'",
        f"0: {_int(4)} ; 'app.util.Sql'",
        f"1: {_int(1)} ; 'java.sql.Connection'",
        f"1: {_int(2)} ; 'app.dao.Base' || c7",
        f"2: {_int(3)} ; 'org.data.JpaRepository'",
    ),
    "java_keys",
)
def imports(spark, sf_dir):
    return jav.imports(_statements(spark, sf_dir)).select("file_name", "line_number", "import_name")


def _generic_text(extends: Column) -> Column:
    return _joined(
        F.transform(extends, lambda e: F.concat(e["name"], F.lit("<"), _joined(e["generics"], ","), F.lit(">")))
    )


@query(
    _rows_sql(
        "type_name, kind, line_number, extends, implements, annotations, inheritance",
        f"0: 'Item' || k ; 'class' ; {_int(9)} ; 'Base<Long>' ; 'Serializable|Comparable<Item' || k || '>' ; 'Entity|Table' ; 'Serializable|Comparable<Item' || k || '>|Base'",
        f"1: 'Dao' || k ; 'class' ; {_int(4)} ; 'BaseDao<>' ; '' ; '' ; 'BaseDao'",
        f"1: 'Inner' || k ; 'class' ; {_int(12)} ; '' ; 'Runnable' ; '' ; 'Runnable'",
        f"2: 'Item' || k || 'Repo' ; 'interface' ; {_int(6)} ; 'JpaRepository<Item' || c || ',Long>' ; '' ; 'Repository' ; 'JpaRepository'",
    ),
    "java_keys",
)
def type_decls(spark, sf_dir):
    types = jav.inheritance(jav.type_decls(_statements(spark, sf_dir)))
    return types.select(
        "file_name", "type_name", "kind", "line_number", _generic_text(F.col("extends")).alias("extends"),
        _joined(F.col("implements")).alias("implements"), _joined(F.col("annotations.name")).alias("annotations"),
        _joined(F.col("inheritance")).alias("inheritance"),
    )


_METHOD_ROWS = (
    f"0: 'Item' || k ; 'Item' || k ; {_int(16)} ; ''",
    f"0: 'Item' || k ; 'load' ; {_int(21)} ; 'String'",
    f"1: 'Dao' || k ; 'fill' ; {_int(8)} ; 'void'",
    f"1: 'Inner' || k ; 'run' ; {_int(13)} ; 'void'",
    f"2: 'Item' || k || 'Repo' ; 'findAll' ; {_int(8)} ; 'List<Item' || c || '>'",
    f"2: 'Item' || k || 'Repo' ; 'deleteById' ; {_int(12)} ; 'void'",
    f"2: 'Item' || k || 'Repo' ; 'findById' ; {_int(14)} ; 'Item' || c",
)


@query(_rows_sql("type_name, method_name, line_number, return_type", *_METHOD_ROWS), "java_keys")
def methods(spark, sf_dir):
    return jav.methods(_statements(spark, sf_dir)).select(
        "file_name", "type_name", "method_name", "line_number", "return_type"
    )


@query(
    f"""SELECT *, CASE WHEN method_name IN ({_sql_list(C.MODIFY_METHODS)}) THEN 'modify' WHEN method_name IN ({_sql_list(C.QUERY_METHODS)}) THEN 'query' END AS method_class,
  method_name IN ({_sql_list(('append', *C.MODIFY_METHODS, *C.QUERY_METHODS))}) AS of_interest
FROM ({_rows_sql("type_name, method_name, line_number, return_type", *_METHOD_ROWS)}) t""",
    "java_keys",
)
def method_class(spark, sf_dir):
    named = jav.method_class(methods(spark, sf_dir))
    return named.withColumn("of_interest", jav.is_method_of_interest(F.col("method_name")))


@query(
    _rows_sql(
        "type_name, field_name, line_number, field_type, value",
        f"""0: 'Item' || k ; 'QUERY' ; {_int(11)} ; 'String' ; '"SELECT a FROM T_' || c7 || ' t "+"WHERE u = ' || c9 || '"'""",
        f"0: 'Item' || k ; 'qty' ; {_int(14)} ; 'int' ; CAST(c9 AS VARCHAR)",
        f"""1: 'Dao' || k ; 'status' ; {_int(5)} ; 'String' ; '"' || s || '"'""",
        f"1: 'Dao' || k ; 'cache' ; {_int(6)} ; 'List<Map<String,Long>>' ; 'newHashMap<>()'",
    ),
    "java_keys",
)
def fields(spark, sf_dir):
    return jav.fields(_statements(spark, sf_dir)).select(
        "file_name", "type_name", "field_name", "line_number", "field_type", "value"
    )


@query(
    _rows_sql(
        "type_name, field_name, line_number, content",
        f"0: 'Item' || k ; 'QUERY' ; {_int(11)} ; 'SELECT a FROM T_' || c7 || ' t WHERE u = ' || c9",
        f"1: 'Dao' || k ; 'status' ; {_int(5)} ; s",
    ),
    "java_keys",
)
def string_fields(spark, sf_dir):
    return jav.string_fields(_statements(spark, sf_dir, "String")).drop("repo_name", "file_path")


@query(
    """SELECT page_id, array_to_string(regexp_extract_all(replace(regexp_replace(html, '//[^\\n]*', '', 'g'), chr(10), ''), '"([^"]*)"', 1), '') AS joined
FROM pages"""
)
def join_literals(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.join_literals(F.col("html")).alias("joined"))


@query(
    _rows_sql(
        "target, target_name, name, line_number, arguments, parameters",
        f"""0: 'type' ; 'Item' || k ; 'Entity' ; {_int(7)} ; '' ; ''""",
        f"""0: 'type' ; 'Item' || k ; 'Table' ; {_int(8)} ; '(name = "TB_' || p || '", schema = "S' || c5 || '")' ; 'name="TB_' || p || '"|schema="S' || c5 || '"'""",
        f"""0: 'field' ; 'qty' ; 'Column' ; {_int(13)} ; '(name = "QTY")' ; 'name="QTY"'""",
        f"""0: 'method' ; 'load' ; 'Override' ; {_int(20)} ; '' ; ''""",
        f"""2: 'type' ; 'Item' || k || 'Repo' ; 'Repository' ; {_int(5)} ; '' ; ''""",
        f"""2: 'method' ; 'findAll' ; 'Query' ; {_int(7)} ; '(value = "SELECT i FROM T_' || c7 || ' i", nativeQuery = true)' ; 'value="SELECT i FROM T_' || c7 || ' i"|nativeQuery=true'""",
        f"""2: 'method' ; 'deleteById' ; 'Modifying' ; {_int(10)} ; '' ; ''""",
        f"""2: 'method' ; 'deleteById' ; 'Query' ; {_int(11)} ; '("DELETE FROM T_' || c9 || '")' ; 'Query="DELETE FROM T_' || c9 || '"'""",
    ),
    "java_keys",
)
def annotations(spark, sf_dir):
    found = jav.annotations(_statements(spark, sf_dir, "@"))
    pairs = F.transform("parameters", lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return found.select(
        "file_name", "target", "target_name", "name", "line_number", "arguments", _joined(pairs).alias("parameters")
    )


@query(
    _rows_sql(
        "name, annotation_class",
        "0: 'Entity' ; 'ENTITY'", "0: 'Table' ; 'ENTITY'", "0: 'Column' ; 'ENTITY'",
        "2: 'Query' ; 'QUERY'", "2: 'Query' ; 'QUERY'", "2: 'Modifying' ; 'MODIFY'",
    ),
    "java_keys",
)
def annotation_class(spark, sf_dir):
    return jav.annotation_class(jav.annotations(_statements(spark, sf_dir, "@"))).select(
        "file_name", "name", "annotation_class"
    )


@query(
    _rows_sql("entity, table_name", "0: 'app.m' || m || '.Item' || k ; 'TB_' || p"), "java_keys"
)
def entity_tables(spark, sf_dir):
    return jav.entity_tables(_statements(spark, sf_dir, "@Entity")).drop("repo_name", "file_path")


@query(
    _rows_sql(
        "type_name, base_name, entity_name, method_name, annotation_name, arguments",
        """2: 'Item' || k || 'Repo' ; 'JpaRepository' ; 'Item' || c ; 'findAll' ; 'Query' ; '(value = "SELECT i FROM T_' || c7 || ' i", nativeQuery = true)'""",
        """2: 'Item' || k || 'Repo' ; 'JpaRepository' ; 'Item' || c ; 'deleteById' ; 'Modifying' ; ''""",
        """2: 'Item' || k || 'Repo' ; 'JpaRepository' ; 'Item' || c ; 'deleteById' ; 'Query' ; '("DELETE FROM T_' || c9 || '")'""",
    ),
    "java_keys",
)
def repositories(spark, sf_dir):
    return jav.repositories(_statements(spark, sf_dir, "interface")).drop("repo_name", "file_path")


@query(
    _rows_sql(
        "type_name, method_name, variable, line_number, content",
        f"0: 'Item' || k ; 'load' ; 'head' ; {_int(22)} ; 'SELECT 1 x'",
        f"1: 'Inner' || k ; 'run' ; 'tail' ; {_int(17)} ; ''",
    ),
    "java_keys",
)
def string_locals(spark, sf_dir):
    return jav.string_locals(_statements(spark, sf_dir, "String")).drop("repo_name", "file_path")


@query(
    _rows_sql(
        "method_name, variable_type, variable, line_number",
        f"0: 'load' ; 'String' ; 'head' ; {_int(22)}",
        f"0: 'load' ; 'StringBuilder' ; 'sql' ; {_int(23)}",
        f"1: 'run' ; 'StringBuilder' ; 'q' ; {_int(14)}",
        f"1: 'run' ; 'String' ; 'tail' ; {_int(17)}",
    ),
    "java_keys",
)
def string_vars_filter(spark, sf_dir):
    return jav.string_variables(_statements(spark, sf_dir, "String")).select(
        "file_name", "method_name", "variable_type", F.col("name").alias("variable"), "line_number"
    )


@query(
    _rows_sql(
        "method_name, method_line, strings, builders",
        f"0: 'load' ; {_int(21)} ; 1 ; 1",
        f"1: 'run' ; {_int(13)} ; 1 ; 1",
    ),
    "java_keys",
)
def methods_with_strings(spark, sf_dir):
    return jav.methods_with_strings(_statements(spark, sf_dir, "String")).drop("repo_name", "file_path")


_BUILDER_ROWS = (
    f"0: 'sql' ; {_int(23, 4)} ; 'SELECT * FROM TB_' || p || ' a JOIN T_' || c7 || ' b ON a.id = b.id WHERE 1 = 1 '",
    f"0: 'sql' ; {_int(28, 1)} ; 'UPDATE T_' || c9 || ' SET a = ' || k",
    f"1: 'out' ; CAST(NULL AS INT) ; {_int(2)} ; 'DELETE FROM T_' || c7 || ' WHERE k = ' || k",
    f"1: 'q' ; {_int(14, 5)} ; 'INSERT INTO TB_' || p || ' VALUES ();'",
)
_BUILDERS = _rows_sql("variable, line_number, appends, content", *_BUILDER_ROWS)


@query(_BUILDERS, "java_keys")
def string_builders(spark, sf_dir):
    return jav.string_builders(_statements(spark, sf_dir, "append", "StringBuilder")).drop("repo_name", "file_path")


@query(
    _rows_sql(
        "method_name, variable, line_number, appends, content",
        f"0: 'load' ; 'sql' ; {_int(23, 4)} ; 'SELECT * FROM TB_' || p || ' a JOIN T_' || c7 || ' b UPDATE T_' || c9 || ' SET a = ' || k || ' WHERE 1 = 1 '",
        f"1: 'run' ; 'q' ; {_int(14, 3)} ; 'INSERT INTO TB_' || p || ' VALUES (;'",
    ),
    "java_keys",
)
def string_builders_by_name(spark, sf_dir):
    return jav.string_builders(_statements(spark, sf_dir, "append", "StringBuilder"), by="name").drop("repo_name", "file_path")


@query(
    f"""SELECT file_name, variable, line_number, upper(unnest({SQL_READS.format('content')})) AS table_name, TRUE AS read, FALSE AS modified FROM ({_BUILDERS}) b
UNION ALL SELECT file_name, variable, line_number, upper(unnest({SQL_CHANGES.format('content')})), FALSE, TRUE FROM ({_BUILDERS}) b""",
    "java_keys",
)
def builder_usage(spark, sf_dir):
    """Tables that whole reassembled texts read and change."""
    return use.tag_lines(string_builders(spark, sf_dir), "content").drop("content", "appends")


@query(
    _rows_sql(
        "package_name, imports, types",
        "0: 'app.m' || m ; 'java.util.List|app.util.Sql' ; 'class Item' || k || '(QUERY,qty)(Item' || k || ',load)'",
        "1: CAST(NULL AS VARCHAR) ; 'java.sql.Connection|app.dao.Base' || c7 ; 'class Dao' || k || '(status,cache)(fill)|class Inner' || k || '()(run)'",
        "2: 'app.repo.r' || m ; 'org.data.JpaRepository' ; 'interface Item' || k || 'Repo()(findAll,deleteById,findById)'",
    ),
    "java_keys",
)
def file_documents(spark, sf_dir):
    documents = jav.file_documents(_statements(spark, sf_dir))
    types = F.transform(
        "types",
        lambda t: F.concat(
            t["kind"], F.lit(" "), t["name"], F.lit("("), _joined(t["fields"]["name"], ","), F.lit(")("),
            _joined(t["methods"]["name"], ","), F.lit(")"),
        ),
    )
    return documents.select(
        "file_name", "package_name", _joined(F.col("imports")).alias("imports"), _joined(types).alias("types")
    )


@query(
    """SELECT file_name, 'Package: app.m' || m || chr(10) || 'Imports: java.util.List, app.util.Sql' || chr(10) || 'Class: Item' || k || chr(10)
  || 'Annotation: Entity with no parameters' || chr(10) || 'Annotation: Table with parameters: [name: "TB_' || p || '", schema: "S' || c5 || '"]' || chr(10)
  || '  Extends: Base<Long>' || chr(10) || '  Implements: Serializable, Comparable<Item' || k || '>' || chr(10) || '  Fields:' || chr(10)
  || '    QUERY,  Type: String, Value: "SELECT a FROM T_' || c7 || ' t "+"WHERE u = ' || c9 || '"' || chr(10)
  || '    qty,  Type: int, Value: ' || c9 || chr(10) || '      Annotation: Column with parameters: [name: "QTY"]' || chr(10)
  || '  Methods:' || chr(10) || '    Item' || k || ',  Return Type: ' || chr(10) || '    load,  Return Type: String' || chr(10) || '      Annotation: Override' AS description
FROM java_keys WHERE shape = 0
UNION ALL SELECT file_name, 'Package: None' || chr(10) || 'Imports: java.sql.Connection, app.dao.Base' || c7 || chr(10) || 'Class: Dao' || k || chr(10)
  || '  Extends: BaseDao' || chr(10) || '  Fields:' || chr(10) || '    status,  Type: String, Value: "' || s || '"' || chr(10)
  || '    cache,  Type: List<Map<String,Long>>, Value: newHashMap<>()' || chr(10) || '  Methods:' || chr(10) || '    fill,  Return Type: void' || chr(10)
  || 'Class: Inner' || k || chr(10) || '  Implements: Runnable' || chr(10) || '  Fields:' || chr(10) || '  Methods:' || chr(10) || '    run,  Return Type: void'
FROM java_keys WHERE shape = 1
UNION ALL SELECT file_name, 'Package: app.repo.r' || m || chr(10) || 'Imports: org.data.JpaRepository' || chr(10) || 'Class: Item' || k || 'Repo' || chr(10)
  || 'Annotation: Repository with no parameters' || chr(10) || '  Extends: JpaRepository<Item' || c || ', Long>' || chr(10) || '  Fields:' || chr(10) || '  Methods:' || chr(10)
  || '    findAll,  Return Type: List<Item' || c || '>' || chr(10)
  || '      Annotation: Query with parameters: [value: "SELECT i FROM T_' || c7 || ' i", nativeQuery: true]' || chr(10)
  || '    deleteById,  Return Type: void' || chr(10) || '      Annotation: Modifying' || chr(10)
  || '      Annotation: Query with parameters: [Query: "DELETE FROM T_' || c9 || '"]' || chr(10)
  || '    findById,  Return Type: Item' || c
FROM java_keys WHERE shape = 2""",
    "java_keys",
)
def document_text(spark, sf_dir):
    documents = jav.file_documents(_statements(spark, sf_dir))
    return rep.describe_documents(documents).select("file_name", "description")


_LOAD_SQL = "'SELECT * FROM TB_' || p || ' a JOIN T_' || c7 || ' b ON a.id = b.id WHERE 1 = 1 '"
_BLOCK_SQL = "'UPDATE T_' || c9 || ' SET a = ' || k"
_RUN_SQL = "'INSERT INTO TB_' || p || ' VALUES ();'"
_NO_PARENT = "CAST(NULL AS INT)"


@query(
    _rows_sql(
        "type_name, method_name, method_line, ordinal, parent, kind, line_number, strings, builders",
        f"0: 'Item' || k ; 'Item' || k ; {_int(16, 0)} ; {_NO_PARENT} ; 'constructor' ; {_int(16)} ; '' ; ''",
        f"0: 'Item' || k ; 'load' ; {_int(21, 0)} ; {_NO_PARENT} ; 'method' ; {_int(21)} ; 'head@22=SELECT 1 x' ; 'sql@23/4=' || {_LOAD_SQL}",
        f"0: 'Item' || k ; 'load' ; {_int(21, 1, 0)} ; 'block' ; {_int(27)} ; '' ; 'sql@28/1=' || {_BLOCK_SQL}",
        f"1: 'Dao' || k ; 'fill' ; {_int(8, 0)} ; {_NO_PARENT} ; 'method' ; {_int(8)} ; '' ; ''",
        f"1: 'Inner' || k ; 'run' ; {_int(13, 0)} ; {_NO_PARENT} ; 'method' ; {_int(13)} ; 'tail@17=' ; 'q@14/5=' || {_RUN_SQL}",
        f"1: 'Inner' || k ; 'run' ; {_int(13, 1, 0)} ; 'block' ; {_int(18)} ; '' ; ''",
    ),
    "java_keys",
)
def method_scopes(spark, sf_dir):
    """The scopes of each method document, a row each."""
    documents = jav.method_documents(_statements(spark, sf_dir, "{"))
    line = lambda v: F.concat(v["name"], F.lit("@"), v["line_number"].cast("string"))
    strings = F.transform("strings", lambda v: F.concat(line(v), F.lit("="), v["content"]))
    builders = F.transform("builders", lambda v: F.concat(line(v), F.lit("/"), v["appends"].cast("string"), F.lit("="), v["content"]))
    found = documents.select("file_name", "type_name", "method_name", F.col("line_number").alias("method_line"), F.inline("scopes"))
    return found.withColumns({"strings": _joined(strings), "builders": _joined(builders)}).drop("calls")


@query(
    _rows_sql(
        "type_name, method_name, ordinal, kind, strings, builders, calls",
        f"0: 'Item' || k ; 'Item' || k ; {_int(0)} ; 'constructor' ; '' ; '' ; ''",
        f"0: 'Item' || k ; 'load' ; {_int(0)} ; 'method' ; 'head' ; 'sql' ; '24 sql.append,25 sql.append,31 sql.append,32 sql.toString'",
        f"0: 'Item' || k ; 'load' ; {_int(1)} ; 'block' ; '' ; 'sql' ; '29 sql.append'",
        f"1: 'Dao' || k ; 'fill' ; {_int(0)} ; 'method' ; '' ; '' ; '9 out.append'",
        f"1: 'Inner' || k ; 'run' ; {_int(0)} ; 'method' ; 'tail' ; 'q' ; '15 q.append,16 q.append,17 q.toString'",
        f"1: 'Inner' || k ; 'run' ; {_int(1)} ; 'block' ; '' ; '' ; '18 q.append'",
        *[f"2: 'Item' || k || 'Repo' ; '{name}' ; CAST(NULL AS INT) ; CAST(NULL AS VARCHAR) ; '' ; '' ; ''" for name in ("findAll", "deleteById", "findById")],
    ),
    "java_keys",
)
def file_scopes(spark, sf_dir):
    """The scopes of all methods of the documents of all files, a row each; a method without a body is a row too."""
    types = jav.all_documents(java_files(spark, sf_dir)).select("file_name", F.explode("types").alias("type"))
    methods = types.select("file_name", F.col("type.name").alias("type_name"), F.explode("type.methods").alias("method"))
    found = methods.select("file_name", "type_name", F.col("method.name").alias("method_name"), F.inline_outer("method.scopes"))
    names = lambda c: _joined(F.coalesce(F.col(c)["name"], F.array().cast("array<string>")), ",")
    called = F.transform("calls", lambda c: F.concat(c["line_number"].cast("string"), F.lit(" "), c["receiver"], F.lit("."), c["method"]))
    return found.select(
        "file_name", "type_name", "method_name", "ordinal", "kind", names("strings").alias("strings"), names("builders").alias("builders"),
        F.coalesce(_joined(called, ","), F.lit("")).alias("calls"),
    )


@query(
    _rows_sql(
        "type_name, description",
        "0: 'Item' || k ; 'Method: Item' || k",
        f"0: 'Item' || k ; 'Method: load' || chr(10) || '  String head (Line: 22): SELECT 1 x' || chr(10) || '  StringBuilder sql (Line: 23): ' || {_LOAD_SQL} || chr(10) || '    StringBuilder sql (Line: 28): ' || {_BLOCK_SQL}",
        "1: 'Dao' || k ; 'Method: fill'",
        f"1: 'Inner' || k ; 'Method: run' || chr(10) || '  String tail (Line: 17): ' || chr(10) || '  StringBuilder q (Line: 14): ' || {_RUN_SQL}",
    ),
    "java_keys",
)
def method_text(spark, sf_dir):
    documents = jav.method_documents(_statements(spark, sf_dir, "{"))
    return rep.describe_methods(documents).select("file_name", "type_name", "description")
