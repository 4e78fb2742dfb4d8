"""Inputs of the registered queries, derived from the given tables.

Each text is valid in Spark and in DuckDB, so both sides of a comparison read the same rows. Java
files are written as one expression per order: three shapes of file, chosen by the order key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _java_file(*lines: str) -> str:
    """SQL for a text of `lines`; `<expr>` inside a line is an SQL expression."""
    parts = []
    for number, line in enumerate(lines):
        if number:
            parts.append("chr(10)")
        for index, piece in enumerate(re.split(r"<<(.*?)>>", line)):
            if index % 2:
                parts.append(piece)
            elif piece:
                parts.append("'" + piece.replace("'", "''") + "'")
    # Adjacent literals become one, which keeps the expression short.
    merged: list[str] = []
    for part in parts:
        if merged and part.startswith("'") and merged[-1].startswith("'"):
            merged[-1] = merged[-1][:-1] + part[1:]
        else:
            merged.append(part)
    return " || ".join(merged)


ENTITY_FILE = _java_file(
    "package app.m<<m>>;",
    "",
    "import java.util.List;",
    "import static app.util.Sql.*;",
    "",
    "/* old { class Fake; } */",
    "@Entity",
    '@Table(name = "TB_<<p>>", schema = "S<<c5>>")',
    "public class Item<<k>> extends Base<Long> implements Serializable, Comparable<Item<<k>>> {",
    '    // private String gone = "x";',
    '    private static final String QUERY = "SELECT a FROM T_<<c7>> t " + // first; part',
    '        "WHERE u = <<c9>>";',
    '    @Column(name = "QTY")',
    "    private int qty = <<c9>>;",
    "",
    "    public Item<<k>>() {",
    "        super();",
    "    }",
    "",
    "    @Override",
    '    public String load(@Param("id") long id) throws Exception {',
    '        String head = "SELECT " + 1 + " x";',
    "        StringBuilder sql = new StringBuilder();",
    '        sql.append("SELECT * FROM TB_<<p>> a ");',
    '        sql.append("JOIN T_<<c7>> b ").append("ON a.id = b.id");',
    '        // sql.append("JOIN GONE g ");',
    "        if (id > 0) {",
    "            sql = new StringBuilder();",
    '            sql.append("UPDATE T_<<c9>> SET a = <<k>>");',
    "        }",
    '        sql.append(" WHERE 1 = 1 ");',
    "        return sql.toString();",
    "    }",
    "}",
)
DAO_FILE = _java_file(
    "import java.sql.Connection;",
    "import app.dao.Base<<c7>>;",
    "",
    "class Dao<<k>> extends BaseDao {",
    '    String status = "<<s>>";',
    "    List<Map<String, Long>> cache = new HashMap<>();",
    "",
    "    void fill(StringBuilder out) {",
    '        out.append("DELETE FROM T_<<c7>> ").append("WHERE k = <<k>>");',
    "    }",
    "",
    "    static class Inner<<k>> implements Runnable {",
    "        public void run() {",
    '            final StringBuilder q = new StringBuilder("-- ");',
    '            q.append("INSERT INTO TB_<<p>> ");',
    '            q.append("VALUES (").append(<<k>>).append(")");',
    "            String tail = q.toString();",
    '            for (int i = 0; i < 3; i++) { q.append(";"); }',
    "        }",
    "    }",
    "}",
)
REPOSITORY_FILE = _java_file(
    "package app.repo.r<<m>>;",
    "",
    "import org.data.JpaRepository;",
    "",
    "@Repository",
    "public interface Item<<k>>Repo extends JpaRepository<Item<<c>>, Long> {",
    '    @Query(value = "SELECT i FROM T_<<c7>> i", nativeQuery = true)',
    "    List<Item<<c>>> findAll();",
    "",
    "    @Modifying",
    '    @Query("DELETE FROM T_<<c9>>")',
    "    void deleteById(Long id);",
    "",
    '    Item<<c>> findById(@Param("id") Long id);',
    "}",
)

# Brackets nested `d` deep in every place that may hold them.
DEEP_FILE = _java_file(
    "package deep.p<<m>>;",
    "",
    "@Marks({<<repeat('@M({', d)>>1<<repeat('})', d)>>})",
    "class Deep<<k>> extends Base<<'<' || repeat('List<', d) || 'Long' || repeat('>', d) || '>'>> {",
    '    String[] sql = {"SELECT a FROM T_<<c7>>", "b"}; int[] none = {};',
    "    Object[] nest = new Object[] <<repeat('{', d + 1)>>\"x\"<<repeat('}', d + 1)>>;",
    "    int k = <<repeat('f(', d)>>1<<repeat(')', d)>>, m = 2;",
    "    <<repeat('Map<', d)>>Long<<repeat('>', d)>> run() {",
    "        StringBuilder sb = new StringBuilder();",
    "        sb.append(<<repeat('g(', d)>>\"SELECT b FROM \"<<repeat(')', d)>>)",
    '            /* two',
    '               lines */ .append("TB_").append("<<p>>")',
    '            .append(" b ")',
    '            .append("JOIN T_<<c7>>").append(" c");',
    "        if (<<repeat('(', d)>>a<<repeat(')', d)>>) { sb.append(\" \"); }",
    "    }",
    "}",
)
# A class with a table, a repository of it, and a class that calls both and others.
APP_ENTITY = _java_file(
    "package shop.model.m<<m>>;",
    "",
    "@Entity",
    '@Table(name = "TB_CUST_<<k>>")',
    "public class Cust<<k>> {",
    "    private String name;",
    "    public String label() { return name; }",
    "}",
)
APP_REPOSITORY = _java_file(
    "package shop.repo.m<<m>>;",
    "",
    "import shop.model.m<<m>>.Cust<<k>>;",
    "import org.data.JpaRepository;",
    "",
    "public interface Cust<<k>>Repo extends JpaRepository<Cust<<k>>, Long> {",
    "    List<Cust<<k>>> findTop5ByNameAndPhoneIsNotNullOrderByNameDesc(String name);",
    '    @Query(value = "SELECT * FROM TB_CUST_<<k>> c " + "JOIN TB_SEG_<<s>> s ON s.id = c.id", nativeQuery = true)',
    "    List<Cust<<k>>> listAll();",
    "    @Modifying",
    '    @Query("UPDATE Cust<<k>> c SET c.name = ?1")',
    "    int rename(String name);",
    "    long deleteByName(String name);",
    "}",
)
APP_SERVICE = _java_file(
    "package shop.service.m<<m>>;",
    "",
    "import shop.repo.m<<m>>.Cust<<k>>Repo;",
    "import shop.model.m<<m>>.*;",
    "",
    "public class Cust<<k>>Service {",
    "    private Cust<<k>>Repo repo;",
    "    private Cust<<k>> current;",
    "    private Audit<<k>> audit;",
    "",
    "    public void run(String name) {",
    "        repo.rename(name);",
    "        repo.save(current);",
    '        audit.note("repo.fake(" + current.label() + ")");',
    "        this.check(name);",
    "    }",
    "    private void check(String name) { Audit<<k>>.flush(name); missing.call(name); new Audit<<k>>(name); }",
    "}",
    "class Audit<<k>> { void note(String s) { } static void flush(String s) { } }",
)

VIEWS: dict[str, str] = {
    # Six shapes of line, four suffixes, 200 files.
    "src_lines": """
SELECT 'repo' AS repo_name, 'src/m' || (event_id % 20) AS file_path,
  'F' || (event_id % 200) || CASE event_id % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.sql' WHEN 2 THEN '.php' ELSE '.js' END AS file_name,
  CASE event_id % 4 WHEN 0 THEN 'java' WHEN 1 THEN 'sql' WHEN 2 THEN 'php' ELSE 'js' END AS ext,
  CAST(floor(event_id / 200) + 1 AS INT) AS line_number,
  CASE event_id % 6
   WHEN 0 THEN 'sql.append("SELECT a FROM ' || upper(event_type) || ', T_' || (user_id % 7) || ' t WHERE x = 1");'
   WHEN 1 THEN 'String q = "INSERT INTO ' || event_type || ' SELECT b FROM T_' || (user_id % 7) || ' ";'
   WHEN 2 THEN 'exec("DELETE FROM ' || upper(event_type) || ' ; UPDATE T_' || (user_id % 7) || ' SET a = 1"); log("T_1 JOIN x");'
   WHEN 3 THEN '// no literal FROM T_' || (user_id % 7)
   WHEN 4 THEN 'call("T_' || (user_id % 7) || '", ''(' || event_type || ')'', ''join T_' || (user_id % 7) || ' x'')'
   ELSE 'x = `merge into s.' || event_type || ' using T_' || (user_id % 7) || ' on a=b` + "from T_' || (user_id % 7) || '"' END AS line
FROM events""",
    "catalog": """
SELECT DISTINCT 'OWN_A' AS owner, 'TABLE' AS object_type, upper(event_type) AS object_name FROM events
UNION ALL SELECT DISTINCT 'OWN_B', 'VIEW', upper(event_type) FROM events
UNION ALL SELECT DISTINCT 'OWN_' || (user_id % 3),
  CASE user_id % 7 WHEN 0 THEN 'SYNONYM' WHEN 1 THEN 'MATERIALIZED VIEW' ELSE 'TABLE' END, 'T_' || (user_id % 7) FROM events
UNION ALL SELECT DISTINCT 'OWN_P', 'TABLE', 'TB_' || substr(o_orderpriority, 1, 1) FROM orders""",
    # A raw object list with mixed case, unknown types and repeated rows.
    "object_list": """
SELECT CASE p_size % 2 WHEN 0 THEN 'own_' ELSE 'OWN_' END || (p_size % 5) AS owner,
  CASE p_partkey % 9 WHEN 0 THEN 'Table' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'materialized view' WHEN 3 THEN 'LOB'
    WHEN 4 THEN 'PACKAGE BODY' WHEN 5 THEN 'SEQUENCE' WHEN 6 THEN 'INDEX' WHEN 7 THEN 'trigger' ELSE 'TABLE' END AS object_type,
  replace(p_name, ' ', '_') || '_' || (p_partkey % 50) AS object_name
FROM part""",
    "domain": """
SELECT 'R' || r_regionkey AS code, r_name AS name, CAST(NULL AS VARCHAR(10)) AS description, CAST(NULL AS VARCHAR(10)) AS parent_code FROM region
UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', 'R' || n_regionkey FROM nation
UNION ALL SELECT 'C' || c_custkey, c_name, c_mktsegment, 'N' || c_nationkey FROM customer""",
    # Rows that share a code: nations and customers with a second parent, so that some are reached in several ways.
    "shared_domain": """
SELECT 'R' || r_regionkey AS code, r_name AS name, CAST(NULL AS VARCHAR(10)) AS description, CASE r_regionkey WHEN 4 THEN 'R0' END AS parent_code FROM region
UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation', 'R' || n_regionkey FROM nation
UNION ALL SELECT 'N' || n_nationkey, n_name, 'again', 'N' || CAST(floor(n_nationkey / 3) AS INT) FROM nation WHERE n_nationkey % 3 = 2
UNION ALL SELECT 'C' || c_custkey, c_name, c_mktsegment, 'N' || c_nationkey FROM customer
UNION ALL SELECT 'C' || c_custkey, c_name, 'again', 'C' || CAST(floor(c_custkey / 4) AS INT) FROM customer WHERE c_custkey % 4 = 3""",
    "component": """
SELECT 'S' || s_suppkey AS code, s_name AS name, 'N' || s_nationkey AS domain_code, 'T' || (s_suppkey % 4) AS type_code,
  CASE WHEN s_suppkey = 0 THEN NULL ELSE 'S' || CAST(floor(s_suppkey / 3) AS INT) END AS parent_code FROM supplier""",
    "component_type": "SELECT DISTINCT 'T' || (s_suppkey % 4) AS code, 'Type ' || (s_suppkey % 4) AS name FROM supplier",
    "object_type": "SELECT DISTINCT p_type AS code, lower(p_type) AS name FROM part",
    "code_object": """
SELECT 'P' || p_partkey AS code, p_name AS name, p_type AS type_code, 'src/' || p_brand || '.java' AS source_file,
  CASE WHEN p_size < 3 THEN 'X' || p_size ELSE 'S' || (p_partkey % 100) END AS component_code FROM part""",
    "map": """
SELECT 'P' || l_partkey AS from_code, 'P' || l_suppkey AS to_code,
  CASE l_returnflag WHEN 'R' THEN 'read' WHEN 'A' THEN 'modify' ELSE 'call' END AS map_type, l_linestatus AS db_operation,
  'O' || l_orderkey AS file_path, 'L' || l_linenumber AS file_name, l_linenumber AS line_number FROM lineitem""",
    "java_files": f"""
SELECT 'repo' AS repo_name, 'src/p' || (k % 20) AS file_path, 'J' || k || '.java' AS file_name, 'java' AS ext,
  CASE k % 3 WHEN 0 THEN {ENTITY_FILE}
   WHEN 1 THEN {DAO_FILE}
   ELSE {REPOSITORY_FILE} END AS content
FROM (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 20 AS m, o_custkey % 5 AS c5, o_custkey % 7 AS c7,
  o_custkey % 9 AS c9, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM orders) o""",
}
_DEEP_KEYS = "SELECT p_partkey AS k, p_partkey % 61 AS d, p_partkey % 20 AS m, p_size % 7 AS c7, p_size % 5 AS p FROM part"
_APP_KEYS = "SELECT c_custkey AS k, c_custkey % 20 AS m, c_nationkey AS s FROM customer"
VIEWS["deep_files"] = f"""
SELECT 'repo' AS repo_name, 'deep' AS file_path, 'D' || k || '.java' AS file_name, {DEEP_FILE} AS content FROM ({_DEEP_KEYS}) deep"""
VIEWS["deep_keys"] = f"SELECT 'D' || k || '.java' AS file_name, deep.* FROM ({_DEEP_KEYS}) deep"
VIEWS["app_files"] = " UNION ALL ".join(
    f"SELECT 'repo' AS repo_name, '{folder}' AS file_path, 'Cust' || k || '{suffix}.java' AS file_name, {text} AS content FROM ({_APP_KEYS}) app"
    for folder, suffix, text in (("model", "", APP_ENTITY), ("repo", "Repo", APP_REPOSITORY), ("service", "Service", APP_SERVICE))
)
VIEWS["app_keys"] = f"""
SELECT k, m, s, 'shop.model.m' || m || '.Cust' || k AS entity, 'shop.repo.m' || m || '.Cust' || k || 'Repo' AS repository,
  'shop.service.m' || m || '.Cust' || k || 'Service' AS service, 'shop.service.m' || m || '.Audit' || k AS audit FROM ({_APP_KEYS}) app"""
# What a comparison needs to say which rows each Java file must give.
VIEWS["java_keys"] = """
SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 20 AS m, o_custkey % 5 AS c5, o_custkey % 7 AS c7, o_custkey % 9 AS c9,
  o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p, o_orderkey % 3 AS shape, 'J' || o_orderkey || '.java' AS file_name FROM orders"""


# Inputs whose rows cost far more to work on than to read.
HEAVY = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that has fewer tasks than cores, before text is read from it; else no change."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input `name` over the tables in `sf_dir`."""
    text = VIEWS[name]
    for base in TABLES:
        if re.search(rf"\bFROM {base}\b", text):
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(text)


def _over_spread(spark: SparkSession, sf_dir: str, base: str, columns: list[str], name: str) -> DataFrame:
    """A text input over narrow columns that are spread before any text is built."""
    spread(table(spark, sf_dir, base).select(*columns)).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def src_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_spread(spark, sf_dir, "events", ["event_id", "user_id", "event_type"], "src_lines")


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    return _over_spread(spark, sf_dir, "orders", columns, "java_files")


def deep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_spread(spark, sf_dir, "part", ["p_partkey", "p_size"], "deep_files")


def with_views(sql: str, *names: str) -> str:
    """`sql` with the derived inputs it reads put in front, for DuckDB."""
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in names)
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[len('WITH RECURSIVE'):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {sql.lstrip()[len('WITH '):]}"
    return f"WITH {head} {sql}"
