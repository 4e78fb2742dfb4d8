"""Catalog operators, upsert, hierarchy, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from sqltrail.operators import catalog as K
from sqltrail.operators import edges as E
from sqltrail.operators import hierarchy as H
from sqltrail.operators import report as P
from sqltrail.operators import upsert as U
from sqltrail.schemas import CATALOG_TABLES
from sqltrail.sources import buckets as B
from sqltrail.sources import files as S
from sqltrail.sources import sinks, tables

DOMAIN = "code string, name string, description string, parent_code string"


def test_domain_paths_leave_out_cycles(spark):
    domain = spark.createDataFrame(
        [("A", "a", None, None), ("B", "b", None, "A"), ("C", "c", None, "B"), ("D", "d", None, None), ("Z1", "z", None, "Z2"), ("Z2", "z", None, "Z1"), ("Q", "q", None, "gone")],
        DOMAIN,
    )
    paths = H.domain_paths(domain)
    assert [(r["code"], r["level"], r["path"]) for r in paths.collect()] == [
        ("A", 0, "A"), ("B", 1, "A->B"), ("C", 2, "A->B->C"), ("D", 0, "D"),
    ]
    assert {r["code"] for r in H.unreachable(domain, paths).collect()} == {"Z1", "Z2", "Q"}
    domain.createOrReplaceTempView("domain")
    assert H.run_sql(spark, H.DOMAIN_PATHS_SQL).collect() == paths.collect()


def test_deep_hierarchy(spark):
    domain = spark.createDataFrame([(f"n{i}", "x", None, f"n{i - 1}" if i else None) for i in range(40)], DOMAIN)
    deepest = H.domain_paths(domain).orderBy(F.col("level").desc()).first()
    assert (deepest["code"], deepest["level"], deepest["path"].count("->")) == ("n39", 39, 39)
    with pytest.raises(ValueError):
        H.domain_paths(domain, max_level=10)


def test_upsert_replaces_whole_rows(spark):
    existing = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "code string, name string, description string")
    incoming = spark.createDataFrame([("a", "9", 1), ("c", "5", 2), ("c", None, 3)], "code string, name string, ord int")
    got = sorted(tuple(r) for r in U.upsert(existing, incoming, ["code"], "ord").collect())
    assert got == [("a", "9", None), ("b", "2", "y"), ("c", None, None)]
    with pytest.raises(Exception, match="is NULL"):
        U.upsert(existing, spark.createDataFrame([(None, "9", 1)], "code string, name string, ord int"), ["code"], "ord").collect()


def test_upsert_with_one_hot_key(spark):
    existing = spark.range(1000).select("id", F.lit("old").alias("v"))
    incoming = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("id"), F.col("id").cast("string").alias("v"), F.col("id").alias("ord"))
    got = {r["id"]: r["v"] for r in U.upsert(existing, incoming, ["id"], "ord").collect()}
    assert len(got) == 2000 and got[7] == "3999" and got[4500] == "4500" and got[8] == "old"


def test_map_columns_and_nulls(spark):
    df = spark.createDataFrame([("1", "x", "", "12"), ("2", "y", "t", "1x")], "Code string, FROM string, start_type string, DURATION string")
    mapped = K.map_columns(df, {"from": "from_code", "Start_Type": "start_time"}, ["CODE"], {"duration": "int"})
    assert mapped.columns == ["from_code", "start_time", "duration"]
    assert [tuple(r) for r in K.empty_to_null(mapped).collect()] == [("x", None, 12), ("y", "t", None)]


def test_object_index(spark):
    objects = spark.createDataFrame([("O", "TABLE", "A"), ("O", "TABLE", "A"), ("O", "VIEW", "B")], "owner string, object_type string, object_name string")
    index = K.object_index(objects, "db")
    assert [r["name"] for r in K.index_get(index, "db", "O", "TABLE").collect()] == ["A"]
    assert K.index_get(index, "db", "O", "INDEX").count() == 0
    assert K.index_remove(index, "db", "O", "VIEW").count() == 1
    with pytest.raises(KeyError):
        K.index_remove(index, "db", "O", "INDEX")
    counts = K.catalog_kind_counts(objects).first()
    assert (counts["all"], counts["tables"], counts["views"], counts["grants"]) == (2, 1, 1, 0)


def test_edges_keep_the_last_and_wide_keys_keep_both(spark):
    refs = spark.createDataFrame(
        [("O", "X", "R", "l1", 1), ("O", "X", "M", "l2", 2), ("O", "Y", "", "l3", 3)],
        "owner string, object_name string, operation string, line string, line_number int",
    ).withColumns({"repo_name": F.lit("r"), "file_path": F.lit("p"), "file_name": F.lit("f")})
    edges = E.refs_to_edges(refs)
    narrow = E.build_edges(edges).collect()
    assert [(r["from_code"], r["to_code"], r["map_type"], r["line_text"]) for r in narrow] == [("r/p/f", "O.X", "modify", "l2")]
    assert E.build_edges(edges, E.WIDE_KEY).count() == 2
    assert E.build_edges(edges).columns == CATALOG_TABLES["map"].schema.fieldNames()
    assert E.bad_relationships(edges).count() == 0


def test_constraints(spark):
    bad = spark.createDataFrame([("a", "x", None, None), ("a", None, None, None)], DOMAIN)
    report = {r["constraint_name"]: r["violations"] for r in K.constraint_report(bad, CATALOG_TABLES["domain"]).collect()}
    assert report == {"not_null:code": 0, "not_null:name": 1, "primary_key:code": 1}


def test_workspace_order(spark, tmp_path):
    domains = spark.createDataFrame([("D1", "One"), ("D0", "Zero")], "code string, name string")
    components = spark.createDataFrame([("C1", "c", "D1"), ("C0", "c", "D1"), ("C9", "c", "gone")], "code string, name string, domain_code string")
    elements = spark.createDataFrame([("E1", "e", "Table", None, "C0"), ("E9", "e", "Table", None, "C9")], "code string, name string, type string, description string, component_code string")
    lines = P.render_workspace(domains, components, elements, "ws", "text")
    expected = [
        "workspace ws  text{", "  model {", "    properties {", '      "structurizr.groupSeparator" "/"', "    }",
        "    D0 = Group Zero {", "    }", "    D1 = Group One {", "      C0 = Component c {", '        E1 = Table e ""', "      }",
        "      C1 = Component c {", "      }", "    }", "  }", "}",
    ]
    assert [r["value"] for r in lines.collect()] == expected
    sinks.write_workspace(lines, str(tmp_path / "ws"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "ws").glob("part-*")))
    assert written.splitlines() == expected


def test_scan_sources(spark, tmp_path):
    root = tmp_path / "shop"
    (root / "a" / "b").mkdir(parents=True)
    (root / "a" / "X.JAVA").write_bytes("ação\r\nb".encode("windows-1252"))
    (root / "a" / "b" / "y.java").write_bytes("ação".encode())
    (root / "q.SqL").write_text("select")
    (root / "n.txt").write_text("no")
    found = {r["file_name"]: r for r in S.scan_sources(spark, str(root)).collect()}
    assert sorted(found) == ["X.JAVA", "q.SqL", "y.java"]
    assert found["X.JAVA"]["content"] == "ação\nb" and found["y.java"]["content"] == "ação"
    assert (found["y.java"]["repo_name"], found["y.java"]["file_path"], found["y.java"]["ext"]) == ("shop", str(root / "a" / "b"), "java")
    only = S.scan_sources(spark, str(root), exts=("java",), ignore_case=False)
    assert [r["file_name"] for r in only.collect()] == ["y.java"]
    lines = S.scan_lines(spark, str(root)).filter("file_name = 'X.JAVA'").orderBy("line_number").collect()
    assert [(r["line_number"], r["line"]) for r in lines] == [(1, "ação"), (2, "b")]
    with pytest.raises(Exception, match="utf-8"):
        S.scan_sources(spark, str(root), encoding="utf-8").collect()


def test_read_catalog(spark, tmp_path):
    path = tmp_path / "objects.csv"
    path.write_text("OBJECT_NAME,OWNER,X,OBJECT_TYPE\ntb_a,own,1,Table\nTB_A,OWN,2,TABLE\nV,other,3,view\nL,OWN,4,LOB\n")
    read = lambda **k: sorted(tuple(r) for r in tables.read_catalog(spark, str(path), **k).collect())
    assert read(owners={"OWN"}) == [("OWN", "LOB", "L"), ("OWN", "TABLE", "TB_A")]
    assert read(owners={"own"}) == []
    assert read(mode="known_types") == [("OTHER", "VIEW", "V"), ("OWN", "TABLE", "TB_A")]
    assert read(mode="relations", owner="Own") == [("OWN", "TABLE", "TB_A"), ("own", "Table", "TB_A")]
    assert read(mode="relations", owner="own", upper_names=False) == [("OWN", "TABLE", "TB_A"), ("own", "Table", "tb_a")]


def test_load_plan(spark, tmp_path):
    first = tmp_path / "d.csv"
    first.write_text("CODE;Name;description;parent_code\na;A;;\nb;B;text;a\na;A2;;\n")
    second = tmp_path / "d2.csv"
    second.write_text("b;BB\nc;\"C;c\"\n")
    third = tmp_path / "m.csv"
    third.write_text("code;from;to;map_type;start_type;duration\n1;a;b;read;s;5\n2;a;b;modify;;x\n")
    folder = str(tmp_path / "db")
    tables.load_all(
        spark,
        [
            tables.CsvInfo(str(first), "TB_DOMAIN"),
            tables.CsvInfo(str(second), "TB_DOMAIN", has_header=False, column_order=["code", "name"]),
            tables.CsvInfo(str(third), "TB_MAP", exclude_columns=["CODE"], column_mapping={"from": "from_code", "to": "to_code", "start_type": "start_time"}),
        ],
        folder,
    )
    domain = sorted(tuple(r) for r in U.read_table(spark, f"{folder}/domain").collect())
    assert domain == [("a", "A2", None, None), ("b", "BB", None, None), ("c", "C;c", None, None)]
    edge = U.read_table(spark, f"{folder}/map").first()
    assert (edge["map_type"], edge["start_time"], edge["duration"]) == ("modify", None, None)
    broken = tmp_path / "bad.csv"
    broken.write_text("code;name\nq;\n")
    with pytest.raises(ValueError, match="not_null:name"):
        tables.load_all(spark, [tables.CsvInfo(str(broken), "TB_DOMAIN")], folder)
    assert U.newest_version(spark, f"{folder}/domain") == 1


def test_report_files(spark, tmp_path):
    refs = spark.createDataFrame(
        [("O", "X", "TABLE", 'a("q, r")', 3, "p", "f", "r", "", "R")],
        "owner string, object_name string, object_type string, line string, line_number int, file_path string, file_name string, repo_name string, valid string, operation string",
    ).coalesce(1)
    sinks.write_refs_csv(refs, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == 'Owner,Object Name,Object Type,Line,Line Number,File Path,File Name,Repo Name,Valid,Operation\nO,X,TABLE,"a(""q, r"")",3,p,f,r,,R\n'
    sinks.write_refs_csv(refs, str(tmp_path / "rw"), layout="rw")
    assert "Valid,Read,Modify" in next((tmp_path / "rw").glob("part-*.csv")).read_text()


def test_register_catalog(spark):
    K.register_catalog(spark)
    assert spark.sql("SELECT * FROM vw_domain").columns == ["code", "name", "description", "parent_code"]
    assert spark.table("map").count() == 0
    K.drop_catalog(spark)
    assert not spark.catalog.tableExists("vw_domain")


def test_line_ends_in_quoted_fields(spark, tmp_path):
    objects = tmp_path / "o.csv"
    objects.write_text('OWNER,OBJECT_NAME,OBJECT_TYPE,NOTE\nA,X,TABLE,"two\nlines"\nA,Y,VIEW,plain\n')
    assert sorted(tuple(r) for r in tables.read_catalog(spark, str(objects), owners={"A"}).collect()) == [("A", "TABLE", "X"), ("A", "VIEW", "Y")]
    rows = tmp_path / "d.csv"
    rows.write_text('code;name;description;parent_code\na;A;"two\nlines";\nb;B;;a\na;A2;"last\none";\n')
    info = tables.CsvInfo(str(rows), "domain")
    read = tables.read_mapped_csv(spark, info).collect()
    assert [tuple(r) for r in read] == [("a", "A", "two\nlines", None), ("b", "B", None, "a"), ("a", "A2", "last\none", None)]
    written = tables.load_all(spark, [info], str(tmp_path / "db"))
    got = sorted(tuple(r) for r in spark.read.parquet(written["domain"]).collect())
    assert got == [("a", "A2", "last\none", None), ("b", "B", None, "a")]


def test_reachable_cycle_ends(spark):
    rows = [("A", "a", None, None), ("B", "b", None, "A"), ("C", "c", None, "B"), ("B", "b", None, "C")]
    found = H.domain_paths(spark.createDataFrame(rows, DOMAIN)).collect()
    assert [(r["code"], r["level"]) for r in found] == [("A", 0), ("B", 1), ("C", 2)]


def test_paths_over_several_parents(spark):
    rows = [("R", "r", None, None), ("Y", "y", None, "R"), ("X", "x", None, "R"), ("X", "x2", None, "Y"), ("Z", "z", None, "X"), (None, "n", None, "X"), ("S", "s", None, "S")]
    domain = spark.createDataFrame(rows, DOMAIN)
    found = H.domain_paths(domain).collect()
    assert sorted((r["path"] or "", r["name"], r["level"]) for r in found) == [
        ("", "n", 2), ("", "n", 3), ("R", "r", 0), ("R->X", "x", 1), ("R->X->Z", "z", 2), ("R->Y", "y", 1), ("R->Y->X", "x2", 2), ("R->Y->X->Z", "z", 3),
    ]
    domain.createOrReplaceTempView("domain")
    assert sorted(map(repr, H.run_sql(spark, H.DOMAIN_PATHS_SQL).collect())) == sorted(map(repr, found))


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    domain = spark.createDataFrame([(f"n{i}", "x", None, f"n{i - 1}" if i else None) for i in range(2000)], DOMAIN)
    found = H.domain_paths(domain)
    assert found.agg(F.max("level"), F.count("*")).first()[:] == (1999, 2000)
    assert len(rounds) < 50


def test_run_sql_leaves_settings(spark):
    key = "spark.sql.cteRecursionLevelLimit"
    before = spark.conf.get(key, None)
    assert H.run_sql(spark, "SELECT 1 AS a", max_levels=7).collect()[0]["a"] == 1
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        H.run_sql(spark, "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT * FROM t", max_levels=7)
    assert spark.conf.get(key, None) == before


# --- bucketed tables and load plans ---


def bucket_load(spark, rows):
    incoming = spark.createDataFrame(rows, "id long, v string, ord int")
    return B.Load(incoming, ["id"], "ord", spark.createDataFrame([], "id long, v string, w int").schema)


def places(spark, folder, version):
    return {(r["table_name"], r["bucket"]): r["path"] for r in spark.read.parquet(f"{folder}/versions/v={version}").collect()}


def test_load_touches_only_its_buckets(spark, tmp_path):
    folder = str(tmp_path / "db")
    schema = bucket_load(spark, []).schema
    read = lambda name, version=None: sorted(tuple(r) for r in B.read_bucketed(spark, folder, name, schema, version).collect())
    assert read("a") == []
    assert B.load_tables(spark, folder, {"a": bucket_load(spark, [(i, f"a{i}", 0) for i in range(1000)]), "b": bucket_load(spark, [(1, "b", 0)])}, buckets=16) == 0
    # A hot key, and a new one.
    assert B.load_tables(spark, folder, {"a": bucket_load(spark, [(7, f"x{i}", i) for i in range(500)] + [(5000, None, 1)])}, buckets=99) == 1
    wanted = {i: f"a{i}" for i in range(1000)} | {7: "x499", 5000: None}
    assert read("a") == sorted((k, v, None) for k, v in wanted.items())
    assert read("a", 0) == [(i, f"a{i}", None) for i in range(1000)]
    assert read("b") == [(1, "b", None)]
    before, after = places(spark, folder, 0), places(spark, folder, 1)
    assert len(before) == len(after) == 17
    assert 1 <= sum(before[k] != after[k] for k in before) <= 2
    # A load without rows changes nothing.
    B.load_tables(spark, folder, {"a": bucket_load(spark, [])})
    assert places(spark, folder, 2) == after
    gone = B.remove_old(spark, folder, keep=2)
    assert gone == sorted(set(before.values()) - set(after.values()))
    assert read("a") == sorted((k, v, None) for k, v in wanted.items())


def test_failed_load_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "db")
    schema = bucket_load(spark, []).schema
    B.load_tables(spark, folder, {"a": bucket_load(spark, [(1, "a", 0)])})
    with pytest.raises(Exception, match="key column id is NULL"):
        B.load_tables(spark, folder, {"a": bucket_load(spark, [(2, "b", 0), (None, "c", 0)]), "b": bucket_load(spark, [(1, "b", 0)])})
    assert U.newest_version(spark, f"{folder}/versions") == 0
    assert B.read_bucketed(spark, folder, "a", schema).collect()[0]["v"] == "a"
    assert B.read_bucketed(spark, folder, "b", schema).count() == 0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        B.publish(spark, folder, 0, [("a", 1, 0, "x")])


PLAN = """
database_uri: ignored
csv_files_info:
  - csv_file: objects.csv
    separator: ';'
    has_header: true
    table_name: TB_CODE_OBJECT
    column_mapping:
      code: {name: code, type: String}
      system_component_code: {name: component_code, type: String}
      type: type_code
  - {csv_file: components.csv, table_name: TB_COMPONENT}
  - {csv_file: map.csv, table_name: TB_MAP, exclude_columns: [code], column_mapping: {from: from_code, to: to_code}}
  - {csv_file: kinds.csv, table_name: TB_OBJECT_TYPE, has_header: false, column_order: [code, name]}
  - {csv_file: domains.csv, table_name: TB_DOMAIN}
  - {csv_file: types.csv, table_name: TB_COMPONENT_TYPE}
"""
PLAN_FILES = {
    "objects.csv": "code;name;type;source_file;system_component_code\no1;O1;k;f;c1\no2;O2;k;;c1\n",
    "components.csv": "code;name;domain_code;type_code;parent_code\nc1;C1;d2;t;\n",
    "map.csv": "code;from;to;map_type;duration\n1;o1;o2;read;5\n2;o1;o2;modify;x\n",
    "kinds.csv": "k;Kind\n",
    "domains.csv": "code;name;description;parent_code\nd1;D1;;\nd2;D2;;d1\n",
    "types.csv": "code;name\nt;T\n",
}


def test_load_plan_of_six_tables(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in PLAN_FILES.items():
        (tmp_path / name).write_text(text)
    folder = str(tmp_path / "db")
    infos = tables.read_plan(PLAN, str(tmp_path))
    assert tables.load_plan(spark, infos, folder, buckets=4) == 0
    read = lambda name: sorted(map(tuple, B.read_bucketed(spark, folder, name, CATALOG_TABLES[name].schema).collect()))
    assert read("code_object") == [("o1", "O1", "k", "f", "c1"), ("o2", "O2", "k", None, "c1")]
    assert [r[:3] + r[7:8] for r in read("map")] == [("o1", "o2", "modify", None)]
    state = {name: read(name) for name in CATALOG_TABLES}
    # In any order the same, and again without a change.
    assert tables.load_plan(spark, infos[::-1], str(tmp_path / "db2"), buckets=4) == 0
    folder2, folder = folder, str(tmp_path / "db2")
    assert {name: read(name) for name in CATALOG_TABLES} == state
    # One file without a name, then one with a domain that is not there: nothing changes, other tables included.
    (tmp_path / "kinds.csv").write_text("k;Other\n")
    folder = folder2
    (tmp_path / "types.csv").write_text("code;name\nt;\n")
    with pytest.raises(ValueError, match="types.csv: not_null:name"):
        tables.load_plan(spark, infos, folder)
    (tmp_path / "types.csv").write_text("code;name\nt;T\n")
    (tmp_path / "components.csv").write_text("code;name;domain_code;type_code;parent_code\nc2;C2;nowhere;t;\n")
    with pytest.raises(ValueError, match="component: domain_code nowhere has no parent"):
        tables.load_plan(spark, infos, folder)
    assert {name: read(name) for name in CATALOG_TABLES} == state
    tables.load_plan(spark, infos, folder, check_keys=False)
    assert read("object_type") == [("k", "Other")] and len(read("component")) == 2


def test_plan_texts(spark, tmp_path):
    text = '{"csv_files_info": [{"csv_file": "a.csv", "table_name": "domain", "column_mapping": {"x": {"name": "code"}, "y": "name"}}]}'
    info = tables.read_plan(text, "/data")[0]
    assert (info.csv_file, info.separator, info.column_mapping) == ("/data/a.csv", ";", {"x": "code", "y": "name"})
    for broken in ("[]", '{"csv_files_info": [{"csv_file": "a"}]}', text.replace("domain", "nothing"), text.replace('"csv_file"', '"delimiter": 1, "csv_file"')):
        with pytest.raises(ValueError):
            tables.read_plan(broken)
    # Two files for one table: the later one wins.
    (tmp_path / "a.csv").write_text("code;name\na;A\nb;B\n")
    (tmp_path / "b.csv").write_text("code;name;description\na;A2;d\n")
    infos = [tables.CsvInfo(str(tmp_path / f), "domain") for f in ("a.csv", "b.csv")]
    tables.load_plan(spark, infos, str(tmp_path / "db"))
    rows = B.read_bucketed(spark, str(tmp_path / "db"), "domain", CATALOG_TABLES["domain"].schema).collect()
    assert sorted(map(tuple, rows)) == [("a", "A2", "d", None), ("b", "B", None, None)]
    (tmp_path / "b.csv").write_text("code;description\na;d\n")
    with pytest.raises(ValueError, match="no column name"):
        tables.load_plan(spark, infos, str(tmp_path / "db"))
