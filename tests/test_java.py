"""Java text to declarations, string variables and SQL texts."""

from pyspark.sql import functions as F

from sqltrail.operators import java as J
from sqltrail.operators import report as P

SCHEMA = "repo_name string, file_path string, file_name string, content string"


def stmts(spark, *contents):
    return J.statements(spark.createDataFrame([("r", "p", f"f{i}", c) for i, c in enumerate(contents)], SCHEMA))


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


SCOPED = """class A {
  void f(StringBuilder out) {
    StringBuilder sb = new StringBuilder();
    sb.append("a1 ");
    if (x) { StringBuilder sb = new StringBuilder(); sb.append("b1 "); while (y) { sb.append("b2 "); } }
    else sb.append("a2 ");
    sb = new StringBuilder();
    sb.append("c1 ").append(x).append("c2 " + y + "c3 ");
    out.append("o1 ");
    /* sb.append("no"); */ // sb.append("no")
    log("sb.append(\\"no\\")");
    for (String s : list) { sb.append('"'); sb.append("c4; } "); }
  }
  void g() { sb.append("lost "); StringBuilder a = new StringBuilder(), b = new StringBuilder(); b.append("z"); }
}"""


def test_builders_by_scope(spark):
    found = J.string_builders(stmts(spark, SCOPED))
    assert rows(found, "variable", "line_number", "appends", "content") == [
        ("a", 14, 0, ""), ("b", 14, 1, "z"), ("out", None, 1, "o1 "), ("sb", 3, 2, "a1 a2 "), ("sb", 5, 2, "b1 b2 "),
        ("sb", 7, 5, "c1 c2 c3 c4; } "), ("sb", None, 1, "lost "),
    ]


def test_first_declaration_of_a_scope_wins(spark):
    found = J.string_builders(stmts(spark, SCOPED), by="first").filter("variable = 'sb' and line_number is not null")
    assert rows(found, "line_number", "content") == [
        (3, "a1 a2 c1 c2 c3 c4; } "), (5, "b1 b2 "),
    ]


def test_builders_by_name_share_first_arguments(spark):
    code = """class A { void f() { StringBuilder q = new StringBuilder();
      q.append("a").append("skipped"); q.append(5); q.append(x); q.append("b" + x);
      if (c) { StringBuilder q = new StringBuilder(); q.append("d"); } } }"""
    found = J.string_builders(stmts(spark, code), by="name")
    assert rows(found, "method_name", "line_number", "content") == [("f", 1, "a5d"), ("f", 3, "a5d")]


def test_builder_as_a_field_is_not_a_local(spark):
    found = J.string_builders(stmts(spark, 'class A { StringBuilder f = new StringBuilder(); void g() { f.append("x"); } }'))
    assert rows(found, "variable", "line_number", "content") == [("f", None, "x")]


def test_string_locals_modes(spark):
    code = 'class A { void f() { String a = "x " + 1 + y + "z", b; final String c = g("k", 2); String d = "p" + \'q\'; } }'
    found = {mode: rows(J.string_locals(stmts(spark, code), mode), "variable", "content") for mode in ("literals", "text", "raw")}
    assert found["literals"] == [("a", "x 1z"), ("c", "k2"), ("d", "p'q'")]
    assert found["raw"] == [("a", '"x "+1+y+"z"'), ("c", 'g("k",2)'), ("d", "\"p\"+'q'")]
    assert found["text"] == [("a", 'x "+1+y+"z'), ("c", 'g("k",2)'), ("d", "p\"+'q'")]


def test_declarations(spark):
    code = '''package a.b;
import x.y.*; import static z.W.m;
/** class Doc { */
public @Marker("a;{") abstract class Outer<T extends Comparable<T>> extends Base<T, Map<K, V>>
    implements I, J<T> {
  @A @B(x = "1, 2", y = {"p", "q"})
  private Map<String, List<Integer>> m = new HashMap<>(), n;
  int[] k = {1, 2};
  Runnable r = new Runnable() { public void run() { int z = 1; } };
  static { init(); }
  enum E { ONE, TWO; int code; }
  protected <R> List<R> go(@P("x") final R a, int... b) throws IOException, X { if (a) { return null; } }
  Outer() { this(1); }
  interface In extends One, Two<Q> { int size(); default void d() { } }
}'''
    parsed = stmts(spark, code)
    assert rows(J.imports(parsed), "import_name", "line_number") == [("x.y", 2), ("z.W.m", 2)]
    types = J.type_decls(parsed)
    assert rows(types, "type_name", "kind", "line_number") == [("In", "interface", 14), ("Outer", "class", 4)]
    outer = types.filter("type_name = 'Outer'").first()
    assert [(e["name"], e["generics"]) for e in outer["extends"]] == [("Base", ["T", "Map<K,V>"])]
    assert outer["implements"] == ["I", "J<T>"]
    assert [(a["name"], a["arguments"]) for a in outer["annotations"]] == [("Marker", '("a;{")')]
    inner = types.filter("type_name = 'In'").first()
    assert [(e["name"], e["generics"]) for e in inner["extends"]] == [("One", []), ("Two", ["Q"])]
    assert rows(J.methods(parsed), "type_name", "method_name", "return_type", "line_number") == [
        ("In", "d", "void", 14), ("In", "size", "int", 14), ("Outer", "Outer", "", 13), ("Outer", "go", "List<R>", 12),
        ("Outer", "run", "void", 9),
    ]
    assert rows(J.fields(parsed), "type_name", "field_name", "field_type", "line_number") == [
        ("E", "code", "int", 11), ("Outer", "k", "int[]", 8), ("Outer", "m", "Map<String,List<Integer>>", 7),
        ("Outer", "n", "Map<String,List<Integer>>", 7), ("Outer", "r", "Runnable", 9),
    ]
    marks = J.annotations(parsed).filter("target = 'field'").orderBy("ordinal").collect()
    assert [(m["name"], m["line_number"]) for m in marks] == [("A", 6), ("B", 6)]
    assert [(p["key"], p["value"]) for p in marks[1]["parameters"]] == [("x", '"1, 2"'), ("y", '{"p","q"}')]
    assert J.annotations(parsed).filter("name = 'P'").count() == 0


def test_entity_needs_both_annotations(spark):
    code = '@Entity @Table(schema="S", name="TB_X") class A { } @Entity class B { } @Table(name="N") class C { }'
    found = J.entity_tables(stmts(spark, "package q;\n" + code, code))
    assert rows(found, "file_name", "entity", "table_name") == [("f0", "q.A", "TB_X"), ("f1", "A", "TB_X")]


def test_annotation_classes(spark):
    names = spark.createDataFrame([("NamedQuery",), ("@Procedure",), ("Other",)], "name string")
    assert rows(J.annotation_class(names), "name", "annotation_class") == [
        ("@Procedure", "CALL"), ("NamedQuery", "ENTITY"), ("NamedQuery", "QUERY"),
    ]


def test_flush_and_delete_are_methods_of_interest(spark):
    names = spark.createDataFrame([("flush",), ("delete",), ("flushdelete",), ("findAll",), ("append",)], "n string")
    assert rows(names.filter(J.is_method_of_interest(F.col("n"))), "n") == [("append",), ("delete",), ("findAll",), ("flush",)]


def test_long_and_broken_files(spark):
    long = "class A { String s = \"" + "x" * 300_000 + "\"; /* " + "y" * 300_000 + " */ void f() { g('" + "\\\\" * 50_000 + "'); } }"
    many = "class A { void f() {" + "a();" * 20_000 + "} }"
    broken = 'class A { String s = "open; \n void f() { /* never closed'
    found = stmts(spark, long, many, broken, "", "no statement")
    counts = {r["file_name"]: r["count"] for r in found.groupBy("file_name").count().collect()}
    assert counts == {"f0": 6, "f1": 20_004, "f2": 4, "f4": 1}


def test_one_shuffle(spark):
    plan = J.string_builders(stmts(spark, SCOPED))._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1, plan


def test_described_document(spark):
    from sqltrail.operators.report import describe_documents

    code = """package p.q;
import a.B; import c.D;
@Entity @Table(name = "T", schema = "S") class A extends Base<X, Y> implements I {
  @Id int id = 1; String none;
  @Override void go() { }
}"""
    text = describe_documents(J.file_documents(stmts(spark, code))).first()["description"]
    assert text.split("\n") == [
        "Package: p.q", "Imports: a.B, c.D", "Class: A", "Annotation: Entity with no parameters",
        'Annotation: Table with parameters: [name: "T", schema: "S"]', "  Extends: Base<X, Y>", "  Implements: I",
        "  Fields:", "    id,  Type: int, Value: 1", "      Annotation: Id", "    none,  Type: String, Value: None",
        "  Methods:", "    go,  Return Type: void", "      Annotation: Override",
    ]


def test_deep_nesting(spark):
    for depth in (6, 30):
        call = "g(" * depth + '"deep "' + ")" * depth
        kept = "Map<Long, " * depth + "Set<Long>" + ">" * depth
        parsed = stmts(spark, f'class A {{ {kept} kept; {kept} h(int a) {{ sb.append({call}).append("after"); }} }}').cache()
        assert rows(J.string_builders(parsed), "content") == [("deep after",)]
        assert rows(J.fields(parsed), "field_name", "field_type") == [("kept", kept.replace(" ", ""))]
        assert rows(J.methods(parsed), "method_name", "return_type") == [("h", kept.replace(" ", ""))]


def test_brackets_of_any_depth(spark):
    for depth in (8, 9, 200):
        call = "g(" * depth + '"deep "' + ")" * depth
        array = "{" * depth + '"x", 1' + "}" * depth
        kept = "Map<Long, " * depth + "Set<Long>" + ">" * depth
        mark = '@M({' * depth + '"a;{"' + '})' * depth
        code = (
            f"@Named({{{mark}}}) class A extends B<{kept}> {{ String[][] q = {array}; {kept} kept = f({call}, 2), other; {kept} h({kept} a) {{ "
            f'StringBuilder sb = new StringBuilder(); sb.append({call}).append("after"); use(new int[] {array}, x); if (a < b && c < d) {{ sb.append(";"); }} }} }}'
        )
        parsed = stmts(spark, code).cache()
        assert rows(J.string_builders(parsed), "line_number", "appends", "content") == [(1, 3, "deep after;")]
        flat = kept.replace(" ", "")
        assert rows(J.fields(parsed), "field_name", "field_type", "value") == [
            ("kept", flat, f"f({call},2)"), ("other", flat, None), ("q", "String[][]", array.replace(" ", "")),
        ]
        assert rows(J.methods(parsed), "method_name", "return_type") == [("h", flat)]
        assert rows(J.scopes(parsed), "level", "kind", "name") == [(1, "type", "A"), (2, "method", "h"), (3, "block", "")]
        (kind,) = J.type_decls(parsed).collect()
        assert kind["extends"] == [("B", [flat])] and kind["annotations"][0]["arguments"] == f"({{{mark}}})"


def test_folding_changes_nothing_else(spark):
    from sqltrail.functions import java as JF

    texts = [
        'class A { int[] a = {1, {2}}; /* ( { < */ String s = "((((((((((("; char c = \'(\'; }', "f(" * 12 + "x -> { y(); }" + ")" * 12 + "; g(1);",
        "a < b; c < d; e << 3 >>> 2; List<List<X>> l;", ")))) }}}} >>>> ((((", "", "@A(@A(@A(@A(@A(@A(@A(@A(@A(@A(x = {1, 2}))))))))))) class B { }" + "z" * 5000,
    ]
    long = "".join(f"call{i}({'h(' * 11}{i}{')' * 11}); " for i in range(500))
    frame = spark.createDataFrame([(t,) for t in [*texts, long]], "content string")
    folded = frame.select("content", JF.fold(F.col("content")).alias("folded")).select("content", JF.unfold(F.col("folded")).alias("back"), "folded")
    for row in folded.collect():
        assert row["back"] == row["content"]
        assert len(row["folded"]) == len(row["content"])
    assert folded.where("content = folded").count() == 4


def test_lines_of_fragments(spark):
    from sqltrail.operators import builders

    code = """class A {
  void f() {
    StringBuilder sql = new StringBuilder("x");
    sql.append("SELECT a, ")
       .append("b ") // JOIN GONE x
       /* two
          lines */ .append(" FROM ")
       .append("TB_X")
       .append(" x JOIN TB_Y y ");
    if (q) { sql.append("JOIN " + z + "TB_").append("X").append(" w"); }
    out.append("UPDATE TB_Z SET a = '").append(v).append("'; DELETE FROM TB_X");
  }
}"""
    found = builders.builder_hits(stmts(spark, code))
    assert rows(found, "variable", "operation", "table_name", "line_number", "line") == sorted([
        ("out", "M", "TB_X", 11, "'; DELETE FROM TB_X"), ("out", "M", "TB_Z", 11, "UPDATE TB_Z SET a = '"), ("sql", "R", "TB_X", 8, "TB_X"),
        ("sql", "R", "TB_X", 10, "TB_"), ("sql", "R", "TB_Y", 9, " x JOIN TB_Y y "),
    ], key=repr)
    catalog = spark.createDataFrame(
        [("A", "VIEW", "tb_x"), ("A", "TABLE", "TB_X"), ("B", "MATERIALIZED VIEW", "TB_X"), ("B", "LOB", "TB_Y"), ("A", "TABLE", "TB_Z")],
        "owner string, object_type string, object_name string",
    )
    refs = builders.builder_refs(stmts(spark, code), catalog)
    assert rows(refs, "owner", "object_name", "object_type", "operation", "line_number") == sorted([
        ("A", "TB_X", "TABLE", "M", 11), ("A", "TB_X", "TABLE", "R", 8), ("A", "TB_X", "TABLE", "R", 10), ("A", "TB_Z", "TABLE", "M", 11),
        ("B", "TB_X", "MATERIALIZED VIEW", "M", 11), ("B", "TB_X", "MATERIALIZED VIEW", "R", 8), ("B", "TB_X", "MATERIALIZED VIEW", "R", 10),
    ], key=repr)
    assert rows(builders.builder_edges(builders.builder_refs(stmts(spark, code), catalog, owners=["A"])), "from_code", "to_code", "map_type", "line_number") == [
        ("r/p/f0", "A.TB_X", "modify", 11), ("r/p/f0", "A.TB_Z", "modify", 11),
    ]


def test_derived_names(spark):
    from sqltrail.functions.derived import derived_query

    names = {
        "findByName": ("read", False, None, ["name"], []),
        "findFirstByNameAndAgeGreaterThanEqualOrderByNameDescAgeAsc": ("read", False, 1, ["name", "age"], ["name desc", "age asc"]),
        "readTop10DistinctByAddressZipCodeInOrLastNameIgnoreCase": ("read", True, 10, ["addressZipCode", "lastName"], []),
        "countByActiveTrue": ("count", False, None, ["active"], []),
        "existsByAndroidIdIsNotNull": ("exists", False, None, ["androidId"], []),
        "removeAllByOrderDateBefore": ("delete", False, None, ["orderDate"], []),
        "findAllByOrderByNameDesc": ("read", False, None, [], ["name desc"]),
        "findAll": ("read", False, None, [], []),
        "deleteAll": ("delete", False, None, [], []),
        "getaway": None, "findings": None, "save": None,
    }
    frame = spark.createDataFrame([(n,) for n in names], "name string").select("name", derived_query(F.col("name")).alias("q"))
    found = {r["name"]: None if r["q"] is None else (r["q"]["action"], r["q"]["is_distinct"], r["q"]["most"], r["q"]["properties"], r["q"]["ordered"]) for r in frame.collect()}
    assert found == names


def test_names_across_files(spark):
    from sqltrail.operators import definitions as D

    files = (
        "package a; import b.Wide; import c.*; class One { Wide w; Far far; Lost lost; Same same; d.Exact exact; void go() { w.run(); far.run(); lost.run(); same.run(); exact.run(); Same.none(); } }",
        "package a; class Same { void run() { } }",
        "package b; class Wide { void run() { go(); new Wide(); } void go() { } }",
        "package c; class Far { void run() { } } class Wide { void run() { } }",
        "package d; class Exact { void run() { } }",
        "class Bare { Bare b; void run() { b.run(); } }",
        "// only a comment",
    )
    found = D.definition_edges(stmts(spark, *files))
    assert rows(found, "from_code", "to_code", "map_type") == sorted([
        ("a.One.go", "b.Wide.run", "call"), ("a.One.go", "c.Far.run", "call"), ("a.One.go", "a.Same.run", "call"), ("a.One.go", "d.Exact.run", "call"),
        ("b.Wide.run", "b.Wide.go", "call"), ("Bare.run", "Bare.run", "call"),
    ], key=repr)
    assert D.repository_methods(stmts(spark, *files)).count() == 0


def test_documents_of_all_files_and_fields(spark):
    found = J.file_documents(stmts(spark, "// a comment", "class A { @Id int a = 1, b; }", "import x.Y;"))
    assert rows(found.selectExpr("file_name", "imports", "types.name as types", "flatten(types.fields).name as fields"), "file_name", "imports", "types", "fields") == [
        ("f0", [], [], []), ("f1", [], ["A"], ["a", "b"]), ("f2", ["x.Y"], [], []),
    ]


def test_files_are_left_out_before_the_shuffle(spark):
    files = spark.createDataFrame([("r", "p", "f0", "@Entity class A { }"), ("r", "p", "f1", "class B { }")], SCHEMA)
    found = J.statements(files, containing=("@Entity", "gone"))
    assert {r["file_name"] for r in found.select("file_name").collect()} == {"f0"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.rindex("Contains")


def test_usage_of_a_file_in_one_row(spark):
    from sqltrail.operators import usage as U

    files = spark.createDataFrame([("r", "p", "f", 'a("SELECT x FROM TB_A");\nb("UPDATE TB_B"); TB_A\n TB_C')], SCHEMA)
    catalog = spark.createDataFrame([("O", "TABLE", n) for n in ("TB_A", "TB_B", "TB_C")], "owner string, object_type string, object_name string")
    assert rows(U.usage_simple(files, catalog), "table_name", "lines", "read", "modified") == [
        ("TB_A", [1, 2], True, True), ("TB_B", [2], True, True), ("TB_C", [3], True, True),
    ]
    plan = U.classify_file_usage(files, catalog)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(repo_name" not in plan and plan.count("Join") == 1


def test_method_documents(spark):
    text = """class A {
  abstract int none();
  void empty() {}
  void run() {
    String a = "x" + "y", b;
    if (t) {
      StringBuilder sb = new StringBuilder();
      while (u) { String c = "z"; sb.append("1"); }
      sb.append("2");
    }
    Runnable r = new Runnable() {
      String field = "no";
      public void go() { String d = "in"; }
    };
    { String e = "last"; }
  }
}
"""
    files = spark.createDataFrame([("r", "p", "A.java", text), ("r", "p", "Empty.java", ""), ("r", "p", "N.java", None)], "repo_name string, file_path string, file_name string, content string")
    found = {r["method_name"]: r["scopes"] for r in J.method_documents(J.statements(files)).collect()}
    assert set(found) == {"empty", "run", "go"}
    flat = lambda name: [(s["parent"], s["kind"], s["line_number"], [tuple(v) for v in s["strings"]], [tuple(v) for v in s["builders"]]) for s in found[name]]
    assert flat("empty") == [(None, "method", 3, [], [])]
    assert flat("run") == [
        (None, "method", 4, [("a", 5, "xy")], []),
        (0, "block", 6, [], [("sb", 7, 2, "12")]),
        (1, "block", 8, [("c", 8, "z")], []),
        (0, "anonymous", 11, [], []),
        (0, "block", 15, [("e", 15, "last")], []),
    ]
    assert flat("go") == [(None, "method", 13, [("d", 13, "in")], [])]
    texts = P.describe_methods(J.method_documents(J.statements(files))).collect()
    assert {r["method_name"]: r["description"] for r in texts}["run"].split("\n") == [
        "Method: run", "  String a (Line: 5): xy", "    StringBuilder sb (Line: 7): 12", "      String c (Line: 8): z", "    String e (Line: 15): last",
    ]


def test_file_documents_hold_scopes(spark):
    text = """class A {
  int f = first(1);
  abstract int none();
  A() { super(); init(); }
  void run() {
    String b = "1", a = "2";
    if (this.ready() && util.ok(x)) { repo.find(b).close(); }
    Object o = new Object() { int g = hidden(); void go() { inner.call(); } };
    log("not(a) call");
  }
  static class B { void run() { helper(); } }
}
"""
    schema = "repo_name string, file_path string, file_name string, content string"
    files = spark.createDataFrame([("r", "p", "A.java", text), ("r", "p", "Empty.java", ""), ("r", "p", "N.java", None), ("r", "p", "S.java", "  ")], schema)
    found = {r["file_name"]: r for r in J.all_documents(files).collect()}
    assert len(found) == 4
    for name in ("Empty.java", "N.java", "S.java"):
        assert (found[name]["package_name"], found[name]["imports"], found[name]["types"]) == (None, [], [])
    types = {t["name"]: {m["name"]: m["scopes"] for m in t["methods"]} for t in found["A.java"]["types"]}
    calls = lambda scopes: [(s["kind"], [(c["line_number"], c["receiver"], c["method"]) for c in s["calls"]]) for s in scopes]
    assert types["A"]["none"] is None
    assert calls(types["A"]["A"]) == [("constructor", [(4, "", "init")])]
    assert calls(types["A"]["run"]) == [
        ("method", [(7, "", "ready"), (7, "util", "ok"), (9, "", "log")]), ("block", [(7, "repo", "find")]), ("anonymous", []),
    ]
    assert [v["name"] for v in types["A"]["run"][0]["strings"]] == ["b", "a"]
    assert calls(types["B"]["run"]) == [("method", [(11, "", "helper")])]
    plain = J.file_documents(J.statements(files)).where("file_name = 'A.java'").first()
    assert [m["name"] for m in plain["types"][0]["methods"]] == [m["name"] for m in found["A.java"]["types"][0]["methods"]]


def test_deep_brackets_are_few_pieces(spark):
    from sqltrail.functions import java as text

    code = "class A { int k = " + "f(" * 60 + "1" + ")" * 60 + "; Object[] o = " + "{" * 50 + "}" * 50 + "; " + "Map<" * 40 + "B" + ">" * 40 + " m; }"
    files = spark.createDataFrame([(code,)], "content string")
    pieces, folded = files.select(F.size(text._all(F.col("content"), text.PIECE)), text.fold(F.col("content"))).first()
    assert pieces < 40
    shut = dict(zip(text.BRACKETS, text.FOLDED, strict=True))

    def nest(opener, inside, closer, depth):
        left, right = opener[:-1] + shut[opener[-1]], shut[closer]
        return opener * 8 + left * (depth - 8) + inside + right * (depth - 8) + closer * 8

    assert folded == (
        "class A { int k = " + nest("f(", "1", ")", 60) + "; Object[] o = " + nest("{", "", "}", 50) + "; " + nest("Map<", "B", ">", 40) + " m; }"
    )


def test_tasks_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_BYTES", 100)
    found = stmts(spark, *["class A { int a; }" for _ in range(100)])
    assert found.rdd.getNumPartitions() == 18
    assert found.count() == 300


def test_owners_need_no_rows_for_each_level(spark, monkeypatch):
    text = "class A { void m() { if (a) { String s = \"x\"; } } class B { int n() { return 1; } } }"
    files = spark.createDataFrame([("r", "p", "F.java", text)], "repo_name string, file_path string, file_name string, content string")
    found = J.statements(files, partitions=2)
    assert found.schema["depth"].metadata["levels"] >= 3
    assert "Aggregate" not in J.methods(found)._jdf.queryExecution().optimizedPlan().toString()
    beside = sorted(map(repr, J.methods(found).collect()))
    monkeypatch.setattr(J, "LEVELS", -1)
    assert beside == sorted(map(repr, J.methods(found).collect()))


def test_tasks_are_bounded_by_their_text():
    mb = 1024 * 1024
    assert [J._partitions(n * mb, 8) for n in (0, 3, 100, 1600)] == [None, 3, 8, 100]


def test_deep_files_are_measured_by_all_cores(spark, tmp_path, monkeypatch):
    from sqltrail.plans.queries import REGISTRY
    import sqltrail.plans.code_queries  # noqa: F401  registers its queries

    spark.range(40).selectExpr("id AS p_partkey", "CAST(id % 9 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    tasks, measured = [], J._measured
    monkeypatch.setattr(J, "_measured", lambda dealt: tasks.append(dealt.rdd.getNumPartitions()) or measured(dealt))
    assert REGISTRY["deep_fields"].plan(spark, str(tmp_path)).count() == 200
    assert tasks == [spark.sparkContext.defaultParallelism]


def test_methods_and_builders_read_statements_once(spark, monkeypatch):
    found = stmts(spark, SCOPED, "class B { void f() { class C { void g() { StringBuilder s = new StringBuilder(); s.append(\"x\"); h(); } } } }")
    read = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(regexp_extract_all(")
    assert read(J.method_documents(found)) == 1
    assert "Aggregate" not in J.builder_calls(found)._jdf.queryExecution().optimizedPlan().toString()
    once = [sorted(map(repr, df.collect())) for df in (J.method_documents(found), J.builder_calls(found))]
    monkeypatch.setattr(J, "LEVELS", -1)
    assert once == [sorted(map(repr, df.collect())) for df in (J.method_documents(found), J.builder_calls(found))]


def test_files_that_share_keys_and_lone_files_have_the_same_documents(spark):
    lone = J.file_documents(stmts(spark, SCOPED), with_scopes=True).drop("file_name")
    files = spark.createDataFrame([("r", "p", "f0", SCOPED), ("r", "p", "g", "class Z { }"), ("r", "p", "g", "class Z { }")], SCHEMA)
    shared = J.file_documents(J.statements(files), with_scopes=True).where("file_name = 'f0'").drop("file_name")
    assert list(map(repr, lone.collect())) == list(map(repr, shared.collect()))
