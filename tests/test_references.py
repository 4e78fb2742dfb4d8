"""Matching lines with a catalog: quirks, written-out cases, an earlier report, and the large-catalog way."""

import csv
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sqltrail import constants as C
from sqltrail.functions import text as X
from sqltrail.operators import references as R
from sqltrail.operators import sizing
from sqltrail.operators import usage as U

LINES = "repo_name string, file_path string, file_name string, ext string, line_number int, line string"


def make_lines(spark, texts, ext="java"):
    rows = [("r", "p", "f." + ext, ext, n, t) for n, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, LINES)


def make_catalog(spark, *names):
    return spark.createDataFrame([("O", "TABLE", n) for n in names], "owner string, object_type string, object_name string")


def hits(df):
    return Counter((r["owner"], r["object_name"], r["line_number"], r["operation"]) for r in df.collect())


@pytest.mark.parametrize(
    "text, strict, expected",
    [
        ('"INSERT INTO X SELECT a FROM Y, DELETE Z"', False, {"X": "M", "Y": "R", "Z": "M"}),
        ('"DELETE FROM X"', False, {"X": "R"}),
        ('"DELETE  FROM X JOIN Y"', True, {"X": "M", "Y": "R"}),
        ('"UPDATE" + "X"', False, {"X": ""}),
        ('"x (Y) S.Z"', False, {"X": ""}),
    ],
)
def test_operation(spark, text, strict, expected):
    found = R.map_references(make_lines(spark, [text]), make_catalog(spark, "X", "Y", "Z"), strict=strict)
    assert {r["object_name"]: r["operation"] for r in found.collect()} == expected


def test_script_literal_keeps_its_quote_on_the_first_word(spark):
    found = R.map_references(make_lines(spark, ["'UPDATE X'", "' UPDATE X '"], "js"), make_catalog(spark, "X"))
    assert hits(found) == Counter({("O", "X", 2, "M"): 1})


def test_repeats_owners_and_types(spark):
    catalog = spark.createDataFrame(
        [("A", "TABLE", "X"), ("A", "TABLE", "X"), ("B", "VIEW", "X"), ("B", "MATERIALIZED VIEW", "X"), ("B", "INDEX", "X")],
        "owner string, object_type string, object_name string",
    )
    lines = make_lines(spark, ['"FROM X x"'])
    assert R.map_references(lines, catalog).count() == 4
    assert R.map_references(lines, catalog, C.REFERENCES_TYPES).count() == 6
    assert R.map_references(lines, catalog, owners=["A"]).count() == 2


# Source lines with the hits they must give, as (name, operation).
CASES = [
    ('x = "select A from TB_A, TB_B";', [("FROM", "R"), ("TB_A", "R"), ("TB_B", "R")]),
    ('"TB_A" + "update TB_B"', [("TB_A", ""), ("TB_B", "M")]),
    ('"insert into TB_A select 1 from TB_B join TB_A;TB_A"', [("TB_A", "M"), ("FROM", "R"), ("TB_B", "R"), ("TB_A", "R"), ("TB_A", "R")]),
    ('"merge TB_A:TB_B" "TB_A"', [("TB_A", "M"), ("TB_B", "M"), ("TB_A", "")]),
    ('from TB_A // no literal', []),
    ('"from S.TB_A (TB_B)"', [("FROM", "R")]),
    ('"delete\tTB_A, from"', [("TB_A", "M"), ("FROM", "R")]),
    ('" tb_a " "open', [("TB_A", "")]),
    ('"from" "TB_A"', [("FROM", "R"), ("TB_A", "")]),
    ('"join tb_b,,tb_b"', [("TB_B", "R"), ("TB_B", "R")]),
]


def test_hits_with_and_without_broadcast(spark, monkeypatch):
    repeats = 50
    texts = [text for text, _ in CASES] * repeats
    expected = Counter()
    for number, (_, wanted) in enumerate(CASES * repeats, 1):
        expected.update(("O", name, number, operation) for name, operation in wanted)
    lines, catalog = make_lines(spark, texts), make_catalog(spark, "TB_A", "TB_B", "FROM")
    small = R.map_references(lines, catalog)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert hits(small) == expected
    monkeypatch.setattr(sizing, "fits_broadcast", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = R.map_references(lines, catalog)
        plan = large._jdf.queryExecution().executedPlan().toString()
        # The names meet the tokens in a shuffle join, after the only thing that is sent: the sieve.
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
        assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning(object_name") < plan.index("BroadcastHashJoin")
        assert hits(large) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_not_shuffled(spark):
    lines = spark.range(1000).select(
        F.lit("r").alias("repo_name"), F.lit("p").alias("file_path"), F.lit("f").alias("file_name"),
        F.lit("java").alias("ext"), F.col("id").cast("int").alias("line_number"), F.lit('"FROM X"').alias("line"),
    )
    found = R.map_references(lines, make_catalog(spark, "X"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    big_side = plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in big_side


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_beyond_the_bound_repeats_no_side(spark, how):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), F.create_map(F.lit("v"), "id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (9, "d")], "k long, n string")
    joined = sizing.scaled_join(big, small, ["k"], how, max_rows=0)
    assert "Generate" not in joined._jdf.queryExecution().toString()
    counted = lambda df: Counter(map(str, df.collect()))
    assert counted(joined) == counted(big.join(small, "k", how))


def test_sieve_keeps_matches_and_few_others(spark):
    keys = spark.range(0, 60_000, 3).select(F.concat(F.lit("TB_"), "id").alias("a.key"), F.lit(1).alias("other"))
    rows = spark.range(60_000).select(F.concat(F.lit("TB_"), "id").alias("a.key"), F.col("id").alias("bits"), F.lit("x").alias("_sieve_word0"))
    passed = sizing.sieve(rows, keys, ["a.key"])
    assert passed.columns == rows.columns
    matching = F.col("bits") % 3 == 0
    assert passed.filter(matching).count() == 20_000
    assert passed.filter(~matching).count() < 40_000 / 50


def test_sieve_of_no_keys_several_keys_and_other_types(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "k int, n string")
    assert sizing.sieve(rows, rows.limit(0), ["k", "n"]).count() == 0
    both = sizing.sieve(rows, rows.filter("k = 1"), ["k", "n"])
    assert (1, "a") in [tuple(r) for r in both.collect()]
    wider = rows.withColumn("k", F.col("k").cast("bigint"))
    assert sizing.sieve(rows, wider, ["k"]) is rows
    halves = rows.withColumn("k", F.col("k") / 2)
    assert sizing.sieve(halves, halves, ["k"]) is halves


def test_sieve_of_a_bounded_size_keeps_all_matches(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SIEVE_WORDS", 100)
    keys = spark.range(5_000).select(F.col("id").alias("k"))
    assert sizing.sieve(keys, keys, ["k"]).count() == 5_000


def test_sieve_is_for_joins_that_drop_rows(spark):
    rows = spark.range(3).toDF("k")
    with pytest.raises(ValueError):
        sizing.scaled_join(rows, rows, ["k"], "left", few_match=True)


def test_few_tokens_are_shuffled_beyond_the_bound(spark):
    lines = make_lines(spark, [f'"SELECT COL_{i} FROM TB_{i} WHERE X_{i} = Y_{i} AND Z_{i} = {i}"' for i in range(2_000)])
    names = spark.range(0, 2_000, 50).select(F.concat(F.lit("TB_"), "id").alias("object_name"))
    tokens = R.operation_tokens(lines).withColumnRenamed("token", "object_name")
    assert sizing.sieve(tokens, names, ["object_name"]).count() * 10 < tokens.count()
    catalog = make_catalog(spark, *[r[0] for r in names.collect()])
    shuffled = R.map_references(lines, catalog, fits=False)
    assert hits(shuffled) == hits(R.map_references(lines, catalog, fits=True))


def test_size_check_counts_rows_and_bytes(spark):
    df = spark.range(100).select(F.lit("12345678").alias("t"))
    assert sizing.fits_broadcast(df, 100, 800)
    assert not sizing.fits_broadcast(df, 99, 800)
    assert not sizing.fits_broadcast(df, 100, 799)


def test_other_suffixes_and_extractors(spark):
    assert R.map_references(make_lines(spark, ['"FROM X"'], "txt"), make_catalog(spark, "X")).count() == 0
    plain = make_lines(spark, ["select a from X"], "sql")
    assert R.map_references(plain, make_catalog(spark, "X")).count() == 0
    whole = R.map_references(plain, make_catalog(spark, "X"), extractors={"sql": X.whole_line})
    assert hits(whole) == Counter({("O", "X", 1, "R"): 1})


def test_lower_case_catalog_names_match_only_when_upper_cased(spark):
    tags = spark.createDataFrame([("TB_A",), ("TB_B",)], "table_name string")
    catalog = spark.createDataFrame([("O", "TABLE", "tb_a"), ("O", "TABLE", "TB_B")], "owner string, object_type string, object_name string")
    assert {r[0] for r in R.keep_known(tags, catalog).collect()} == {"TB_A", "TB_B"}
    assert {r[0] for r in R.keep_known(tags, catalog, upper_names=False).collect()} == {"TB_B"}


# Contents of a file, and (read, modified) of the tables it names in upper case.
FLAGS = [
    ("SELECT a FROM TB_A x TB_B", {"TB_A": (True, False), "TB_B": (True, False)}),
    ("TB_A then select FROMTB_A from", {"TB_A": (False, False)}),
    ("DELETE FROMX TB_A", {"TB_A": (False, False)}),
    ("delete from tb_a TB_A", {"TB_A": (False, True)}),
    ("UPDATE\nTB_B SELECT 1\n FROM (TB_A) ", {"TB_A": (True, True), "TB_B": (False, True)}),
    ("TB_A UPDATED TB_A", {"TB_A": (False, False)}),
    ("INSERT INTO TB_A SELECT FROM", {"TB_A": (False, True)}),
    ("TB_A SELECT é FROM éTB_A", {"TB_A": (False, False)}),
    ("SELECT FROM TB_S", {}),
]


def test_file_flags(spark):
    files = spark.createDataFrame(
        [("r", "p", str(i), content) for i, (content, _) in enumerate(FLAGS)],
        "repo_name string, file_path string, file_name string, content string",
    )
    synonym = spark.createDataFrame([("O", "SYNONYM", "TB_S")], "owner string, object_type string, object_name string")
    found = U.classify_file_usage(files, make_catalog(spark, "TB_A", "TB_B").unionByName(synonym))
    got = {(int(r["file_name"]), r["table_name"]): (r["read"], r["modified"]) for r in found.collect()}
    assert got == {(i, table): flags for i, (_, tables) in enumerate(FLAGS) for table, flags in tables.items()}


def test_usage_by_file_has_the_same_shape_for_long_files(spark):
    lines = spark.range(1, 25_001).select(
        F.lit("T").alias("table_name"), F.lit("r").alias("repo_name"), F.lit("p").alias("file_path"),
        F.lit("f").alias("file_name"), F.col("id").cast("int").alias("line_number"),
    )
    found = U.usage_by_file(lines.unionAll(lines))
    assert found.count() == 25_000 and found.columns == ["table_name", "repo_name", "file_path", "file_name", "line_number"]


# A report written earlier, to be reproduced from its own lines and objects.
GOLDEN = os.environ.get("LINEAGE_GOLDEN_REPORT", "")


@pytest.mark.skipif(not os.path.exists(GOLDEN), reason="no report is named")
def test_earlier_report_is_reproduced(spark):
    with open(GOLDEN, newline="", encoding="utf-8") as file:
        rows = list(csv.DictReader(file))
    lines = {(r["Repo Name"], r["File Path"], r["File Name"], "java", int(r["Line Number"]), r["Line"]) for r in rows}
    catalog = {(r["Owner"], r["Object Type"], r["Object Name"]) for r in rows}
    found = R.map_references(
        spark.createDataFrame(sorted(lines), LINES),
        spark.createDataFrame(sorted(catalog), "owner string, object_type string, object_name string"),
    ).collect()
    got = Counter((r["owner"], r["object_name"], r["object_type"], r["line"], r["line_number"]) for r in found)
    want = Counter((r["Owner"], r["Object Name"], r["Object Type"], r["Line"], int(r["Line Number"])) for r in rows)
    assert got == want


def test_a_report_can_be_replayed(spark):
    """Hits reproduce themselves from their own lines and objects."""
    texts = ['q = " SELECT a FROM TB_X x, TB_Y " +', '" JOIN TB_X z "', '"error in TB_Y"', '"(TB_X)"', '"UPDATE S.TB_X"']
    first = R.map_references(make_lines(spark, texts), make_catalog(spark, "TB_X", "TB_Y")).collect()
    assert Counter((r["line_number"], r["object_name"], r["operation"]) for r in first) == Counter(
        [(1, "TB_X", "R"), (1, "TB_Y", "R"), (2, "TB_X", "R"), (3, "TB_Y", "")]
    )
    lines = {("r", "p", "f.java", "java", r["line_number"], r["line"]) for r in first}
    again = R.map_references(
        spark.createDataFrame(sorted(lines), LINES), make_catalog(spark, *{r["object_name"] for r in first})
    ).collect()
    assert Counter(again) == Counter(first)


def test_report_searches_texts_once(spark):
    lines = spark.createDataFrame([("p/A.java", "p", "A", 3, "select a from T_1 x")], "file_path string, package_name string, class_name string, line_number int, line string")
    report = U.usage_report_lines(U.tag_lines(lines))
    assert "regexp" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert [r["text"] for r in report.collect()] == ["T_1: read", "  - File: p/A.java, Package: p, Class: A, Lines: 3"]
