"""Column functions on the cases of FIXTURES.md section 5, and against Python on random text."""

import random
import re

from pyspark.sql import functions as F

from sqltrail.functions import text as X


def column(spark, values, *expressions):
    """Values of expressions over the single text column `t`, per input in order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    found = rows.select("i", *[e.alias(f"c{n}") for n, e in enumerate(expressions)]).orderBy("i").collect()
    return [tuple(row[1:]) if len(expressions) > 1 else row[1] for row in found]


def test_double_quoted_literals(spark):
    cases = ['a("") + "x y" + "', '"a\u0085b"', "no literal", '"a\\"b"']
    assert column(spark, cases, X.literals_dq(F.col("t"))) == [["", "x y"], ["a\u0085b"], [], ["a\\"]]


def test_php_literals_keep_quotes_and_know_no_heredoc(spark):
    case = "$x = <<<EOT select EOT; $y='SELECT * FROM TB_A'; $z=\"DELETE FROM TB_B WHERE a='x'\""
    assert column(spark, [case], X.literals_php(F.col("t"))) == [
        ["'SELECT * FROM TB_A'", "\"DELETE FROM TB_B WHERE a='x'\""]
    ]


def test_long_script_literal(spark):
    long = "'" + "x\\'" * 200_000 + "'"
    assert column(spark, [long], F.size(X.literals_js(F.col("t"))), F.length(X.literals_js(F.col("t"))[0])) == [
        (1, len(long))
    ]


def test_tokens_keep_empty_parts(spark):
    case = " a, ;b:: c=TB_X (TB_Y) S.TB_Z "
    assert column(spark, [case], X.tokens(F.col("t"))) == [
        ["", "a", "", "b", "", "c=TB_X", "(TB_Y)", "S.TB_Z", ""]
    ]


def test_targets(spark):
    cases = [
        "JOIN TB_AÇÃO x", "select a from t1 where 1 join t2 on", "SELECT FROM x", "delete from a; update b set", "merge into c",
        "SELECT SELECT SELECT a FROM b SELECT",
    ]
    assert column(spark, cases, X.read_targets(F.col("t")), X.modify_targets(F.col("t"))) == [
        (["TB_AÇÃO"], []), (["T1", "T2"], []), ([], []), ([], ["A", "B"]), ([], []), (["B"], []),
    ]


def test_join_literals(spark):
    cases = ['"a" + // "gone"\n "b"', '"http://x" + "y"', '"a\nb"', "f(x)"]
    assert column(spark, cases, X.join_literals(F.col("t"))) == ["ab", "", "ab", ""]


def test_keywords_in_quotes(spark):
    cases = ['x("a t_one, b") // t_two', 't_one "x" t_two', '"xt_one"', '"t_one xt_two"']
    found = X.keywords_in_quotes(F.col("t"), ["t_one", "t_two"])
    assert column(spark, cases, found) == [["t_one"], [], [], ["t_one", "t_two"]]


def test_decoding(spark):
    cases = [(0, "ação\r\nx".encode()), (1, "ação €".encode("windows-1252")), (2, b"\x81\r")]
    rows = spark.createDataFrame(cases, "i int, b binary")
    found = rows.select("i", X.decode_fallback(F.col("b")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in found] == ["ação\nx", "ação €", "�\n"]
    every = bytes(b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x0D))
    one = spark.createDataFrame([(every,)], "b binary").select(X.decode_as(F.col("b"), "windows-1252").alias("t"))
    assert one.first()["t"] == every.decode("windows-1252")


def test_action_label(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, False)], "r boolean, m boolean")
    labels = [r[0] for r in rows.select(X.action_label(F.col("r"), F.col("m"))).collect()]
    assert labels == ["read, modified", "read", ""]


ALPHABET = [
    "from", "JOIN", "insert", "UPDATE", "delete", "merge", "TB_A", "x", ",", ";", ":", " ", "  ", "\t", " ", "\x1c",
    '"', "'", "`", "\\", "(", ")", ".", "é", " ",
]


def random_lines(count=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(count)]


def quoted(line):
    """Texts in any of three quotes, found by reading sign after sign; an open one is passed over."""
    found, at = [], 0
    while at < len(line):
        if line[at] in "'\"`":
            end = at + 1
            while end < len(line) and line[end] != line[at]:
                end += 2 if line[end] == "\\" else 1
            if end < len(line):
                found.append(line[at : end + 1])
                at = end
        at += 1
    return found


def test_functions_equal_python_on_random_text(spark):
    lines = random_lines()
    t = F.col("t")
    got = column(
        spark, lines, X.literals_dq(t), X.literals_sq(t), X.literals_js(t), X.tokens(t), X.py_strip(t), X.upper_identifiers_of(t)
    )
    for line, row in zip(lines, got):
        assert row[0] == re.findall(r'"(.*?)"', line)
        assert row[1] == re.findall(r"'(.*?)'", line)
        assert row[2] == quoted(line)
        assert row[3] == re.split(r"[,;:\s]\s*", line)
        assert row[4] == line.strip()
        assert row[5] == re.findall(r"\b([A-Z_][A-Z0-9_]*)\b", line)


def test_blanks_are_stripped_without_a_pattern(spark):
    blanks = "".join(c for c in map(chr, range(0xD800)) if c.isspace())
    texts = [f"{blanks}a{blanks}b{blanks}", blanks, "", "a  b", "\u200bx\u200b"]
    assert column(spark, texts, X.py_strip(F.col("t"))) == [t.strip() for t in texts]
    plan = spark.range(1).select(X.py_strip(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
