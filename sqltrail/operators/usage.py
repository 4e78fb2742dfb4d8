"""Table usage found by SQL patterns, per line, per file and over all code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltrail.functions import text as X
from sqltrail.operators.catalog import catalog_relations
from sqltrail.operators.references import keep_known
from sqltrail.schemas import FILE_KEY
from sqltrail.session import write_once


def tag_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per table that a line reads or changes, once per match."""
    reads = F.transform(
        X.read_targets(F.col(text)),
        lambda t: F.struct(t.alias("table_name"), F.lit(True).alias("read"), F.lit(False).alias("modified")),
    )
    changes = F.transform(
        X.modify_targets(F.col(text)),
        lambda t: F.struct(t.alias("table_name"), F.lit(False).alias("read"), F.lit(True).alias("modified")),
    )
    return lines.select("*", F.inline(F.concat(reads, changes)))


def upper_identifiers(lines: DataFrame, text: str = "line") -> DataFrame:
    """One row per upper-case identifier of each line."""
    return lines.select("*", F.explode(X.upper_identifiers_of(F.col(text))).alias("table_name"))


def with_package_class(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds the package and the first class name, NULL where absent."""
    return files.withColumns(
        {
            "package_name": X.package_name(F.col(content)),
            "class_name": X.first_class_name(F.col(content)),
        }
    )


def table_usage(tags: DataFrame) -> DataFrame:
    """Per table: whether it is read, whether it is changed, and how many occurrences it has.

    The occurrences themselves stay rows of `tags`: a table may hold most of them, so they are
    counted map-side and never gathered in one group.
    """
    return tags.groupBy("table_name").agg(
        F.bool_or("read").alias("read"),
        F.bool_or("modified").alias("modified"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def keep_relations(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose `table_name` is a table, view or materialized view of the catalog; synonyms are none."""
    return keep_known(df, catalog_relations(catalog))


def usage_by_file(tags: DataFrame, keys: Sequence[str] = FILE_KEY) -> DataFrame:
    """Per table and file the lines it is used on, a row for each line.

    Other columns that say where a file belongs, such as package and class, can be among `keys`. The lines
    stay rows, because a file of the input may have any number of them.
    """
    return tags.select("table_name", *keys, "line_number").distinct()


def _file_names(content: Column) -> tuple[Column, Column]:
    """Distinct names of a whole text that follow a FROM after a SELECT, and that follow a change keyword."""
    upper = F.upper(content)
    after_select = F.get(F.split(upper, "SELECT", 2), 1)
    after_from = F.get(F.split(after_select, "FROM", 2), 1)
    after_change = F.get(F.split(upper, rf"(?:INSERT INTO|UPDATE|DELETE FROM)(?![{X.WORD}])", 2), 1)

    # A digit put in front keeps a name glued to the keyword from counting as a word.
    def words(text: Column) -> Column:
        return F.coalesce(F.array_distinct(X.words_of(F.concat(F.lit("0"), text))), F.array().cast("array<string>"))

    return words(after_from), words(after_change)


def classify_file_usage(
    files: DataFrame, catalog: DataFrame, keys: Sequence[str] = FILE_KEY, content: str = "content"
) -> DataFrame:
    """Per file and known table that it names in upper case: read and modified flags.

    A table is read if its name follows a FROM that follows a SELECT, and changed if it follows
    INSERT INTO, UPDATE or DELETE FROM, anywhere later in the file. A file's row holds all of that, so
    its names are compared there, and then once with the catalog: files are neither grouped nor joined.
    """
    read, changed = _file_names(F.col(content))
    texts = files.select(*keys, F.array_distinct(X.upper_identifiers_of(F.col(content))).alias("_named"), read.alias("_read"), changed.alias("_changed"))
    # What is both named and read is short, and looked through for each name.
    sides = texts.select(*keys, "_named", F.array_intersect("_named", "_read").alias("_read"), F.array_intersect("_named", "_changed").alias("_changed"))
    flagged = F.transform(
        "_named",
        lambda n: F.struct(n.alias("table_name"), F.array_contains("_read", n).alias("read"), F.array_contains("_changed", n).alias("modified")),
    )
    return keep_relations(sides.select(*keys, F.inline(flagged)), catalog)


def usage_simple(
    files: DataFrame, catalog: DataFrame, keys: Sequence[str] = FILE_KEY, content: str = "content"
) -> DataFrame:
    """Per file and known table: the list of its lines and the flags of the whole file, in one pass over the text.

    A file is one input row, which bounds the list.
    """
    keys = list(keys)
    read, changed = _file_names(F.col(content))
    by_line = F.transform(F.split(X.normalize_newlines(F.col(content)), "\n", -1), X.upper_identifiers_of)
    texts = files.select(*keys, by_line.alias("_lines"), read.alias("_read"), changed.alias("_changed"))
    named = F.array_distinct(F.flatten("_lines"))
    sides = texts.select(*keys, "_lines", F.array_intersect(named, "_read").alias("_read"), F.array_intersect(named, "_changed").alias("_changed"))
    flagged = F.flatten(
        F.transform(
            "_lines",
            lambda names, i: F.transform(
                F.array_distinct(names),
                lambda n: F.struct(
                    n.alias("table_name"), (i + 1).alias("line_number"),
                    F.array_contains("_read", n).alias("read"), F.array_contains("_changed", n).alias("modified"),
                ),
            ),
        )
    )
    return keep_relations(sides.select(*keys, F.inline(flagged)), catalog).groupBy(*keys, "table_name").agg(
        F.array_sort(F.collect_list("line_number")).alias("lines"), F.any_value("read").alias("read"), F.any_value("modified").alias("modified")
    )


def usage_report_lines(tags: DataFrame) -> DataFrame:
    """The printed report, one row per text line, sorted by table.

    A heading row per table is followed by a row per occurrence. `tags` carries file_path,
    package_name, class_name and line_number. Its rows are written to the checkpoint folder, as the headings, the
    bounds of the sort and the sort itself would each search the texts again.
    """
    tags = write_once(tags.select("table_name", "read", "modified", "file_path", "package_name", "class_name", "line_number"))
    headings = table_usage(tags).select(
        "table_name",
        F.lit(0).alias("part"),
        F.lit("").alias("file_path"),
        F.lit(0).alias("line_number"),
        F.concat("table_name", F.lit(": "), X.action_label(F.col("read"), F.col("modified"))).alias("text"),
    )
    occurrences = tags.select(
        "table_name",
        F.lit(1).alias("part"),
        "file_path",
        "line_number",
        F.concat(
            F.lit("  - File: "), "file_path",
            F.lit(", Package: "), F.coalesce("package_name", F.lit("None")),
            F.lit(", Class: "), F.coalesce("class_name", F.lit("None")),
            F.lit(", Lines: "), F.col("line_number").cast("string"),
        ).alias("text"),
    )
    ordered = headings.unionByName(occurrences).orderBy("table_name", "part", "file_path", "line_number", "text")
    return ordered.select("table_name", "text")
