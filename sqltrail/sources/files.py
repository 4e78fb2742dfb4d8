"""Source trees and text files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqltrail.constants import SOURCE_EXTENSIONS
from sqltrail.functions.text import decode_as, decode_fallback
from sqltrail.operators.references import to_lines


def suffix_glob(exts: Iterable[str], ignore_case: bool = True) -> str:
    """A file-name pattern for the suffixes, which the scan applies before it opens a file."""
    def either(ext: str) -> str:
        if not ignore_case:
            return ext
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)

    return "*.{" + ",".join(either(e) for e in exts) + "}"


def with_file_info(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Adds repo_name (name of the root), file_path (folder), file_name and lower-case ext."""
    return df.withColumns(
        {
            "repo_name": F.lit(posixpath.basename(root.rstrip("/"))),
            "file_path": F.regexp_extract(F.col(path), r"^(?s)(?:file:)?(.*)/[^/]*+$", 1),
            "file_name": F.regexp_extract(F.col(path), r"(?s)([^/]*+)$", 1),
            "ext": F.lower(F.regexp_extract(F.col(path), r"(?s)\.([^./]*+)$", 1)),
        }
    )


def scan_sources(
    spark: SparkSession,
    root: str,
    exts: Iterable[str] = SOURCE_EXTENSIONS,
    ignore_case: bool = True,
    encoding: str | None = None,
) -> DataFrame:
    """Every source file below `root`: repo_name, file_path, file_name, ext and text content.

    Without `encoding` a file that is not valid utf-8 is read as windows-1252. Other suffixes are
    not opened. Hidden files and folders are skipped.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix_glob(exts, ignore_case))
        .load(root)
        .select("path", "content")
    )
    content: Column = decode_as(F.col("content"), encoding) if encoding else decode_fallback(F.col("content"))
    named = with_file_info(raw, root)
    return named.select("repo_name", "file_path", "file_name", "ext", content.alias("content"))


def scan_lines(spark: SparkSession, root: str, **options) -> DataFrame:
    """`scan_sources` as numbered lines."""
    return to_lines(scan_sources(spark, root, **options))
