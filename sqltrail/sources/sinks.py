"""Report and diagram files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sqltrail.operators.report import refs_report


def write_refs_csv(refs: DataFrame, path: str, layout: str = "operation") -> None:
    """Write hits as CSV with the report headings; a folder of part files, each with headings."""
    report = refs_report(refs, layout)
    report.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_workspace(lines: DataFrame, path: str) -> None:
    """Write diagram lines as text; part files follow one another in order."""
    lines.select("value").write.mode("overwrite").text(path)
