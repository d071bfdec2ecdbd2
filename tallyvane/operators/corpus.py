"""Source corpora: lines of code, functions, comment-free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyvane.functions.findings import ascii_only, collapse_blank_lines, strip_comments


def lines_of_code(files: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by, files, loc): lines that are not blank; comments count. No line is exploded into a row."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"\S")))
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(lines).alias("loc"))


def function_counts(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.groupBy(*by).agg(F.count("*").alias("functions"), F.count_distinct("filename").alias("source_files"))


def clean_code(files: DataFrame, text: str = "text") -> DataFrame:
    """text without non-ASCII characters, then without comments, then without runs of blank lines."""
    return files.withColumn(text, collapse_blank_lines(strip_comments(ascii_only(F.col(text)))))


def project_metadata(projects: DataFrame, code: DataFrame, functions: DataFrame, by: list[str]) -> DataFrame:
    """Metadata rows of listed projects; a project without sources has zeros."""
    return projects.join(code, by, "left").join(functions, by, "left").fillna(0, ["files", "loc", "functions"])
