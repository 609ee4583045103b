"""Expressions for addresses, paths and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preprint_pdf(url: Column) -> Column:
    """The PDF of a preprint's abstract page: ``/abs/`` becomes ``/pdf/``, with ``.pdf`` at the end; other addresses stay."""
    pdf = F.regexp_replace(url, r"/abs/", "/pdf/")
    return F.when(url.rlike(r"^https?://[^/]+/abs/"), F.when(pdf.endswith(".pdf"), pdf).otherwise(F.concat(pdf, F.lit(".pdf")))).otherwise(url)


def result_path(uri: Column) -> Column:
    """Path of a search hit: without scheme, collection and line number."""
    return F.regexp_replace(F.regexp_replace(uri, r"^[a-z]+://[^/]+/", ""), r":\d+$", "")


def unit_score(score: Column) -> Column:
    """Scores given in percent as shares."""
    return F.when(score > 1, score / 100).otherwise(score)


def safe_path(path: Column) -> Column:
    """The path, or NULL if it leaves its root."""
    return F.when(~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), path)


def diff_lines(diffs: DataFrame, column: str = "diff") -> DataFrame:
    """file, line of what a unified diff adds; headers are no lines."""
    parts = diffs.select(F.explode(F.split(column, r"(?m)^\+\+\+ ")).alias("part"))
    file = F.regexp_extract("part", r"^(?:b/)?([^\n\t]+)", 1)
    lines = parts.select(file.alias("file"), F.explode(F.regexp_extract_all("part", F.lit(r"(?m)^\+(?!\+\+ )(.*)$"), F.lit(1))).alias("line"))
    return lines.filter("file <> ''")
