"""Report, JSONL, checksum and markdown sinks. A sink writes a folder; its commit replaces the rename of a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.hashing import canonical_json


def write_report(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[Column | str]) -> None:
    """CSV in fixed column and row order. A report is bounded by models x conditions x subsets, so one file is right."""
    df.orderBy(*order).select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").option(
        "emptyValue", "").csv(path)


def jsonl_lines(df: DataFrame, canonical: bool = True) -> DataFrame:
    text = F.to_json(F.struct(*df.columns))
    return df.select((canonical_json(text) if canonical else text).alias("value"))


def write_jsonl(df: DataFrame, path: str, canonical: bool = True) -> None:
    jsonl_lines(df, canonical).write.mode("overwrite").text(path)


def checksum_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.concat_ws("  ", "sha256", "path").alias("value"))


def write_checksums(files: DataFrame, path: str) -> None:
    """Checksum lines in path order across the written part files."""
    ordered = checksum_lines(files).repartitionByRange("path").sortWithinPartitions("path")
    ordered.select("value").write.mode("overwrite").text(path)


def report_lines(df: DataFrame, row: str, column: str, cell: Column, columns: Sequence[str]) -> DataFrame:
    """Markdown table lines: one row per ``row`` value, one cell per listed ``column`` value."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.first(cell))
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns]
    return wide.select(row, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(row), *cells), F.lit(" |")).alias("line"))


def write_markdown(lines: DataFrame, path: str, row: str, columns: Sequence[str], title: str) -> None:
    spark = lines.sparkSession
    head = spark.createDataFrame(
        [(-2, "| " + " | ".join([title, *columns]) + " |"), (-1, "|" + "---|" * (len(columns) + 1))], "at int, line string")
    body = lines.select(F.lit(0).alias("at"), row, "line")
    head.withColumn(row, F.lit("")).select("at", row, "line").unionByName(body).orderBy("at", row).coalesce(1).select(
        "line").write.mode("overwrite").text(path)
