"""Append-only JSONL logs: line scan, strict and lenient parsing, key lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evalmart.functions.hashing import is_json_object


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with an ordinal that follows the file order: file, split start, position in the split."""
    return spark.read.text(path).select(
        "value", F.struct(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
        ).alias("seq"),
    )


def flag_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``ok``: valid UTF-8 and exactly one JSON object."""
    kept = lines.filter(~F.coalesce(F.make_valid_utf8("value"), F.lit("")).rlike(r"^\s*$"))
    return kept.withColumn("_utf8", F.is_valid_utf8("value")).withColumn("value", F.make_valid_utf8("value")).withColumn(
        "ok", is_json_object(F.col("value"))
    )


def parse_log(lines: DataFrame, schema: T.StructType, mode: str = "strict") -> DataFrame:
    """Records of a log. Lenient mode drops bad lines; strict mode fails the job on the first one.

    ``bad_lines`` gives the bad lines as rows, for a check that must not stop.
    """
    flagged = flag_lines(lines)
    others = [c for c in lines.columns if c != "value"]
    if mode == "lenient":
        good = flagged.filter("ok")
        return good.select(*others, F.from_json("value", schema).alias("record")).select(*others, "record.*")
    fine = F.col("ok") & F.col("_utf8")
    checked = F.when(fine, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80)))))
    return flagged.select(*others, F.from_json(checked, schema).alias("record")).select(*others, "record.*")


def bad_lines(lines: DataFrame) -> DataFrame:
    return flag_lines(lines).filter(~(F.col("ok") & F.col("_utf8"))).drop("ok", "_utf8")


def read_log(spark: SparkSession, path: str, schema: T.StructType, mode: str = "strict") -> DataFrame:
    return parse_log(read_lines(spark, path), schema, mode)


def trial_key_col(prefer_nested: bool = False) -> Column:
    """Key from the record itself or from its trial, in either order; blank counts as absent."""
    top, nested = F.nullif(F.col("trial_key"), F.lit("")), F.nullif(F.col("trial.trial_key"), F.lit(""))
    return F.coalesce(nested, top) if prefer_nested else F.coalesce(top, nested)


def with_trial_parts(df: DataFrame, key: str = "trial_key") -> DataFrame:
    """Model, condition and task from a key; the task part may itself hold the separator."""
    parts = F.split(F.col(key), "::", 3)
    return df.select(
        *[c for c in df.columns if c not in ("model", "condition", "task_id")],
        F.get(parts, 0).alias("model"), F.get(parts, 1).alias("condition"), F.get(parts, 2).alias("task_id"),
    )


def with_prefix(df: DataFrame, model: str, condition: str, key: str = "trial_key") -> DataFrame:
    return df.filter(F.col(key).startswith(f"{model}::{condition}::"))
