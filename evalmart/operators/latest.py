"""Newest record per key and the operators that depend on record order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def latest_by_key(df: DataFrame, key: str = "trial_key", seq: str = "seq", on_missing: str = "skip",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Record with the highest ordinal per key.

    ``columns`` are the fields to keep besides the key: the aggregate carries whole records, so fields that are
    not named here are not read and not shuffled.

    One ``max_by`` aggregate: combined in each task first, so a hot key costs one row per task, and no sort of
    its records. ``on_missing="fail"`` raises inside the job on a record without key.
    """
    if on_missing == "fail":
        df = df.withColumn(key, F.when(F.coalesce(F.col(key), F.lit("")) == "", F.raise_error(F.lit(f"missing {key}")))
                           .otherwise(F.col(key)))
    else:
        df = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
    others = [c for c in (columns if columns is not None else df.columns) if c != key]
    order = df.columns if columns is None else [key, *others]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in order])


def dedup_keep_last(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """One record per key: the last by ``order`` (time, run name, directory)."""
    rows = df.withColumn("dedup_key", key)
    columns = [c for c in rows.columns if c != "dedup_key"]
    picked = rows.groupBy("dedup_key").agg(
        F.max_by(F.struct(*columns), F.struct(*[F.col(c) for c in order])).alias("_row"),
        F.count(F.lit(1)).alias("n_copies"),
    )
    return picked.select("dedup_key", "n_copies", *[F.col("_row")[c].alias(c) for c in columns])


def task_dedup_key(name: Column, task_text: Column, reference_text: Column) -> Column:
    """Scenario name, else the digest of task and reference text."""
    joined = F.concat(F.coalesce(task_text, F.lit("")), F.lit("\n<<<SEP>>>\n"), F.coalesce(reference_text, F.lit("")))
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", F.concat(F.lit("scenario_name:"), F.trim(name))).otherwise(
        F.concat(F.lit("content_sha1:"), F.sha1(joined))
    )


def dedup_stats(df: DataFrame, key: Column) -> DataFrame:
    """Records seen, surviving keys, collisions and dropped records."""
    per_key = df.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    out = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("seen"), F.count(F.lit(1)).alias("survivors")
    )
    return out.withColumn("collisions", F.col("seen") - F.col("survivors")).withColumn(
        "dropped_by_dedup", F.col("collisions")
    )


def resume_state(log: DataFrame, key: str = "trial_key") -> DataFrame:
    """Per key: was it ever completed, did it only ever fail at the API.

    A later API error does not undo a completion.
    """
    done = F.max(F.when(F.col("error_type") != "api_error", 1).otherwise(0))
    return log.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        (done == 1).alias("completed"), (done == 0).alias("retry"), F.count(F.lit(1)).alias("n_records")
    )


def plan_resume(grid: DataFrame, log: DataFrame, key: str = "trial_key") -> DataFrame:
    """Grid rows still to run, with the reason: never tried, or only API errors so far."""
    state = resume_state(log, key)
    return (
        grid.join(state, key, "left").filter(~F.coalesce(F.col("completed"), F.lit(False)))
        .withColumn("reason", F.when(F.col("retry"), "retry_api_error").otherwise("never_tried"))
        .drop("completed", "retry", "n_records")
    )


def replace_failed(old: DataFrame, new: DataFrame, id_col: str, order: str, verdict: str = "verdict", failed: str = "crash"):
    """Newest retry record, by ``order``, replaces rows with the failed verdict; all others are kept."""
    payload = [c for c in old.columns if c != id_col]
    retry = new.groupBy(id_col).agg(F.max_by(F.struct(*payload), F.col(order)).alias("_new"))
    use = (F.col(verdict) == failed) & F.col("_new").isNotNull()
    return old.join(retry, id_col, "left").select(
        id_col, *[F.when(use, F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in payload],
        F.coalesce(use, F.lit(False)).alias("replaced"),
    )


def replace_stage(stages: Column, name: str, record: Column) -> Column:
    """Stage list with the named stage's record dropped and the new one appended."""
    return F.array_append(F.filter(stages, lambda s: ~s["stage"].eqNullSafe(F.lit(name))), record)
