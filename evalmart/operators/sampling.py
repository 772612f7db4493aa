"""Seeded selection, id assignment, budgets of text, record keys and feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evalmart.functions.numeric import seeded_digest
from evalmart.operators.prefix import (
    DEFAULT_WIDTH, ordered_rank, running_count, running_total,
)
from evalmart.operators.selection import first_by_digest


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The first n rows in seeded order."""
    return first_by_digest(df.withColumn("_d", seeded_digest(seed, F.col(id_col))), [], "_d", n, tie=[id_col]).drop("_d")


def cap_per_group(df: DataFrame, group: str, id_col: str, k: int, seed: int) -> DataFrame:
    """Up to k rows per group in seeded order; 0 takes all."""
    if k <= 0:
        return df
    return first_by_digest(df.withColumn("_d", seeded_digest(seed, F.col(id_col))), [group], "_d", k, tie=[id_col]).drop("_d")


def assign_ids(df: DataFrame, group: str, order: Sequence[str], prefixes: Column, width: int = 4) -> DataFrame:
    """Sequential id within each group: prefix, underscore, padded number."""
    ranked = ordered_rank(df, [group], order, "_r")
    return ranked.withColumn("local_id", F.concat(prefixes, F.lit("_"), padded(F.col("_r"), width))).drop("_r")


def assign_flat_ids(df: DataFrame, order: Sequence[str], prefix: str, width: int) -> DataFrame:
    """One sequence over all rows, every number padded to ``width`` or to the digits of the row count."""
    ranked = ordered_rank(df, [], order, "_r")
    digits = ranked.agg(F.greatest(F.lit(width), F.length(F.count(F.lit(1)).cast("string"))).alias("_w"))
    wide = ranked.crossJoin(F.broadcast(digits))  # one row
    return wide.withColumn("flat_id", F.concat(F.lit(prefix), padded(F.col("_r"), F.col("_w")))).drop("_r", "_w")


def padded(number: Column, width: int | Column) -> Column:
    """Left-padded with zeros; never cut."""
    text = number.cast("string")
    wanted = width if isinstance(width, Column) else F.lit(width)
    return F.lpad(text, F.greatest(F.length(text), wanted), F.lit("0"))


def fit_budget(df: DataFrame, group: Sequence[str], order: str, cap: int, text: str = "text",
               width: int = DEFAULT_WIDTH) -> DataFrame:
    """Ordered chunks cut so that each group's total stays within ``cap`` characters."""
    rows = running_total(df, group, order, F.length(text).cast("bigint"), "_after", width, keep_previous="_before")
    room = F.lit(cap) - F.col("_before")
    return rows.filter(room > 0).withColumn(
        "snippet", F.left(text, room.cast("int"))).filter("length(snippet) > 0").drop("_after", "_before")


def check_keys(json_text: Column, required: Sequence[str], allowed: Sequence[str]) -> Column:
    """Missing and unknown top-level keys of a JSON record."""
    keys = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    lits = lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    return F.struct(
        F.array_except(lits(required), keys).alias("missing"), F.array_except(keys, lits(allowed)).alias("unknown"))


def collect_feedback(log: DataFrame, tail_out: int = 1200, tail_err: int = 800, cut: int = 2200) -> DataFrame:
    """Feedback texts of unaided attempts, numbered in record order within their task.

    The list of a task stays as rows, so a task with very many attempts is not gathered in one place.
    """
    own = log.filter((F.coalesce("condition", F.lit("")) == "") | (F.col("condition") == "no_context"))
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("model="), null("model"), F.lit(" condition="), null("condition"), F.lit(" error_type="), null("error_type"))
    tails = [F.nullif(F.right(F.coalesce(c, F.lit("")), F.lit(n)), F.lit("")) for c, n in (("stdout_tail", tail_out), ("stderr_tail", tail_err))]
    text = F.left(F.trim(F.concat_ws("\n", head, *tails)), F.lit(cut))
    rows = own.filter(F.coalesce("task_id", F.lit("")) != "").select("task_id", "seq", text.alias("feedback"))
    return running_count(rows, ["task_id"], "seq", "pos").drop("seq")
